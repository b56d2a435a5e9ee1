"""Cleanup of raw sentences: context, routing of proposals, audit, drift, and validation of untrusted answers."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions.diffs import nearest_offset
from lectern.operators.segments import KEY, ordered_text

#: Neighbours each way, least run.
NEAR, RUN = 2, 3


def routed(raw: Column, proposed: Column, needs_review: Column) -> tuple[Column, Column]:
    """P5: (status, effective text) of a proposal."""
    status = F.when(needs_review, "pending_review").when(proposed == raw, "unchanged").otherwise("auto_accepted")
    return status, F.when(needs_review, raw).otherwise(proposed)


def decide(raw: DataFrame, proposals: DataFrame) -> DataFrame:
    """Raw sentences (keys, id, times, raw_text) with their proposals (keys, id, proposed, needs_review, review_reason); none counts as unchanged."""
    both = raw.join(proposals, [*KEY, "id"], "left")
    proposed = F.coalesce("proposed", "raw_text")
    status, effective = routed(F.col("raw_text"), proposed, F.coalesce("needs_review", F.lit(False)))
    return both.select(*KEY, "id", "start_ms", "end_ms", "raw_text", proposed.alias("proposed_text"), effective.alias("effective_text"), status.alias("status"), F.coalesce("review_reason", F.lit("")).alias("review_reason"))


def changes(decided: DataFrame) -> DataFrame:
    """What the audit keeps: pending rows and those whose proposal differs."""
    return decided.where("status = 'pending_review' OR proposed_text != raw_text")


def opened(changed: DataFrame) -> DataFrame:
    """The audit of a run (changes) as reviewers find it: suggestions are open, and hold for the time being."""
    asks = F.col("status") == "pending_review"
    none = F.lit(None).cast("string")
    text = F.coalesce(X.first_filled(F.col("proposed_text"), F.col("raw_text")), F.lit(""))
    return changed.select(*KEY, F.col("id").alias("sentence_id"), "raw_text", "proposed_text", F.when(asks, text).otherwise(F.col("effective_text")).alias("effective_text"), "status", F.when(asks, "pending").alias("decision"), none.alias("approved_text"), F.lit(None).cast("boolean").alias("glossary_review_pending"), none.alias("decided_at"), none.alias("glossary_reviewed_at"), "review_reason")


def provisional(decided: DataFrame) -> DataFrame:
    """Cleaned sentences, pending suggestions applied for the time being."""
    text = F.when(F.col("status") == "pending_review", F.coalesce(X.first_filled(F.col("proposed_text"), F.col("raw_text")), F.lit(""))).otherwise(F.col("effective_text"))
    return decided.select(*KEY, F.col("id").alias("sentence_id"), "start_ms", "end_ms", text.alias("text"))


def full_text(cleaned: DataFrame) -> DataFrame:
    """A-FULL: non-empty texts (blank ones count) of a video, a line each."""
    return cleaned.groupBy(*KEY).agg(ordered_text("sentence_id", "kept", "\n").alias("full_text")) if "kept" in cleaned.columns else full_text(cleaned.withColumn("kept", F.nullif("text", F.lit(""))))


def status_counts(decided: DataFrame) -> DataFrame:
    """A-STAT."""
    return decided.groupBy(*KEY, "status").agg(F.count("*").alias("n"))


def context(batched: DataFrame, width: int = NEAR) -> DataFrame:
    """Per batch the texts just before and after it, within the video."""
    w = W.partitionBy(*KEY).orderBy("id")
    before, after = F.collect_list("raw_text").over(w.rowsBetween(-width, -1)), F.collect_list("raw_text").over(w.rowsBetween(1, width))
    x = batched.select(*KEY, "batch", "id", before.alias("b"), after.alias("a"))
    return x.groupBy(*KEY, "batch").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.min_by("b", "id").alias("before"), F.max_by("a", "id").alias("after"))


def prompts(batched: DataFrame, titles: DataFrame, terms: list[str]) -> DataFrame:
    """Per batch the request as JSON: title, terms, context and target sentences."""
    target = batched.groupBy(*KEY, "batch").agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "raw_text"))), lambda s: F.struct(s["id"].alias("sentence_id"), s["raw_text"].alias("text"))).alias("targets"))
    out = context(batched).join(target, [*KEY, "batch"]).join(titles, KEY, "left")
    return out.select(*KEY, "batch", F.to_json(F.struct(F.coalesce("title", F.lit("")).alias("video_title"), F.array(*(F.lit(t) for t in terms)).cast("array<string>").alias("confirmed_business_terms"), F.col("before").alias("context_before"), F.col("targets").alias("target_sentences"), F.col("after").alias("context_after"))).alias("prompt"))


def neighbours(sentences: DataFrame, width: int = NEAR) -> DataFrame:
    """(keys, id, offset, neighbour's text), by lag and lead over the whole video instead of a self-join."""
    w = W.partitionBy(*KEY).orderBy("id")
    near = [F.struct(F.lit(o).alias("offset"), F.lag("raw_text", -o).over(w).alias("text")) for o in range(-width, width + 1) if o]
    held = sentences.select(*KEY, "id", F.array(*near).alias("near"))
    return held.select(*KEY, "id", F.explode("near").alias("n")).where("n.text IS NOT NULL").select(*KEY, "id", "n.offset", "n.text")


def drift_offsets(proposed: DataFrame) -> DataFrame:
    """(keys, batch, idx, id, offset) of proposals that are nearer to a neighbouring raw sentence; blank ones give 0.

    proposed: keys, batch, id, raw_text, text.  The own sentence and then the
    lowest offset win ties.
    """
    w = W.partitionBy(*KEY).orderBy("id")
    near = F.array(*(F.struct(F.lit(o).cast("long").alias("offset"), F.lag("raw_text", -o).over(w).alias("text")) for o in range(-NEAR, NEAR + 1) if o))
    x = proposed.withColumns({"idx": F.row_number().over(w), "near": F.filter(near, lambda n: n["text"].isNotNull())})
    # blank proposals, and those that are their sentence, have no nearer neighbour and are not sent to Python's workers as texts
    asked = ~X.is_blank(F.col("text")) & ~F.col("text").eqNullSafe(F.col("raw_text"))
    offset = nearest_offset(F.when(asked, F.col("text")), F.when(asked, F.col("raw_text")), F.when(asked, F.col("near")).otherwise(F.slice("near", 1, 0)))
    return x.select(*KEY, "batch", "idx", "id", offset.alias("offset"))


def drift_runs(signals: DataFrame, least: int = RUN) -> DataFrame:
    """Gaps and islands: rows of runs of neighbouring idx with one non-zero offset, of at least `least` rows, within a batch."""
    some = signals.where("offset != 0")
    island = F.col("idx") - F.row_number().over(W.partitionBy(*KEY, "batch", "offset").orderBy("idx"))
    x = some.withColumn("island", island)
    return x.withColumn("run", F.count("*").over(W.partitionBy(*KEY, "batch", "offset", "island"))).where(F.col("run") >= least).drop("island")


def missing_fields(fields: Column, required: tuple[str, ...]) -> Column:
    """The required names a map lacks, in order, joined; empty if none."""
    return F.array_join(F.array_sort(F.array_except(F.array(*(F.lit(r) for r in required)), F.map_keys(fields))), ", ")


#: Fixed value: a code fence.
FENCE = "```"
REQUIRED = ("needs_review", "review_reason", "sentence_id", "text")


def judge_answers(answer: str | None, expected: list[int]) -> tuple[dict[int, dict], dict[int, str]]:
    """Rows of a model's answer that can be used, and what is wrong with the other expected ids.

    Unknown ids are passed over and fields beyond the required ones ignored.  A
    second copy of an id takes both away; a third one counts again.
    """
    good: dict[int, dict] = {}
    bad: dict[int, str] = {}
    try:
        rows = json.loads(answer or "")["results"]
        if not isinstance(rows, list):
            raise TypeError
    except (ValueError, TypeError, KeyError):
        return {}, dict.fromkeys(expected, "no results")
    known = set(expected)
    for i, row in enumerate(rows):
        here = expected[i] if i < len(expected) else None
        try:
            key = int(row["sentence_id"]) if isinstance(row, dict) else None
        except (KeyError, TypeError, ValueError, OverflowError):
            key = None
        if key is None:
            if here is not None:
                bad[here] = "not an object" if not isinstance(row, dict) else "no sentence id"
            continue
        if key not in known:
            continue
        lacking = sorted(set(REQUIRED) - row.keys())
        said, why, asked = row.get("text"), row.get("review_reason"), row.get("needs_review")
        if lacking:
            bad[key] = "missing: " + ", ".join(lacking)
        elif key in good:
            del good[key]
            bad[key] = "repeated"
        elif not isinstance(said, str) or not isinstance(why, str):
            bad[key] = "not a string"
        elif not isinstance(asked, bool):
            bad[key] = "not a boolean"
        elif asked != bool(why.strip()):
            bad[key] = "review without a reason" if asked else "a reason without review"
        else:
            good[key] = {"text": said, "needs_review": asked, "review_reason": why.strip()}
            bad.pop(key, None)
    for key in expected:
        if key not in good:
            bad.setdefault(key, "not returned")
    return good, bad


def judged(answers: DataFrame) -> DataFrame:
    """R1, V6 over batches: answers (keys, batch, expected array<long>, answer string) -> a row for each expected id."""

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                good, bad = judge_answers(r.answer, [int(x) for x in r.expected])
                rows += [(r.partition, r.video_id, r.batch, k, good.get(k, {}).get("text"), good.get(k, {}).get("needs_review"), good.get(k, {}).get("review_reason"), bad.get(k)) for k in map(int, r.expected)]
            yield pd.DataFrame(rows, columns=["partition", "video_id", "batch", "id", "text", "needs_review", "review_reason", "error"])

    return answers.select(*KEY, "batch", "expected", "answer").mapInPandas(run, "partition string, video_id string, batch long, id long, text string, needs_review boolean, review_reason string, error string")


def first_error(judged_rows: DataFrame) -> DataFrame:
    """V7: per batch the first error in the order of ids, if there is any."""
    return judged_rows.where("error IS NOT NULL").groupBy(*KEY, "batch").agg(F.min("id").alias("id"), F.min_by("error", "id").alias("error"))


def copies_verdict(rows: DataFrame) -> DataFrame:
    """R1's rule for copies as an aggregate: well-formed copies of an id count if they are odd in number, and the last one then stands."""
    return rows.groupBy(*KEY, "batch", "id").agg(F.count("*").alias("copies"), F.max_by("text", "pos").alias("last")).select(*KEY, "batch", "id", (F.col("copies") % 2 == 1).alias("accepted"), F.when(F.col("copies") % 2 == 1, F.col("last")).alias("text"))


def json_object(answer: Column) -> Column:
    """R2: the answer's JSON object, or null.  One that opens with a fence loses its first line, and all from its last fence on."""
    said = X.strip(answer)
    inner = F.regexp_replace(said, r"\A[^\n]*\n", "")
    inner = X.strip(F.when(F.contains(inner, F.lit(FENCE)), F.regexp_replace(inner, r"(?s)```(?!.*```).*\z", "")).otherwise(inner))
    bare = F.when(F.startswith(said, F.lit(FENCE)), inner).otherwise(said)
    # the parser stops after a value; what stands behind one fails in an array or in an object
    inside = [F.try_parse_json(F.concat(F.lit(a), bare, F.lit(z))).isNotNull() for a, z in ("[]", ('{"x":', "}"))]
    return F.when(inside[0] & inside[1] & F.startswith(bare, F.lit("{")), bare)


def audit(decided: DataFrame) -> DataFrame:
    """R11, A-DEC: per video the counts of the audit; only kinds that occur, pending including provisional ones."""
    n = lambda s: F.count_if(F.col("status") == s)
    counts = F.create_map(F.lit("unchanged"), n("unchanged"), F.lit("auto_accepted"), n("auto_accepted"), F.lit("pending"), n("pending_review"))
    return decided.groupBy(*KEY).agg(F.map_filter(counts, lambda k, v: v > 0).alias("counts"), F.when(n("pending_review") > 0, "pending_review").otherwise("completed").alias("status"))
