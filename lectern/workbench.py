"""The engine's front door: what a reviewer's application calls, over a versioned store.

Reads return DataFrames; edits read a pointer, transform relations, check them, and
commit all that changed at once.  Conflicts, missing things and refused values are
ConflictError, KeyError or FileNotFoundError, and ValueError.

Relations of the store: raw (keys, id, start_ms, end_ms, raw_text), cleaned (keys,
sentence_id, start_ms, end_ms, text), documents (partition, video_id, title,
review_status, revision, updated_at, confirmed_at), segments, changes, glossary
(scope, video_id, term, aliases), uploads (id, filename, uploaded_at), business,
history (keys, counts, decisions, final, updated_at), explanations.  An edit reads and
writes the rows of its videos only.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions.diffs import term_candidates
from lectern.operators import catalog, cleanup, edits, glossary, responder, segments, validation
from lectern.operators.jobs import LIVE
from lectern.sources import documents
from lectern.sources.store import ConflictError, Store, locked, tally

KEY = segments.KEY
#: What the rows of a relation are ordered by.
ORDER = {"raw": ("id",), "cleaned": ("sentence_id",), "segments": ("segment_no",), "changes": ("sentence_id",)}


def now() -> str:
    """Local time with offset."""
    return datetime.now().astimezone().isoformat(timespec="microseconds")


class Workbench:
    def __init__(self, store: Store, clock: Callable[[], str] = now):
        self.store, self.spark, self.clock = store, store.spark, clock

    # --- reads

    def _ids(self, name: str, at: dict, **columns: str) -> DataFrame:
        """(id, columns) of the videos of a relation, from what is kept of it: no row of the relation is read.  columns: the names here, of those kept."""
        if tally(name) not in at["relations"]:
            return self.spark.createDataFrame([], ", ".join(["id string", *(f"{c} long" for c in columns)]))
        return self.store.table(tally(name), at).select(F.col("video_id").alias("id"), *(F.col(kept).cast("long").alias(c) for c, kept in columns.items()))

    def records(self, at: dict | None = None) -> DataFrame:
        """The catalog, not ordered; its counts are kept with each commit."""
        at = at or self.store.pointer()
        docs = self.store.table("documents", at).groupBy(F.col("video_id").alias("id")).agg(F.max("title").alias("title"), F.max("review_status").alias("review_status")) if "documents" in at["relations"] else self.spark.createDataFrame([], "id string, title string, review_status string")
        raw = self._ids("raw", at, duration_ms="duration_ms", sentence_count="n").withColumns({"title": F.lit(""), "processed_at": F.lit("")})
        seg = self._ids("segments", at, segment_count="n").join(docs, "id", "left")
        bus = self._ids("business", at, annotation_count="n").withColumn("title", F.lit(""))
        up = self.store.table("uploads", at).groupBy("id").agg(F.max("filename").alias("filename"), F.max("uploaded_at").alias("uploaded_at")) if "uploads" in at["relations"] else self.spark.createDataFrame([], "id string, filename string, uploaded_at string")
        return catalog.records(raw, self._ids("cleaned", at).join(docs.select("id", "title"), "id", "left"), seg, bus, up, self._ids("changes", at), up.select("id"))

    def dashboard(self) -> tuple[DataFrame, DataFrame]:
        """(counts, ordered records)."""
        r = self.records()
        return catalog.counts(r), catalog.ordered(r)

    def markdown(self, video_id: str, segment_no: int | None = None) -> str:
        """The Markdown of a video, or of one of its chapters."""
        _, part = self._near(self.store.pointer(), video_id)
        seg = self.store.table("segments", part)
        if segment_no is None:
            row = segments.document_markdown(seg, self.store.table("documents", part).select(*KEY, "title")).first()
        else:
            row = seg.where(F.col("segment_no") == segment_no).select(segments.chapter_markdown(*(F.col(c) for c in ("title", "summary", "keywords", "start_ms", "end_ms", "content"))).alias("markdown")).first()
        if row is None:
            raise KeyError(video_id if segment_no is None else f"{video_id} has no chapter {segment_no}")
        return row.markdown

    def suggestions(self, video_id: str) -> DataFrame:
        return catalog.suggestions(self.store.table("changes", self._near(self.store.pointer(), video_id)[1]))

    def validate(self) -> DataFrame:
        """V1-V3 over the newest version."""
        at = self.store.pointer()
        raw, cleaned, seg = (self.store.table(n, at) for n in ("raw", "cleaned", "segments"))
        heads = raw.groupBy(*KEY).agg(F.lit(0).alias("duration_ms"), F.first("video_id").alias("id_in_file"))
        return validation.all_faults(validation.raw_faults(raw.withColumn("pos", F.col("id")), heads), validation.cleaned_faults(raw, cleaned, cleanup.full_text(cleaned)), validation.segment_faults(cleaned, seg))

    def search_glossary(self, entries: list[tuple[str, list[str]]], video_id: str | None = None, at: dict | None = None) -> DataFrame:
        at = at or self.store.pointer()
        at = self._near(at, video_id)[1] if video_id else at
        titled = self.store.table("cleaned", at).join(self.store.table("documents", at).select(*KEY, "title"), KEY, "left")
        return glossary.search(titled, glossary.replacements(entries), video_id)

    # --- edits

    def _near(self, at: dict, video_id: str) -> tuple[DataFrame, dict]:
        """A video as a relation, and the pointer narrowed to it: all that is read of this video."""
        one = self.store.one(video_id)
        return one, self.store.narrowed(at, one)

    def _editable(self, at: dict, video_id: str) -> tuple[DataFrame, dict]:
        """The same for an edit, which a live job forbids."""
        one, part = self._near(at, video_id)
        self._free(at, one)
        return one, part

    def _free(self, at: dict, videos: DataFrame) -> None:
        """No edit while a job works on the video."""
        if "jobs" in at["relations"]:
            live = self.store.table("jobs", at).where(F.col("job_status").isin(*LIVE) & F.col("status").isin(*LIVE))
            if taken := live.join(videos, "video_id", "left_semi").first():
                raise ConflictError(f"a job works on {taken.video_id}")

    def _history(self, part: dict, changes: DataFrame, cleaned: DataFrame, videos: DataFrame) -> DataFrame:
        """The snapshots of the audits, those of the videos made anew."""
        new = edits.snapshots(changes, cleaned, videos, F.lit(self.clock()))
        if "history" not in part["relations"]:
            return new
        return self.store.table("history", part).join(new.select(*KEY), KEY, "left_anti").select(new.columns).unionByName(new)

    def _publish(self, at: dict, part: dict, after: DataFrame, videos: DataFrame, **more: DataFrame) -> int:
        """Commit changed sentences of some videos (all rows of these) with all that follows from them; part is the pointer narrowed to them."""
        before, seg, changes = (self.store.table(n, part).persist() for n in ("cleaned", "segments", "changes"))
        after = after.persist()
        rebuilt = edits.rebuild(before, after, seg).persist()  # these are asked for many times, and hold the edited videos only
        try:
            validation.raise_on(validation.segment_faults(after, rebuilt))
            docs = edits.touched(self.store.table("documents", part), videos, F.lit(self.clock()))
            history = self._history(part, more.get("changes", changes), after, videos)
            return self.store.commit({"cleaned": after, "segments": rebuilt, "documents": docs, "history": history, **more}, at["revision"], videos)
        finally:
            for held in (rebuilt, after, before, seg, changes):
                held.unpersist()

    @locked
    def apply_glossary(self, entries: list[tuple[str, list[str]]], hit_ids: list[str], video_id: str | None = None) -> dict:
        """Replace the selected hits; hits that are no longer there are a conflict and nothing changes."""
        at = self.store.pointer()
        hits = self.search_glossary(entries, video_id, at)
        chosen = self.spark.createDataFrame([(h,) for h in dict.fromkeys(hit_ids)], "hit_id string")
        if not glossary.stale(chosen, hits).isEmpty():
            raise ConflictError("the hits have changed; search again")
        hits = hits.join(chosen, "hit_id", "left_semi").select(hits.columns).persist()  # few, and asked for several times
        try:
            before = self.store.table("cleaned", self.store.narrowed(at, hits))
            edited = glossary.apply_hits(before, hits, chosen)
            counts = glossary.applied_counts(edited, chosen).first().asDict()
            if counts["changed_sentences"]:
                videos = edited.where(~F.col("new_text").eqNullSafe(F.col("text"))).select("video_id").distinct()
                self._free(at, videos)
                after = edited.withColumn("text", F.col("new_text")).select(before.columns).join(videos, "video_id", "left_semi").select(before.columns)
                self._publish(at, self.store.narrowed(at, videos), after, videos)
        finally:
            hits.unpersist()
        return counts

    @locked
    def save_sentences(self, video_id: str, texts: dict[int, str]) -> int:
        """Texts of some of a video's sentences; unknown ids are refused."""
        at = self.store.pointer()
        one, part = self._editable(at, video_id)
        before = self.store.table("cleaned", part)
        new = before.select(*KEY, "sentence_id").join(self.spark.createDataFrame(list(texts.items()), "sentence_id long, text string"), "sentence_id")
        if new.count() != len(texts):
            raise KeyError(f"{video_id}: not all of these sentences exist")
        return self._publish(at, part, edits.replace_sentences(before, new), one)

    @locked
    def save_chapter(self, video_id: str, segment_no: int, fields: dict, expected_revision: int | None = None, expected_updated_at: str | None = None, terms: list[tuple[str, str | None, str, list[str]]] = ()) -> int:
        """Title, summary, keywords and content of a chapter, with the revision that its page showed; SNK12, E9: glossary terms saved with it, and its custom texts reviewed."""
        at = self.store.pointer()
        one, part = self._editable(at, video_id)
        raw, docs, seg, before, changes = (self.store.table(n, part) for n in ("raw", "documents", "segments", "cleaned", "changes"))
        ask = self.spark.createDataFrame([(video_id, expected_revision, expected_updated_at)], "video_id string, expected_revision long, expected_updated_at string")
        if not edits.conflicts(docs, ask).isEmpty():
            raise ConflictError("the chapter has a newer version")
        row = seg.where((F.col("video_id") == video_id) & (F.col("segment_no") == segment_no)).first()
        if row is None:
            raise KeyError(f"{video_id} has no chapter {segment_no}")
        edit = self.spark.createDataFrame([(row.partition, video_id, segment_no, fields["title"], fields["summary"], list(fields["keywords"]), fields["content"])], "partition string, video_id string, segment_no long, title string, summary string, keywords array<string>, content string")
        if bad := edits.field_faults(edit).first():
            raise ValueError(f"the {bad.fault} is empty or too long")
        cleaned, changed = edits.save_chapter(before, seg, edit)
        own = lambda t: t.where(F.col("video_id") == video_id)
        validation.raise_on(validation.cleaned_faults(own(raw), own(cleaned), cleanup.full_text(own(cleaned))))
        validation.raise_on(validation.segment_faults(own(cleaned), own(changed), check_content=False))
        reviewed = edits.glossary_reviewed(changes, seg.where((F.col("video_id") == video_id) & (F.col("segment_no") == segment_no)), F.lit(self.clock()))
        new = {"cleaned": cleaned, "segments": changed, "documents": edits.touched(docs, edit, F.lit(self.clock())), "changes": reviewed, "history": self._history(part, reviewed, cleaned, ask)}
        merged, n = self._merged_terms(at, terms)
        return self.store.commit(new | ({"glossary": merged} if n else {}), at["revision"], one)

    @locked
    def save_markdown(self, video_id: str, segment_no: int, markdown: str, **expected) -> int:
        """E6."""
        f = self.spark.createDataFrame([(markdown,)], "m string").select(edits.chapter_of_markdown(F.col("m")).alias("f")).first().f
        if None in (f.title, f.summary, f.content):
            raise ValueError("the Markdown lacks a title, a summary or a content section")
        return self.save_chapter(video_id, segment_no, f.asDict(), **expected)

    @locked
    def decide(self, video_id: str, sentence_id: int, decision: str, approved_text: str | None = None) -> int:
        """A decision changes the sentence, its chapter and the audit together."""
        if decision not in ("approved", "rejected"):
            raise ValueError("a decision is approved or rejected")
        at = self.store.pointer()
        one, part = self._editable(at, video_id)
        changes, before = self.store.table("changes", part), self.store.table("cleaned", part)
        say = self.spark.createDataFrame([(video_id, sentence_id, decision, approved_text)], "video_id string, sentence_id long, decision string, approved_text string")
        after = edits.decide_suggestions(changes, say, F.lit(self.clock()))
        row = after.where((F.col("video_id") == video_id) & (F.col("sentence_id") == sentence_id) & (F.col("status") == "pending_review")).first()
        if row is None:
            raise KeyError(f"{video_id} has no open suggestion for sentence {sentence_id}")
        if decision == "approved" and not row.effective_text:
            raise ValueError("an approved text cannot be empty")
        new = before.where((F.col("video_id") == video_id) & (F.col("sentence_id") == sentence_id)).withColumn("text", F.lit(row.effective_text))
        return self._publish(at, part, edits.replace_sentences(before, new), one, changes=after)

    @locked
    def confirm(self, video_id: str) -> int:
        """Only a video whose sentences and chapters are valid can be confirmed."""
        at = self.store.pointer()
        one, part = self._editable(at, video_id)
        raw, cleaned, seg = (self.store.table(n, part) for n in ("raw", "cleaned", "segments"))
        if seg.isEmpty():
            raise KeyError(video_id)
        validation.raise_on(validation.cleaned_faults(raw, cleaned, cleanup.full_text(cleaned)))
        validation.raise_on(validation.segment_faults(cleaned, seg))
        c, d = edits.confirm(self.store.table("changes", part), self.store.table("documents", part), one, F.lit(self.clock()))
        return self.store.commit({"changes": c, "documents": d, "history": self._history(part, c, cleaned, one)}, at["revision"], one)

    @locked
    def publish_cleanup(self, raw_seen: DataFrame, decided: DataFrame, overwrite: bool = False) -> int:
        """SNK9: the result of a cleanup run over raw_seen, with open suggestions applied for the time being.

        Refused: a result that does not fit its raw sentences (ValueError), raw
        sentences that have changed since, an audit that is there already, and
        sentences that are there already, unless they may be overwritten
        (ConflictError).
        """
        at = self.store.pointer()
        ids = decided.select("video_id").distinct()
        part = self.store.narrowed(at, ids)
        table = lambda n, like: self.store.table(n, part) if n in part["relations"] else like.limit(0)
        seen = raw_seen.join(ids, "video_id", "left_semi").select(raw_seen.columns)
        cleaned = cleanup.provisional(decided)
        validation.raise_on(validation.cleaned_faults(seen, cleaned, cleanup.full_text(cleaned)))
        now = self.store.table("raw", part).select(raw_seen.columns)
        if not now.exceptAll(seen).isEmpty() or not seen.exceptAll(now).isEmpty():
            raise ConflictError("the raw sentences changed during the cleanup")
        audit = cleanup.opened(cleanup.changes(decided))
        old, audits = table("cleaned", cleaned), table("changes", audit)
        if not audits.isEmpty():
            raise ConflictError("an audit of this cleanup is there already")
        if not old.isEmpty():
            if not overwrite:
                raise ConflictError("cleaned sentences were published meanwhile")
            if "segments" in part["relations"] and not self.store.table("segments", part).isEmpty():
                raise ConflictError("chapters are built on the cleaned sentences")
        opened = audits.unionByName(audit, allowMissingColumns=True).select(audits.columns)
        return self.store.commit({"cleaned": cleaned, "changes": opened, "history": self._history(part, opened, cleaned, ids)}, at["revision"], ids)

    @locked
    def publish_explanations(self, plans: DataFrame) -> int:
        """SNK14: explanations of chapters (video_id, one row each with its request), written once; a video that has one keeps it."""
        at = self.store.pointer()
        part = self.store.narrowed(at, plans)
        old = self.store.table("explanations", part) if "explanations" in part["relations"] else plans.limit(0)
        new = plans.join(old.select("video_id").distinct(), "video_id", "left_anti").select(plans.columns)
        if new.isEmpty():
            return at["revision"]
        stamped = new if "generated_at" in plans.columns else new.withColumn("generated_at", F.lit(self.clock()))
        return self.store.commit({"explanations": stamped}, at["revision"], new.select("video_id").distinct())

    @locked
    def add_uploads(self, found: DataFrame) -> int:
        """SNK8: uploaded files (id, filename, path, size, uploaded_at), by content; the newest manifest of a content stands.  Refused: one stored name for two contents."""
        at = self.store.pointer()
        old = self.store.table("uploads", at) if "uploads" in at["relations"] else found.limit(0)
        every = old.unionByName(found, allowMissingColumns=True)
        newest = every.groupBy("id").agg(F.max_by(F.struct(*every.columns), F.struct("uploaded_at", "filename")).alias("x")).select("x.*")
        if clash := documents.stored_name_clashes(newest).first():
            raise ConflictError(f"{clash.stored_name} would hold {clash.contents} contents")
        return self.store.commit({"uploads": newest}, at["revision"], found.select(F.col("id").alias("video_id")))

    # --- terms

    def _merged_terms(self, at: dict, entries) -> tuple[DataFrame | None, int]:
        """The glossary with entries merged in, and how many terms that changes."""
        if not entries:
            return None, 0
        schema = "scope string, video_id string, term string, aliases array<string>"
        new = self.spark.createDataFrame([(*e, i) for i, e in enumerate(entries)], schema + ", ord long")
        if bad := glossary.entry_faults(new).first():
            raise ValueError(f"the {bad.fault} of {bad.term!r} is not allowed")
        stored = self.store.table("glossary", at) if "glossary" in at["relations"] else self.spark.createDataFrame([], schema)
        merged = glossary.upsert(stored, new)
        return merged.drop("changed"), merged.where("changed").count()

    @locked
    def save_terms(self, entries: list[tuple[str, str | None, str, list[str]]]) -> int:
        """SNK12: (scope, video_id, term, aliases); the number of terms that changed, written only if any did."""
        at = self.store.pointer()
        merged, n = self._merged_terms(at, entries)
        if n:
            self.store.commit({"glossary": merged}, at["revision"])
        return n

    def candidates(self, video_id: str, segment_no: int, markdown: str) -> DataFrame:
        """(video_id, term, aliases, existing_scopes): terms that an edited chapter brings in, and those of its custom texts that no one has reviewed."""
        at = self.store.pointer()
        _, part = self._near(at, video_id)
        row = self.store.table("segments", part).where((F.col("video_id") == video_id) & (F.col("segment_no") == segment_no))
        if row.isEmpty():
            raise KeyError(f"{video_id} has no chapter {segment_no}")
        content = F.coalesce(edits.chapter_of_markdown(F.lit(markdown))["content"], F.lit(""))
        typed = row.select("video_id", F.lit(0).alias("pos"), F.coalesce("content", F.lit("")).alias("was"), content.alias("now"))
        c, g = self.store.table("changes", part).alias("c"), row.alias("g")
        proposed, approved = X.strip(X.first_filled(F.col("c.proposed_text"), F.col("c.raw_text"))), X.strip(F.coalesce("c.approved_text", F.lit("")))
        custom = (F.col("c.decision") == "approved") & (approved != "") & (approved != proposed) & F.coalesce("c.glossary_review_pending", F.lit(True))
        own = c.join(g, (F.col("c.video_id") == F.col("g.video_id")) & F.col("c.sentence_id").between(F.col("g.start_sentence_id"), F.col("g.end_sentence_id"))).where(custom).select("c.video_id", F.col("c.sentence_id").alias("pos"), proposed.alias("was"), approved.alias("now"))
        stored = self.store.table("glossary", at) if "glossary" in at["relations"] else self.spark.createDataFrame([], "scope string, video_id string, term string, aliases array<string>")
        terms = lambda t: t.select("video_id", "pos", F.explode(term_candidates(F.col("was"), F.col("now"))).alias("t")).select("video_id", "pos", "t.term", "t.aliases")
        one = lambda t: t.groupBy("video_id", "term").agg(F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", "aliases"))), lambda s: s["aliases"]))).alias("aliases"))
        left, right = (glossary.novel(one(terms(t)), stored) for t in (typed, own))
        scopes = left.select("video_id", "term", "existing_scopes").unionByName(right.select("video_id", "term", "existing_scopes")).dropDuplicates(["video_id", "term"])
        return glossary.merged_candidates(left, right).join(scopes, ["video_id", "term"])

    def metadata(self, video_id: str, segment_no: int, content: str, respond: responder.Responder) -> dict:
        """Title, summary and keywords that a model proposes for an edited chapter; nothing is stored."""
        own = (F.col("video_id") == video_id) & (F.col("segment_no") == segment_no)
        if self.store.table("segments", self._near(self.store.pointer(), video_id)[1]).where(own).isEmpty():
            raise KeyError(f"{video_id} has no chapter {segment_no}")
        return responder.chapter_metadata(content, respond)

    def video(self, video_id: str) -> DataFrame:
        """SRC16: one row with all that is stored of a video: its record, rows of each relation, open suggestions and Markdown."""
        at = self.store.pointer()
        _, part = self._near(at, video_id)
        one = self.records(part).where(F.col("id") == video_id)
        if one.isEmpty():
            raise KeyError(video_id)
        own = {n: self.store.table(n, part).where(F.col("video_id") == video_id) for n in ("raw", "cleaned", "segments", "documents", "changes", "history", "business") if n in part["relations"]}
        sides = {n: t.groupBy(F.col("video_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct(*(c for c in ORDER.get(n, ()) if c in t.columns), *(c for c in t.columns if c not in KEY and c not in ORDER.get(n, ()))))).alias("rows")) for n, t in own.items()}
        if "changes" in own:
            sides["suggestions"] = catalog.suggestions(own["changes"]).groupBy(F.col("video_id").alias("id")).agg(F.sort_array(F.collect_list("sentence_id")).alias("sentence_ids"))
        if {"segments", "documents"} <= own.keys():
            sides["markdown"] = segments.document_markdown(own["segments"], own["documents"].select(*KEY, "title")).select(F.col("video_id").alias("id"), "markdown")
        return catalog.detail(one, record=one, **sides)

    @locked
    def delete(self, video_id: str) -> int:
        """SNK7: rows removed."""
        at = self.store.pointer()
        self._free(at, self.store.one(video_id))
        return self.store.delete_video(video_id, at["revision"])[1]
