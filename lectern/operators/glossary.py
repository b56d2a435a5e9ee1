"""Glossary: hotwords, phrase search with overlap suppression, selective replacement, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions.phrases import block_hits, first_free

#: Aliases that are looked for one by one.
FEW = 16
#: Bytes of aliases and terms that may go to every task, and the lengths of beginnings that a larger glossary is met by.
ALIAS_BYTES, ANCHORS = 8 << 20, (1, 2, 3, 5, 8, 13)
#: Characters of the texts that a larger glossary meets together.
BLOCK = 4_000_000


def hotwords(*lists: Column) -> Column:
    """The lists one after another, stripped, without blanks, first occurrences only."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.filter(F.transform(F.concat(*(F.coalesce(c, empty) for c in lists)), X.strip), lambda t: t.isNotNull() & (t != "")))


def replacements(entries: list[tuple[str, list[str]]]) -> list[tuple[str, str]]:
    """(alias, term) pairs, longer aliases first, else as given; repeated pairs once.  A user's glossary entries, not corpus rows."""
    import re

    whole = re.compile(X.TERM)
    pairs = []
    for term, aliases in entries:
        term = term.strip()
        if not whole.fullmatch(term):
            raise ValueError(f"not a term: {term!r}")
        pairs += [(a.strip(), term) for a in aliases if a.strip() and a.strip() != term and whole.fullmatch(a.strip())]
    return list(dict.fromkeys(sorted(pairs, key=lambda p: -len(p[0]))))


def pairs_of(entries: DataFrame) -> DataFrame:
    """S2 over a relation of entries (ord, term, aliases): (alias, term, n, ord, at), each pair once; n, ord, at is the order of search: longer aliases first, else as given.  Aliases that are blank, no terms or the term itself are left out; a null list is an empty one."""
    x = entries.select("ord", X.strip(F.col("term")).alias("term"), F.posexplode("aliases").alias("at", "alias")).withColumn("alias", X.strip(F.col("alias")))
    x = x.where((F.col("alias") != F.col("term")) & F.col("alias").rlike(f"^{X.TERM}\\z"))
    first = x.groupBy("alias", "term").agg(F.min(F.struct("ord", "at")).alias("first"))
    return first.select("alias", "term", (-F.length("alias")).alias("n"), "first.ord", "first.at")


def _few_located(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """The occurrences (alias, term, at) of a few pairs, without leaving the JVM: each alias that a text holds is located by what lies between its occurrences."""
    given = F.array(*(F.struct(F.lit(a).alias("alias"), F.lit(t).alias("term")) for a, t in pairs))

    def places(p: Column) -> Column:
        parts = F.split(text, F.concat(F.lit(r"\Q"), p["alias"], F.lit(r"\E")), -1)
        step = lambda a, n: F.struct(F.concat(a["out"], F.array(a["at"] + n)).alias("out"), (a["at"] + n + F.length(p["alias"])).alias("at"))
        starts = F.aggregate(F.transform(F.slice(parts, 1, F.size(parts) - 1), F.length), F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("at")), step, lambda a: a["out"])
        return F.transform(starts, lambda i: F.struct(p["alias"].alias("alias"), p["term"].alias("term"), i.alias("at")))

    # most sentences hold no alias; only those that a text holds are located
    return F.flatten(F.transform(F.filter(given, lambda p: F.contains(text, p["alias"])), places))


def _free(found: Column) -> Column:
    """Of occurrences (alias, term, at) in the order of search, for each pair the first one outside the spans taken so far.  As a text search goes, an occurrence that overlaps the one counted before it of the same alias is none."""
    end = lambda o: o["at"] + F.length(o["alias"])
    start = F.struct(F.array().cast("array<struct<alias:string,term:string,at:int,stop:int>>").alias("taken"), F.lit("").alias("alias"), F.lit("").alias("term"), F.lit(0).alias("next"), F.lit(False).alias("hit"))

    def step(s: Column, o: Column) -> Column:
        same = (o["alias"] == s["alias"]) & (o["term"] == s["term"])
        counted = ~same | (o["at"] >= s["next"])
        free = counted & ~(same & s["hit"]) & ~F.exists(s["taken"], lambda t: (o["at"] < t["stop"]) & (end(o) > t["at"]))
        own = F.struct(o["alias"].alias("alias"), o["term"].alias("term"), o["at"].alias("at"), end(o).alias("stop"))
        return F.struct(F.when(free, F.concat(s["taken"], F.array(own))).otherwise(s["taken"]).alias("taken"), o["alias"].alias("alias"), o["term"].alias("term"), F.when(counted, end(o)).otherwise(s["next"]).alias("next"), ((same & s["hit"]) | free).alias("hit"))

    return F.aggregate(found, start, step, lambda s: s["taken"])


def spans(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """For each (alias, term) in order the first occurrence outside the spans taken so far; an array of (alias, term, at, stop)."""
    return _free(_few_located(text, pairs)) if len(pairs) <= FEW else first_free(pairs)(text)


def search(cleaned: DataFrame, pairs: list[tuple[str, str]] | DataFrame, video_id: str | None = None, most_bytes: int = ALIAS_BYTES) -> DataFrame:
    """Hits over all partitions, or in one video.  cleaned: partition, video_id, title, sentence_id, start_ms, text.

    pairs are (alias, term) in the order of search, or a relation of them as
    `pairs_of` gives it.  A few are looked for one by one; up to most_bytes of aliases and terms go to every task as
    one automaton, which reads a text once however many aliases there are.  A larger
    relation stays where it is: texts are dealt into blocks, and each block gets the
    aliases that its words hold.  Empty and null texts hold no alias.
    """
    x = cleaned.where(F.col("video_id") == video_id) if video_id else cleaned
    x = x.withColumn("text", F.coalesce("text", F.lit("")))
    if isinstance(pairs, DataFrame):
        size, longest, kinds = pairs.agg(F.sum(F.octet_length("alias") + F.octet_length("term")), F.max(F.length("alias")), F.collect_set(_anchored(F.col("alias")))).first()
        if (size or 0) > most_bytes:
            return _told(_met(x, pairs, longest, sorted(kinds)))
        pairs = [(r.alias, r.term) for r in pairs.orderBy("n", "ord", "at", "alias", "term").collect()]  # within most_bytes
    if not pairs:
        return _told(x.limit(0).withColumn("h", F.array(F.struct(F.lit("").alias("alias"), F.lit("").alias("term"), F.lit(0).alias("at")))))
    return _told(x.withColumn("h", spans(F.col("text"), pairs)))


def _told(h: DataFrame) -> DataFrame:
    """Sentences with their hits (h: array of alias, term, at) as the columns of a search, a row for each hit."""
    h = h.withColumn("even", X.evened(F.col("text"))).withColumn("h", F.explode("h"))
    key = X.hit_id(X.json_text(F.col("partition")), X.json_text(F.col("video_id")), F.col("sentence_id").cast("string"), X.json_text(F.col("h.alias")), X.json_text(F.col("h.term")), X.json_text(F.col("text")))
    return h.select("partition", "video_id", "sentence_id", key.alias("hit_id"), X.first_filled(F.col("title"), F.col("video_id")).alias("video_title"), "start_ms", F.col("h.alias").alias("alias"), F.col("h.term").alias("term"), X.clause(F.col("even"), F.col("h.at")).alias("snippet"))


def _anchored(alias: Column) -> Column:
    """The length of an alias's beginning by which it is met: the longest of ANCHORS that it reaches, so that few aliases share one."""
    return F.greatest(*(F.when(F.length(alias) >= n, n) for n in ANCHORS))


def _met(x: DataFrame, pairs: DataFrame, longest: int, kinds: list[int]) -> DataFrame:
    """Sentences with their hits.

    An alias is a term and so lies within a word, a stretch of term characters.  The
    words of all sentences, each once, meet the beginnings of aliases by their own
    substrings; a word is known by a hash, as one alias too many does no harm.  Each
    block of sentences then gets the pairs of its words, and is searched for them.
    """
    own = ["partition", "video_id", "sentence_id", "start_ms", "title", "text"]
    blocks = max(1, -(-(x.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK))
    texts = x.select(*own).where("text != ''").withColumn("block", F.pmod(F.xxhash64(*own), F.lit(blocks)).cast("int"))
    words = texts.select("block", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(f"({X.TERM})"), 1))).alias("word")).where(F.length("word") >= kinds[0]).distinct()
    at = words.select("word").distinct().select(F.xxhash64("word").alias("k"), "word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("place"))
    rest = at.select("k", F.substring("word", F.col("place"), F.lit(longest)).alias("rest"))
    grams = rest.withColumn("kind", F.explode(F.array(*map(F.lit, kinds)))).where(F.length("rest") >= F.col("kind")).withColumn("anchor", F.left("rest", F.col("kind"))).drop("kind")
    aliases = pairs.select("alias").distinct().withColumn("anchor", F.left("alias", _anchored(F.col("alias"))))
    held = grams.join(aliases, "anchor").where(F.startswith("rest", F.col("alias"))).select("k", "alias")
    asked = words.select("block", F.xxhash64("word").alias("k")).join(held, "k").select("block", "alias").distinct().join(pairs, "alias")
    order = ["n", "ord", "at", "alias", "term"]
    # texts have nulls where pairs have their order, and come after them
    rows = asked.select("block", *order).unionByName(texts, allowMissingColumns=True)
    return block_hits(rows.repartition(blocks, "block").sortWithinPartitions("block", *(F.asc_nulls_last(c) for c in order)), own)


def stale(selected: DataFrame, hits: DataFrame) -> DataFrame:
    """Selected hit ids that no longer exist; any is a conflict."""
    return selected.select("hit_id").join(hits.select("hit_id"), "hit_id", "left_anti")


def apply_hits(cleaned: DataFrame, hits: DataFrame, selected: DataFrame) -> DataFrame:
    """Cleaned with column new_text: every occurrence of a selected alias in its sentence replaced, longer aliases first."""
    some = hits.join(selected.select("hit_id").distinct(), "hit_id", "left_semi")
    order = F.struct((-F.length("alias")).alias("n"), "alias", "term")
    steps = some.groupBy("partition", "video_id", "sentence_id").agg(F.sort_array(F.collect_set(order)).alias("steps"))
    x = cleaned.join(steps, ["partition", "video_id", "sentence_id"], "left")
    done = F.aggregate("steps", F.coalesce("text", F.lit("")), lambda t, s: F.replace(t, s["alias"], s["term"]))
    return x.withColumn("new_text", F.when(F.col("steps").isNotNull(), done).otherwise(F.col("text"))).drop("steps")


def applied_counts(edited: DataFrame, selected: DataFrame) -> DataFrame:
    """A-GLOS, in one row.  Nothing runs until it is read, so that the hits counted are those that were applied, and are searched for once."""
    changed = edited.where(~F.col("new_text").eqNullSafe(F.col("text")))
    n = selected.agg(F.count_distinct("hit_id").cast("long").alias("selected"))
    return n.crossJoin(changed.agg(F.count("*").alias("changed_sentences"), F.count_distinct("partition", "video_id").alias("changed_videos")))  # one row each


def upsert(stored: DataFrame, entries: DataFrame) -> DataFrame:
    """SNK12, G7: stored (scope, video_id, term, aliases) merged with entries (the same, ord); changed tells the terms that differ.

    Aliases keep their order, new ones follow; blank ones and the term itself are left out.
    """
    key = ["scope", "video_id", "term"]
    own = F.filter(F.transform("aliases", X.strip), lambda a: (a != "") & (a != F.col("term")))
    new = entries.withColumn("aliases", own).groupBy(*key).agg(F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("ord", "aliases"))), lambda s: s["aliases"]))).alias("new"))
    empty = F.array().cast("array<string>")
    s, n = stored.withColumnRenamed("aliases", "old").alias("s"), new.alias("n")
    x = s.join(n, [F.col(f"s.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key], "full_outer")
    merged = F.array_distinct(F.concat(F.coalesce("s.old", empty), F.coalesce("n.new", empty)))
    return x.select(*(F.coalesce(f"s.{k}", f"n.{k}").alias(k) for k in key), merged.alias("aliases"), (F.col("n.term").isNotNull() & (F.col("s.old").isNull() | ~(merged == F.col("s.old")))).alias("changed"))


def entry_faults(entries: DataFrame) -> DataFrame:
    """Entries that must be refused."""
    bad_alias = F.exists(F.filter(F.transform("aliases", X.strip), lambda a: (a != "") & (a != F.col("term"))), lambda a: ~X.is_term(a))
    fault = F.when(~X.is_term(X.strip(F.col("term"))), "term").when(~F.col("scope").isin("global", "video"), "scope").when(bad_alias, "alias")
    return entries.select("scope", "term", fault.alias("fault")).where("fault IS NOT NULL")


def novel(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """Candidates (video_id, term, aliases) that no scope covers with all their aliases, and the scopes that have the term."""
    g = stored.where("scope = 'global'").select("term", F.lit("global").alias("s1"), F.col("aliases").alias("a1"))
    v = stored.where("scope = 'video'").select("video_id", "term", F.lit("video").alias("s2"), F.col("aliases").alias("a2"))
    x = candidates.join(g, "term", "left").join(v, ["video_id", "term"], "left")
    within = lambda a: F.coalesce(F.size(F.array_except("aliases", a)) == 0, F.lit(False))
    return x.where(~(F.col("s1").isNotNull() & within("a1")) & ~(F.col("s2").isNotNull() & within("a2"))).withColumn("existing_scopes", F.filter(F.array("s1", "s2"), lambda s: s.isNotNull())).drop("s1", "s2", "a1", "a2")


def merged_candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """Candidates by (video_id, term), aliases of both sides in order."""
    key = ["video_id", "term"]
    x = left.select(*key, F.col("aliases").alias("a")).join(right.select(*key, F.col("aliases").alias("b")), key, "full_outer")
    empty = F.array().cast("array<string>")
    return x.select(*key, F.array_distinct(F.concat(F.coalesce("a", empty), F.coalesce("b", empty))).alias("aliases"))


def first_candidates(found: DataFrame, most: int = 20) -> DataFrame:
    """At most `most` a video, by position."""
    return found.withColumn("rn", F.row_number().over(W.partitionBy("video_id").orderBy("pos"))).where(F.col("rn") <= most).drop("rn")
