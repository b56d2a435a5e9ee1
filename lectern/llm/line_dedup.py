"""Line dedup by a log-template tree, with DataFrame functions only.

The tree has a fixed depth: a line's token count, then its first LEAD tokens; a
token with a digit counts as a wildcard.  Within a leaf, a token is a constant of
its position if at least MIN_DOCS lines have it there, and a variable field
otherwise; the line's constants and wildcards are its template.  Templates with
enough constants that occur in at least MIN_DOCS documents are recurring.  Their
lines are dropped from every document but the first that has one (smallest id,
then place).  What a template holds thus stays in the corpus once; the values of its
variable fields go with their lines.

MIN_DOCS is an absolute count, which the values of a variable word field pass too
once there is enough data.  So a line has a wide template besides: where several
values of a place pass, only the most frequent are constants, as few as the limits
of a template allow (ties stay together); the one value that passes at its place is
a constant as before.  A line whose own template does not recur goes if its wide
one does.

A line with too many digits for any template, or of fewer than MIN_TOKENS tokens, is
dropped only as a whole: if it stands in MIN_DOCS documents, but for blanks between
tokens.  Short lines without a letter or a digit are layout (brackets, rules) and stay.

Leaves are counted on narrow rows with partial sums; only lines of leaves that
recur, each distinct line once, are ever spread by token.  Rows, leaves, lines and
templates are told by 128-bit digests.  A document's text moves only if too many
documents change to broadcast their drop lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.workspace import Workspace, checked_broadcast, free_names

#: Leading tokens of a leaf; least tokens of a line, documents of a template, share of constants.
LEAD, MIN_TOKENS, MIN_DOCS, CONSTANT = 3, 4, 5, 0.7
#: Stands for the count of a value that alone passes at its place.
ALONE = 1 << 62
_DIGITS = "[^ ]*[0-9][^ ]*"
_SIGN = r"[\p{L}\p{N}]"
_BLANK = r"[ \t\r\f\x0b]+"
_ROW, _LEAF, _LINE = ("k1", "k2"), ("size", "l1", "l2"), ("h1", "h2")


def _row_key(doc_id: Column, text: Column) -> list[Column]:
    """128 bits of a row's id and text."""
    return [F.xxhash64(doc_id, text), F.xxhash64(text, F.lit(1), doc_id)]


def _recurring(held: DataFrame, template: str) -> DataFrame:
    """(template, docs, first): templates in at least MIN_DOCS documents, with their first line."""
    # one row a document first: a template of a third of all rows then meets in partial counts
    each = held.groupBy(template, "doc_id", *_ROW).agg(F.min("pos").alias("pos"))
    return each.groupBy(template).agg(F.count("*").alias("docs"), F.min(F.struct("doc_id", *_ROW, "pos")).alias("first")).where(F.col("docs") >= MIN_DOCS)


def _not_first() -> Column:
    return (F.col("k1") != F.col("first.k1")) | (F.col("k2") != F.col("first.k2")) | (F.col("pos") != F.col("first.pos"))


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, pos, line, size, l1, l2): canonical lines of at least MIN_TOKENS tokens, or with a letter or digit, with 128 bits of their leaf."""
    # All that needs a line's text is computed before lines are exploded, each once: expressions above an explode would be
    # evaluated anew by every filter and column that uses them.
    spaced = lambda c: F.trim(F.regexp_replace(c, _BLANK, " "))
    tokens = lambda c: F.size(F.split(c, " ", -1))
    # with too many wildcards for any template a line keeps its digits, by which it is told below, and recurs only as a whole
    few = lambda c: tokens(c) - F.regexp_count(c, F.lit(_DIGITS)) < F.greatest(F.lit(MIN_TOKENS), CONSTANT * tokens(c))
    even = lambda c: F.when(c.rlike("[0-9]") & few(spaced(c)), spaced(c)).otherwise(F.regexp_replace(spaced(c), _DIGITS, "<*>"))
    odd = lambda c: c.rlike("[0-9\t\r\f\x0b]") | F.contains(c, F.lit("  ")) | F.startswith(c, F.lit(" ")) | F.endswith(c, F.lit(" "))
    made = F.transform(F.split("text", "\n", -1), lambda c: F.when(odd(c), even(c)).otherwise(c))
    made = F.transform(made, lambda c, i: F.struct(i.alias("pos"), c.alias("line"), tokens(c).alias("size"), F.substring_index(c, " ", LEAD).alias("lead")))
    told = F.filter(made, lambda x: (x["size"] >= MIN_TOKENS) | x["line"].rlike(_SIGN))
    lines = docs.where(F.length("text") > 0).select("doc_id", *_ROW, F.inline(told))
    lead = F.when(F.col("lead").rlike("[0-9]"), F.regexp_replace("lead", _DIGITS, "<*>")).otherwise(F.col("lead"))
    return lines.select("doc_id", *_ROW, "pos", "line", "size", F.xxhash64(lead).alias("l1"), F.xxhash64(F.lit(1), lead).alias("l2"))


def drop_lists(ws: Workspace, docs: DataFrame) -> DataFrame:
    """(k1, k2, drops): the places of the lines to drop, for each row key that loses any.  docs: doc_id, k1, k2, text."""
    lines = _lines(docs)
    leaves = ws.write(lines.groupBy(*_LEAF).agg(F.count("*").alias("n")).where(F.col("n") >= MIN_DOCS).select(*_LEAF), "leaves")
    found = ws.write(lines.join(checked_broadcast(leaves), list(_LEAF), "left_semi").withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")}), "candidates")

    distinct = found.where(F.col("size") >= MIN_TOKENS).groupBy(*_LEAF, *_LINE, "line").agg(F.count("*").alias("w"))
    spread = ws.write(distinct.select(*_LEAF, *_LINE, "w", F.col("line").rlike("[0-9]").alias("whole"), F.posexplode(F.split("line", " ", -1)).alias("at", "token")), "tokens")
    passing = ws.write(spread.groupBy(*_LEAF, "at", "token").agg(F.sum("w").alias("n")).where((F.col("n") >= MIN_DOCS) & (F.col("token") != "<*>")), "passing")
    alone = passing.where(~F.col("token").rlike("[0-9]")).groupBy(*_LEAF, "at").agg(F.count("*").alias("values")).where("values = 1").select(*_LEAF, "at", F.lit(ALONE).alias("alone"))
    constant = ws.write(passing.join(alone, [*_LEAF, "at"], "left").select(*_LEAF, "at", "token", F.coalesce("alone", "n").alias("n")), "constants")
    shaped = spread.join(constant, [*_LEAF, "at", "token"], "left").groupBy(*_LEAF, *_LINE, "whole").agg(F.sort_array(F.collect_list(F.struct("at", "token", "n"))).alias("row"), F.count("n").alias("constants"))
    shaped = shaped.where((F.col("constants") >= MIN_TOKENS) & (F.col("constants") >= CONSTANT * F.col("size")) & (~F.col("whole") | (F.col("constants") == F.col("size"))))
    template = lambda least: F.array_join(F.transform("row", lambda s: F.when(s["n"] >= least, s["token"]).otherwise("<*>")), " ")
    least = F.when(F.col("whole"), F.lit(MIN_DOCS)).otherwise(F.get(F.sort_array(F.transform("row", lambda s: s["n"]), False), F.greatest(F.lit(MIN_TOKENS), F.ceil(CONSTANT * F.col("size"))).cast("int") - 1))
    # templates are only ever compared, so digests will do; a wide one counts within its leaf
    shaped = ws.write(shaped.select(*_LEAF, *_LINE, F.unhex(F.md5(template(F.lit(MIN_DOCS)))).alias("template"), F.unhex(F.md5(F.concat_ws(" ", "l1", "l2", template(least)))).alias("wide")), "shapes")
    ws.drop(leaves, spread, passing, constant)
    held = found.drop("line").join(shaped, [*_LEAF, *_LINE]).select("doc_id", *_ROW, "pos", "template", "wide")
    short = found.where(F.col("size") < MIN_TOKENS).select("doc_id", *_ROW, "pos", F.unhex(F.md5("line")).alias("template"), F.lit(None).cast("binary").alias("wide"))
    held = ws.write(held.unionAll(short), "templates")
    ws.drop(found, shaped)
    recurring = ws.write(_recurring(held, "template"), "recurring")
    again = held.join(recurring, "template").where(_not_first())
    rest = ws.write(held.where("wide IS NOT NULL").join(recurring, "template", "left_anti").select(*_ROW, "pos", "wide"), "rest")
    # lines of recurring templates count for a wide one too; of all its lines the first stays, which is the first of its own template as well
    some = ws.write(rest.select("wide").distinct(), "wide")
    wide = ws.write(_recurring(held.join(some, "wide", "left_semi"), "wide"), "recurring_wide")
    beside = rest.join(wide, "wide").where(_not_first())
    drops = ws.write(again.select(*_ROW, "pos").unionAll(beside.select(*_ROW, "pos")).groupBy(*_ROW).agg(F.sort_array(F.collect_set("pos")).alias("drops")), "drops")
    ws.drop_all_but(drops)
    return drops


def dedup_lines(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_lines: str = "_lines", n_dropped: str = "_dropped") -> DataFrame:
    """docs with the recurring lines taken out of `text`, and the columns n_lines and n_dropped (long).

    Null and empty texts stay as they are (0 lines).  Rows that repeat both id and
    text are treated alike; a null id is an id.  Lines are cut at line feeds only;
    blank lines are never dropped; a line may be as long as its text.
    Columns called as n_lines or n_dropped are replaced; all others pass through,
    whatever their names.
    """
    ws = Workspace(spark, "lines")
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    keyed = keyed.withColumns(dict(zip(_ROW, _row_key(F.col("doc_id"), F.col("text")))))
    k1, k2, drop = free_names([*docs.columns, n_lines, n_dropped], "k1", "k2", "drops")
    drops = drop_lists(ws, keyed).toDF(k1, k2, drop)
    drops._lectern_path = ws.tables[-1]._lectern_path
    out = docs.withColumns(dict(zip((k1, k2), _row_key(F.col(doc_id), F.col(text).cast("string"))))).join(checked_broadcast(drops), [k1, k2], "left")
    lines = F.split(F.col(text).cast("string"), "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col(drop), i)), "\n")
    size = F.when(F.length(F.col(text)) > 0, F.size(lines)).otherwise(0).cast("long")
    return out.withColumns({n_lines: size, n_dropped: F.coalesce(F.size(drop), F.lit(0)).cast("long"), text: F.when(F.col(drop).isNull(), F.col(text)).otherwise(kept)}).drop(k1, k2, drop)


def dedup_sql(source: str = "documents") -> str:
    """(doc_id, text, _lines, _dropped) for unique ids, in DuckDB, as a chain of tables that ends in `deduped`; all rules."""
    share, most = f"{CONSTANT}::DOUBLE", f"greatest({MIN_TOKENS}, ceil({CONSTANT}::DOUBLE * len(tokens)))"
    return f"""raw_lines AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, regexp_replace(regexp_replace(unnest(string_split(text, chr(10))), '^[ \\t\\r\\f\\x0b]+', ''), '[ \\t\\r\\f\\x0b]+$', '') AS line
    FROM {source} WHERE length(text) > 0),
cut_lines AS (SELECT doc_id, pos, string_split_regex(line, '[ \\t\\r\\f\\x0b]+') AS raw, list_transform(raw, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS even FROM raw_lines WHERE length(line) > 0),
told_lines AS (SELECT doc_id, pos, raw, even, len(raw) AS size, raw <> even AND len(list_filter(raw, lambda t: NOT regexp_matches(t, '[0-9]'))) < greatest({MIN_TOKENS}, {share} * len(raw)) AS keeps FROM cut_lines),
placed_lines AS MATERIALIZED (SELECT doc_id, pos, size, array_to_string(CASE WHEN keeps THEN raw ELSE even END, ' ') AS line, size || ' ' || array_to_string(even[1:{LEAD}], ' ') AS leaf FROM told_lines),
found_lines AS MATERIALIZED (SELECT * FROM placed_lines WHERE size >= {MIN_TOKENS} AND leaf IN (SELECT leaf FROM placed_lines GROUP BY leaf HAVING count(*) >= {MIN_DOCS})),
distinct_lines AS (SELECT leaf, line, regexp_matches(line, '[0-9]') AS whole, string_split(line, ' ') AS tokens, count(*) AS w FROM found_lines GROUP BY ALL),
spread AS MATERIALIZED (SELECT leaf, line, whole, {most}::BIGINT AS least, w, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS k FROM distinct_lines),
passing AS (SELECT leaf, k, token, sum(w) AS n FROM spread WHERE token <> '<*>' GROUP BY ALL HAVING sum(w) >= {MIN_DOCS}),
lone AS (SELECT leaf, k FROM passing WHERE NOT regexp_matches(token, '[0-9]') GROUP BY ALL HAVING count(*) = 1),
constant AS MATERIALIZED (SELECT p.leaf, p.k, p.token, CASE WHEN l.leaf IS NOT NULL AND NOT regexp_matches(p.token, '[0-9]') THEN {ALONE} ELSE p.n END::HUGEINT AS n FROM passing p LEFT JOIN lone l USING (leaf, k)),
rows_of AS (SELECT s.leaf, s.line, s.whole, s.least, list(struct_pack(token := s.token, n := c.n) ORDER BY s.k) AS r, count(c.token) AS constants, count(*) AS size FROM spread s LEFT JOIN constant c USING (leaf, k, token) GROUP BY ALL),
limits AS (SELECT *, CASE WHEN whole THEN {MIN_DOCS}::HUGEINT ELSE list_reverse_sort(list_filter(list_transform(r, lambda x: x.n), lambda n: n IS NOT NULL))[least] END AS limit_
    FROM rows_of WHERE constants >= {MIN_TOKENS} AND constants >= {share} * size AND (NOT whole OR constants = size)),
shaped AS MATERIALIZED (SELECT leaf, line, array_to_string(list_transform(r, lambda x: CASE WHEN x.n IS NULL THEN '<*>' ELSE x.token END), ' ') AS template,
    leaf || chr(10) || array_to_string(list_transform(r, lambda x: CASE WHEN x.n >= limit_ THEN x.token ELSE '<*>' END), ' ') AS wide FROM limits),
held AS MATERIALIZED (SELECT doc_id, pos, template, wide FROM found_lines JOIN shaped USING (leaf, line)
    UNION ALL SELECT doc_id, pos, line, NULL FROM placed_lines WHERE size < {MIN_TOKENS} AND regexp_matches(line, '[\\p{{L}}\\p{{N}}]')),
firsts AS MATERIALIZED (SELECT template, min(row(doc_id, pos)) AS first FROM held GROUP BY template HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
rest AS MATERIALIZED (SELECT * FROM held WHERE wide IS NOT NULL AND template NOT IN (SELECT template FROM firsts)),
firsts_wide AS (SELECT wide, min(row(doc_id, pos)) AS first FROM held WHERE wide IN (SELECT wide FROM rest) GROUP BY wide HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
gone AS (SELECT doc_id, pos FROM held JOIN firsts USING (template) WHERE row(doc_id, pos) <> first UNION SELECT doc_id, pos FROM rest JOIN firsts_wide USING (wide) WHERE row(doc_id, pos) <> first),
drops AS MATERIALIZED (SELECT doc_id, list(pos) AS drops FROM gone GROUP BY doc_id),
deduped AS MATERIALIZED (SELECT d.* REPLACE (CASE WHEN drops IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(drops, i - 1)), chr(10)) END AS text),
    CASE WHEN length(d.text) > 0 THEN len(string_split(d.text, chr(10))) ELSE 0 END AS _lines, coalesce(len(drops), 0) AS _dropped FROM {source} d LEFT JOIN drops USING (doc_id))"""
