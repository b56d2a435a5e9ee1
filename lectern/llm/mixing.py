"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions only.

Documents are counted into cells (source, language, topic) of token sums first;
all fitting works on cells.  A sweep scales the cells' weights w to the target
tokens of each margin in turn, counting what the probabilities min(1, w) give, so
that margins hold with cells of which all is taken.  Targets are the wanted share
of all tokens, dealt by a margin's own shares raised to a power (1 keeps the
shares, 0 makes them equal) or by given shares; what a value does not hold goes to
the others.  A document is taken if a hash of its id falls below its cell's
probability.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.workspace import Workspace, checked_broadcast, free_names

#: Share of all tokens to take, power of each margin's shares, most sweeps, miss at which they end, seed of the draw.
TAKE, POWERS, SWEEPS, TOLERANCE, SEED = 0.5, {"source": 0.5, "lang": 0.7, "topic": 0.7}, 40, 1e-4, "mix"
MARGINS = ("source", "lang", "topic")
_WORD = r"[^ \t\n\r\f\x0b]+"


def tokens_of(text: Column) -> Column:
    """Number of white-space separated words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def topic_of(text: Column, tokens: Column) -> Column:
    """A coarse topic by the text's form, used where documents have none."""
    return F.when(text.contains("License") | text.contains("rights reserved"), "legal").when(text.contains(" | "), "table").when(text.contains("!! ") | text.contains("*** "), "noise").when(tokens < 100, "short").when(tokens < 800, "medium").otherwise("long")


def draw_of(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) by a hash of the id; a null id counts as an empty text."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / 4294967296.0


def goal_tokens(own: DataFrame, wanted: float) -> DataFrame:
    """own (.., mt, r) with goal = min(mt, c r), c such that the goals sum to `wanted` tokens.

    A value cannot give more than its own tokens mt: what its share r asks for
    beyond them goes to the others in proportion.  Where all values with a share
    hold less than is wanted, each of them gives all.
    """
    c, full = 0.0, -1
    while True:
        out = F.col("r") * c >= F.col("mt")
        held, rest, n = own.where("r > 0").agg(
            F.coalesce(F.sum(F.when(out, F.col("mt"))), F.lit(0)).cast("double"), F.coalesce(F.sum(F.when(~out, F.col("r"))), F.lit(0.0)), F.count(F.when(out, 1))
        ).first()
        if rest <= 0:
            return own.withColumn("goal", F.when(F.col("r") > 0, F.col("mt").cast("double")).otherwise(0.0))
        if n == full:
            return own.withColumn("goal", F.least(F.col("mt").cast("double"), F.col("r") * c))
        c, full = max(0.0, wanted - held) / rest, n


def rake(ws: Workspace, cells: DataFrame, take: float, powers: dict[str, float], given: dict[str, DataFrame] | None = None, sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """cells (margins..., t) with the factor f whose probabilities min(1, f) bring their expected tokens to the goals of all margins.

    given: for a margin, a table (margin, share) instead of a power; values without
    a row get share 0.  A step scales the factors of a value by its goal over what
    the clipped probabilities give now, so cells of which all is taken leave the
    rest of their goal to the others.  Sweeps end when no value misses its goal by
    more than `tolerance` of all tokens, or after `sweeps` where margins contradict
    each other; see `achieved`.  Values without tokens keep their factors.
    """
    total = float(cells.agg(F.coalesce(F.sum("t"), F.lit(0))).first()[0])
    fitted = cells.withColumns({"f": F.lit(take if total > 0 else 0.0), "miss": F.lit(0.0)})
    for m in MARGINS:
        own = cells.groupBy(m).agg(F.sum("t").alias("mt"))
        if given and m in given:
            own = own.join(given[m], m, "left").select(m, "mt", F.coalesce("share", F.lit(0.0)).cast("double").alias("r"))
        else:
            own = own.select(m, "mt", F.when(F.col("mt") > 0, F.pow(F.col("mt") / total, F.lit(powers[m]))).otherwise(0.0).alias("r"))
        goal = goal_tokens(ws.write(own, f"own_{m}"), take * total)
        fitted = fitted.join(goal.select(m, F.col("goal").alias(f"goal_{m}")), m)
    fitted = ws.write(fitted, "cells")
    for _ in range(sweeps if total > 0 else 0):
        next_ = fitted.withColumn("miss", F.lit(0.0))
        for m in MARGINS:
            now = next_.groupBy(m).agg(F.sum(F.col("t") * F.least(F.lit(1.0), F.col("f"))).alias("mw"))
            goal = F.col(f"goal_{m}")
            next_ = next_.join(now, m).withColumns({
                "miss": F.greatest("miss", F.abs(F.col("mw") - goal) / total),
                "f": F.when(F.col("mw") > 0, F.col("f") * goal / F.col("mw")).otherwise(F.col("f")),
            }).drop("mw")
        next_ = ws.write(next_, "sweep")
        ws.drop(fitted)
        fitted = next_
        if fitted.agg(F.max("miss")).first()[0] <= tolerance:
            break
    return fitted


def achieved(fitted: DataFrame) -> DataFrame:
    """What became of the goals: a row (margin, value, goal, expected) in tokens for each value of each margin of rake's result."""
    out = None
    for m in MARGINS:
        rows = fitted.groupBy(F.lit(m).alias("margin"), F.col(m).alias("value")).agg(F.first(f"goal_{m}").alias("goal"), F.sum(F.col("t") * F.least(F.lit(1.0), F.col("f"))).alias("expected"))
        out = rows if out is None else out.unionByName(rows)
    return out


#: Columns that mix adds.
ADDED = ("_tokens", "_topic", "_p", "_kept")


def mix(spark: SparkSession, docs: DataFrame, take: float = TAKE, powers: dict[str, float] = POWERS, given: dict[str, DataFrame] | None = None, topic: str | None = None, seed: str = SEED, added: tuple[str, str, str, str] = ADDED) -> DataFrame:
    """Every row of docs with its tokens, topic, probability and whether it is kept, in columns named as in `added`.

    A null source, language or topic is a value of its own.  Texts without words
    weigh nothing, but are taken with their cell's probability.  Rows that repeat
    an id share one draw.  All docs empty, or none: every probability 0.  Columns
    called as in `added` are replaced, all others pass through, whatever their names.
    """
    ws = Workspace(spark, "mix")
    tokens, about, odds_of, kept = added
    own = free_names([*docs.columns, *added], "m0", "m1", "m2")
    value = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
    keyed = docs.withColumn(own[2], F.col(topic).cast("string")) if topic else docs
    keyed = keyed.withColumns({own[0]: value(F.col("source")), own[1]: value(F.col("lang")), tokens: tokens_of(F.col("text"))})
    keyed = keyed.withColumn(about, F.col(own[2]) if topic else topic_of(F.coalesce("text", F.lit("")), F.col(tokens)))
    keyed = keyed.withColumn(own[2], value(F.col(about)))
    cells = ws.write(keyed.groupBy(*own).agg(F.sum(tokens).alias("t")).toDF(*MARGINS, "t"), "counts")
    fitted = rake(ws, cells, take, powers, given)
    odds = ws.write(fitted.select(*MARGINS, F.least(F.lit(1.0), F.col("f"))).toDF(*own, odds_of), "odds")
    ws.drop_all_but(odds)
    out = keyed.drop(odds_of).join(checked_broadcast(odds), own)
    return out.withColumn(kept, draw_of(F.col("doc_id"), seed) < F.col(odds_of)).drop(*own)


def mix_sql(source: str = "documents", take: float = TAKE, powers: dict[str, float] = POWERS, seed: str = SEED) -> str:
    """The documents with _tokens, _topic, _p, _kept in DuckDB, as a chain of tables that ends in `mixed`."""
    goals, now = "", "fit0"
    for m in MARGINS:
        goals += f""",
own_{m} AS MATERIALIZED (SELECT {m}, sum(t)::DOUBLE AS mt, CASE WHEN sum(t) > 0 THEN pow(sum(t)::DOUBLE / (SELECT total FROM mass), {powers[m]}) ELSE 0 END AS r FROM cells GROUP BY {m}),
goal_{m} AS MATERIALIZED (SELECT {m}, least(mt, r * coalesce((SELECT max(({take} * (SELECT total FROM mass) - before) / rest) FROM (SELECT sum(mt) OVER (ORDER BY mt / r, {m} ROWS UNBOUNDED PRECEDING) - mt AS before, sum(r) OVER (ORDER BY mt / r DESC, {m} DESC ROWS UNBOUNDED PRECEDING) AS rest FROM own_{m} WHERE r > 0)), 0)) AS goal_{m} FROM own_{m})"""
    out = f"""told AS MATERIALIZED (SELECT d.*, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0b]+')), 0)::BIGINT AS _tokens FROM {source} d),
topical AS MATERIALIZED (SELECT *, CASE WHEN contains(text, 'License') OR contains(text, 'rights reserved') THEN 'legal' WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, '!! ') OR contains(text, '*** ') THEN 'noise' WHEN _tokens < 100 THEN 'short' WHEN _tokens < 800 THEN 'medium' ELSE 'long' END AS _topic FROM told),
cells AS MATERIALIZED (SELECT coalesce(source, '') AS source, coalesce(lang, '') AS lang, _topic AS topic, sum(_tokens)::BIGINT AS t FROM topical GROUP BY ALL),
mass AS MATERIALIZED (SELECT sum(t)::DOUBLE AS total FROM cells){goals},
fit0 AS MATERIALIZED (SELECT *, CASE WHEN (SELECT total FROM mass) > 0 THEN {take}::DOUBLE ELSE 0 END AS f, 1e9::DOUBLE AS miss, false AS stop FROM cells JOIN goal_source USING (source) JOIN goal_lang USING (lang) JOIN goal_topic USING (topic))"""
    for s in range(SWEEPS):
        for m in MARGINS:
            to = f"fit{s}_{m}" if m != MARGINS[-1] else f"fit{s + 1}"
            # the first step of a sweep sees whether the sweep before it ended the fitting
            before = f"(SELECT * EXCLUDE (miss, stop), stop OR max(miss) OVER () <= {TOLERANCE} AS stop, CASE WHEN stop OR max(miss) OVER () <= {TOLERANCE} THEN miss ELSE 0 END AS miss FROM {now})" if m == MARGINS[0] else now
            out += f""",
{to} AS MATERIALIZED (SELECT * EXCLUDE (mw) REPLACE (CASE WHEN mw > 0 AND NOT stop THEN f * goal_{m} / mw ELSE f END AS f, CASE WHEN stop THEN miss ELSE greatest(miss, abs(mw - goal_{m}) / (SELECT total FROM mass)) END AS miss) FROM (SELECT *, sum(t * least(1, f)) OVER (PARTITION BY {m}) AS mw FROM {before}))"""
            now = to
    return out + f""",
odds AS MATERIALIZED (SELECT source, lang, topic, least(1.0, f) AS _p FROM {now}),
mixed AS MATERIALIZED (SELECT d.*, _p, (('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT)::DOUBLE / 4294967296.0 < _p AS _kept FROM topical d JOIN odds o ON coalesce(d.source, '') = o.source AND coalesce(d.lang, '') = o.lang AND d._topic = o.topic)"""
