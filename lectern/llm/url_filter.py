"""URL filter by a path-template tree for each host, with DataFrame functions only.

URLs that a rule fits are the labelled ones.  Paths are first counted as whole
(host, segments) rows, so everything later works on distinct paths.  Segments that
look like numbers or hex ids become wildcards by their shape.  Then, from the host
down, a node whose labelled URLs disagree is split by the next segment, for as long
as paths go on; one of a single verdict has nothing left to tell.  Segments that all
paths going on share are one level.

Branches of a node that are alike in statistics merge.  Whether they are is asked of
all of them at once: the chi-square of homogeneity tells how much more their shares
scatter than chance makes shares of one chance scatter (Z deviates by the cube-root
rule), so noise does not part them however many there are.  Branches that are not
alike are cut in two, in the order of their shares, where the cut explains most, and
each side is asked again.  So all branches of a merged one fit one chance, and
nothing chains.  A merged branch is '*' and its number in that order, a branch alone
keeps its segment, and branches without labels are '*'.  Branches of equal counts
are handled as one row, so that a node of any width takes little room.

A template's purity is its share of allowed among labelled URLs, smoothed towards
its parent's with KAPPA pseudo-counts, up to the host and then to all hosts; a level
that leaves a node's labelled URLs together adds no evidence.  Templates below CUT
are rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.workspace import Workspace

#: Deviates beyond which branches are not alike, pseudo-counts, least purity.
Z, KAPPA, CUT = 2.576, 4.0, 0.5
#: The contract's rules.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased and path; both empty for a null url or one without '://'."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UP, _LOW), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(size, host_size, rule, verdict) of the longest rule that fits, else null."""
    by_host: dict[str, list] = {}
    for verdict, h, p in rules:
        by_host.setdefault(h, []).append((p, verdict))
    if not by_host:
        return F.lit(None).cast("struct<size:int,host_size:int,rule:string,verdict:string>")
    of = F.create_map(*(x for h, own in by_host.items() for x in (F.lit(h), F.array(*(F.struct(F.lit(len(h) + len(p)).alias("size"), F.lit(len(h)).alias("host_size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"), F.lit(p).alias("path")) for p, v in own)))))
    names = F.split(host, r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.array_join(F.slice(names, i, F.size(names)), "."))
    known = F.filter(tails, lambda t: F.map_contains_key(of, t))
    fit = F.filter(F.flatten(F.transform(known, lambda t: F.element_at(of, t))), lambda r: F.startswith(path, r["path"]))
    best = F.array_max(F.transform(fit, lambda r: F.struct(r["size"].alias("size"), r["host_size"].alias("host_size"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    return best


def shape_of(path: Column) -> Column:
    """The path's segments, joined by '/', numbers and hex ids as wildcards; empty segments do not count."""
    parts = F.filter(F.split(path, "/", -1), lambda s: s != "")
    shaped = F.transform(parts, lambda s: F.regexp_replace(F.regexp_replace(s, r"^[0-9]+(\.[A-Za-z]{1,5})?$", "<n>$1"), r"^[0-9a-fA-F-]{8,}$", "<h>"))
    return F.coalesce(F.array_join(shaped, "/"), F.lit(""))


def _parted(counts: DataFrame, at: list[str]) -> DataFrame:
    """counts (at..., cn, ca, k, g) with parts g that are not alike cut in two where that explains most; cut tells which were."""
    whole = W.partitionBy(*at, "g")
    x = counts.withColumns({"n": F.sum(F.col("cn") * F.col("k")).over(whole), "a": F.sum(F.col("ca") * F.col("k")).over(whole), "df": F.sum("k").over(whole) - 1})
    p = F.col("a").cast("double") / F.col("n")
    mixed = (F.col("df") > 0) & (F.col("a") > 0) & (F.col("a") < F.col("n"))
    off = F.col("ca") - F.col("cn") * p
    x = x.withColumn("x2", F.sum(F.when(mixed, F.col("k") * off * off / (F.col("cn") * p * (F.lit(1.0) - p)))).over(whole))
    spread = F.lit(2.0) / (F.lit(9.0) * F.col("df"))
    far = (F.pow(F.col("x2") / F.col("df"), F.lit(1.0 / 3.0)) - (F.lit(1.0) - spread)) / F.sqrt(spread)
    x = x.withColumn("cut", F.coalesce(F.when(mixed, far > Z), F.lit(False)))
    order = whole.orderBy(F.col("ca").cast("double") / F.col("cn"), "cn")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumns({"rn": F.row_number().over(order), "un": F.sum(F.col("cn") * F.col("k")).over(upto), "ua": F.sum(F.col("ca") * F.col("k")).over(upto)})
    gap = F.col("ua").cast("double") * F.col("n") - F.col("un").cast("double") * F.col("a")
    told = F.when(F.col("un") < F.col("n"), gap * gap / (F.col("un").cast("double") * (F.col("n") - F.col("un"))))
    x = x.withColumn("best", F.max(F.when(told.isNotNull(), F.struct(told.alias("b"), (-F.col("rn")).alias("r")))).over(whole))
    side = F.when(F.col("rn") <= -F.col("best.r"), "0").otherwise("1")
    return x.select(*at, "cn", "ca", "k", F.when(F.col("cut"), F.concat("g", side)).otherwise(F.col("g")).alias("g"), "cut")


def merged(ws: Workspace, child: DataFrame, at: list[str]) -> DataFrame:
    """(at..., cn, ca, g, tn, ta, branches): for the counts that labelled branches of a node have, their merged branch, its sums and how many it merges."""
    counts = child.where("cn > 0").groupBy(*at, "cn", "ca").agg(F.count("*").alias("k")).withColumn("g", F.lit(""))
    parts = ws.write(_parted(counts, at), "parts")
    while not parts.where("cut").isEmpty():
        old, parts = parts, ws.write(_parted(parts.drop("cut"), at), "parts")
        ws.drop(old)
    whole = W.partitionBy(*at, "g")  # the names of parts sort as their shares do
    number = F.dense_rank().over(W.partitionBy(*at).orderBy("g")) - 1
    return parts.select(*at, "cn", "ca", number.alias("number"), F.sum(F.col("cn") * F.col("k")).over(whole).alias("tn"), F.sum(F.col("ca") * F.col("k")).over(whole).alias("ta"), F.sum("k").over(whole).alias("branches")).withColumnRenamed("number", "g")


def _split(ws: Workspace, tree: DataFrame) -> DataFrame:
    """tree (host, shape, n, a, t, p, hn, ha, left), split until no node disagrees; left: what of shape is below t."""
    done, at = [], ["host", "t"]
    while True:
        more = F.when(F.col("left") != "", F.split("left", "/", -1))
        nodes = tree.where((F.col("ha") > 0) & (F.col("ha") < F.col("hn"))).groupBy(*at).agg(F.min(more).alias("lo"), F.max(more).alias("hi")).where(F.col("lo").isNotNull())
        # what the least and the greatest path share, all share; if nothing, one segment is a level
        same = F.size(F.filter(F.transform("lo", lambda s, i: F.slice("lo", F.lit(1), i + 1) == F.slice("hi", F.lit(1), i + 1)), lambda x: x))
        nodes = ws.write(nodes.select(*at, F.greatest(same, F.lit(1)).alias("take")), "nodes")
        if nodes.isEmpty():
            break
        going = tree.join(nodes, at, "left").withColumn("take", F.when(F.col("left") != "", F.col("take")))
        done.append(ws.write(going.where("take IS NULL").drop("take"), "done"))
        parts = F.split("left", "/", -1)
        cut = going.where("take IS NOT NULL").withColumns({"head": F.array_join(F.slice(parts, F.lit(1), F.col("take")), "/"), "left": F.array_join(F.slice(parts, F.col("take") + 1, F.greatest(F.size(parts) - F.col("take"), F.lit(0))), "/")})
        cut = ws.write(cut.drop("take"), "cut")
        child = ws.write(cut.groupBy(*at, "head").agg(F.sum("n").alias("cn"), F.sum("a").alias("ca")), "children")
        name = F.when(F.col("branches") == 1, F.col("head")).when(F.col("g").isNotNull(), F.concat(F.lit("*"), F.col("g").cast("string"))).otherwise("*")
        to = ws.write(child.join(ws.write(merged(ws, child, at), "merged"), [*at, "cn", "ca"], "left").select(*at, "head", F.concat("t", F.lit("/"), name).alias("to"), F.coalesce("tn", F.lit(0)).alias("tn"), F.coalesce("ta", F.lit(0)).alias("ta")), "named")
        below = cut.join(to, [*at, "head"])
        p = F.when(F.col("tn") == F.col("hn"), F.col("p")).otherwise((F.col("ta") + KAPPA * F.col("p")) / (F.col("tn") + KAPPA))
        old, tree = tree, ws.write(below.select("host", "shape", "n", "a", F.col("to").alias("t"), p.alias("p"), F.col("tn").alias("hn"), F.col("ta").alias("ha"), "left"), "deeper")
        ws.drop(old, cut, child, to)
    for d in done:
        tree = tree.unionByName(d)
    return tree


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, template, n_labelled, n_allowed) for every row.

    Null urls and urls without '://' have empty host and path and are judged by
    the tree as such.  Repeated rows and null ids are kept row by row; no rows,
    or no labelled rows, are fine (purity is then one half and allows).  Other
    columns are not looked at.
    """
    ws = Workspace(pages.sparkSession, "urls")
    base = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    host, path = host_and_path(F.col("url"))
    base = base.select("page_id", host.alias("host"), path.alias("path"))
    base = base.select("*", fitting_rule(F.col("host"), F.col("path"), rules).alias("best"), shape_of(F.col("path")).alias("shape"))
    paths = ws.write(base.groupBy("host", "shape").agg(F.count("best.rule").alias("n"), F.count_if(F.col("best.verdict") == "allow").alias("a")), "paths")
    total = float(paths.agg((F.coalesce(F.sum("a"), F.lit(0)) + 1.0) / (F.coalesce(F.sum("n"), F.lit(0)) + 2.0)).first()[0])
    hosts = ws.write(paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("a").alias("ha")), "hosts")
    tree = paths.join(hosts, "host").select("host", "shape", "n", "a", F.lit("").alias("t"), ((F.col("ha") + KAPPA * F.lit(total)) / (F.col("hn") + KAPPA)).alias("p"), "hn", "ha", F.col("shape").alias("left"))
    last = _split(ws, ws.write(tree, "tree")).select("host", "shape", "t", "p", "hn", "ha")
    judged = base.join(last, ["host", "shape"], "left")
    by_tree = F.when(F.col("p") < CUT, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", by_tree).alias("verdict"), F.col("t").alias("template"), F.col("hn").alias("n_labelled"), F.col("ha").alias("n_allowed"))


def filter_sql(rules: list[tuple[str, str, str]] = RULES, levels: int = 4, rounds: int = 3) -> str:
    """The same query over the table pages, for DuckDB, as long as nodes that disagree have at most `levels` levels and their branches are parted in at most `rounds` rounds."""
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1] + r[2]))
    fits = lambda h, p: f"(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')"
    shaped = "list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: regexp_replace(regexp_replace(x, '^[0-9]+(\\.[A-Za-z]{1,5})?$', '<n>\\1'), '^[0-9a-fA-F-]{8,}$', '<h>'))"
    out = f"""WITH cut AS MATERIALIZED (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
named AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UP}', '{_LOW}'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
base AS MATERIALIZED (SELECT *, {shaped} AS segs, CASE {" ".join(f"WHEN {fits(h, p)} THEN '{h + p}'" for _, h, p in order)} END AS rule, CASE {" ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in order)} END AS said FROM named),
paths AS MATERIALIZED (SELECT host, segs, count(rule) AS n, count(*) FILTER (said = 'allow') AS a FROM base GROUP BY ALL),
hosts AS MATERIALIZED (SELECT host, sum(n)::BIGINT AS hn, sum(a)::BIGINT AS ha FROM paths GROUP BY ALL),
tree0 AS MATERIALIZED (SELECT paths.*, hn, ha, '' AS t, FALSE AS ended, (ha + {KAPPA}::DOUBLE * (SELECT (coalesce(sum(a), 0)::BIGINT + 1.0::DOUBLE) / (coalesce(sum(n), 0)::BIGINT + 2.0::DOUBLE) FROM paths)) / (hn + {KAPPA}::DOUBLE) AS p FROM paths JOIN hosts USING (host))"""
    for d in range(1, levels + 1):
        out += f""",
going{d} AS MATERIALIZED (SELECT *, segs[{d}] AS head FROM tree{d - 1} WHERE NOT ended AND ha > 0 AND ha < hn AND len(segs) >= {d}),
child{d} AS MATERIALIZED (SELECT host, t, head, sum(n)::BIGINT AS cn, sum(a)::BIGINT AS ca FROM going{d} GROUP BY ALL),
part{d}_0 AS MATERIALIZED (SELECT host, t, cn, ca, count(*) AS k, '' AS g FROM child{d} WHERE cn > 0 GROUP BY host, t, cn, ca)"""
        for r in range(1, rounds + 1):
            p, off = "(a::DOUBLE / n)", "(ca - cn * (a::DOUBLE / n))"
            spread = "(2.0::DOUBLE / (9.0::DOUBLE * df))"
            out += f""",
sum{d}_{r} AS (SELECT *, sum(cn * k) OVER w::BIGINT AS n, sum(ca * k) OVER w::BIGINT AS a, sum(k) OVER w::BIGINT - 1 AS df, row_number() OVER o AS rn, sum(cn * k) OVER u::BIGINT AS un, sum(ca * k) OVER u::BIGINT AS ua FROM part{d}_{r - 1} WINDOW w AS (PARTITION BY host, t, g), o AS (PARTITION BY host, t, g ORDER BY ca::DOUBLE / cn, cn), u AS (PARTITION BY host, t, g ORDER BY ca::DOUBLE / cn, cn ROWS UNBOUNDED PRECEDING)),
chi{d}_{r} AS (SELECT *, sum(CASE WHEN df > 0 AND a > 0 AND a < n THEN k * {off} * {off} / (cn * {p} * (1.0::DOUBLE - {p})) END) OVER w AS x2, max(CASE WHEN un < n THEN row((ua::DOUBLE * n - un::DOUBLE * a) * (ua::DOUBLE * n - un::DOUBLE * a) / (un::DOUBLE * (n - un)), -rn) END) OVER w AS best FROM sum{d}_{r} WINDOW w AS (PARTITION BY host, t, g)),
part{d}_{r} AS MATERIALIZED (SELECT host, t, cn, ca, k, CASE WHEN coalesce((pow(x2 / df, 1.0::DOUBLE / 3.0::DOUBLE) - (1.0::DOUBLE - {spread})) / sqrt({spread}) > {Z}::DOUBLE, FALSE) THEN g || CASE WHEN rn <= -best[2] THEN '0' ELSE '1' END ELSE g END AS g FROM chi{d}_{r})"""
        out += f""",
merged{d} AS (SELECT host, t, cn, ca, dense_rank() OVER (PARTITION BY host, t ORDER BY g) - 1 AS g, sum(cn * k) OVER w AS tn, sum(ca * k) OVER w AS ta, sum(k) OVER w AS branches FROM part{d}_{rounds} WINDOW w AS (PARTITION BY host, t, g)),
named{d} AS MATERIALIZED (SELECT c.host, c.t, head, CASE WHEN branches = 1 THEN head WHEN g IS NOT NULL THEN '*' || g::BIGINT ELSE '*' END AS name, coalesce(tn, 0)::BIGINT AS tn, coalesce(ta, 0)::BIGINT AS ta FROM child{d} c LEFT JOIN merged{d} USING (host, t, cn, ca)),
tree{d} AS MATERIALIZED (SELECT host, segs, n, a, tn AS hn, ta AS ha, t || '/' || name AS t, FALSE AS ended, CASE WHEN tn = hn THEN p ELSE (ta + {KAPPA}::DOUBLE * p) / (tn + {KAPPA}::DOUBLE) END AS p FROM going{d} JOIN named{d} USING (host, t, head)
 UNION ALL SELECT host, segs, n, a, hn, ha, t, TRUE, p FROM tree{d - 1} WHERE ended OR NOT (ha > 0 AND ha < hn AND len(segs) >= {d}))"""
    return out + f"""
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN p < {CUT} THEN 'block' ELSE 'allow' END) AS verdict, t AS template, hn AS n_labelled, ha AS n_allowed FROM base JOIN tree{levels} USING (host, segs)"""
