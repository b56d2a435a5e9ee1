"""Resolution of not-modified revisit records of a web archive.

A revisit (a 304 answer) holds no payload: it is resolved by an as-of join on the
canonical URL to the latest earlier full response.  Validators are checked (ETag
by weak comparison, else Last-Modified), and the response's stored headers are
updated with those of the revisit that may replace them.

The as-of join keeps groups bounded however often one URL occurs: the narrow keys
are range-partitioned by (URL, time, id), so one URL may span many parts; within
a part a window finds the latest full response, and what the parts of a URL end
with, one row each, is carried forward to the parts after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.url_filter import host_and_path
from lectern.llm.workspace import Workspace

#: Query parameters that only track, and headers a 304 must not replace (hop-by-hop ones and those that describe the stored bytes).
TRACKING = ("utm_[A-Za-z]+", "ref", "fbclid", "gclid")
NOT_MERGED = ("connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade", "content-encoding", "content-length", "content-range", "content-type", "content-md5")
_TRACK = f"^({'|'.join(TRACKING)})(=|$)"


def canonical(url: Column) -> Column:
    """Host without www./m. and default port, path without closing slashes, other parameters in order; no scheme, no fragment.  Null without a host."""
    host, path = host_and_path(url)
    host = F.regexp_replace(F.regexp_replace(host, r"^(www|m)\.", ""), r":(80|443)$", "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*\?([^#]*)", 1)
    own = F.array_sort(F.filter(F.split(query, "&", -1), lambda p: (p != "") & ~p.rlike(_TRACK)))
    return F.when(host != "", F.concat(host, F.regexp_replace(path, "/+$", ""), F.when(F.size(own) > 0, F.concat(F.lit("?"), F.array_join(own, "&"))).otherwise("")))


def same_validators(stored: Column, new: Column) -> Column:
    """True, false, or null if the two have no validator in common."""
    weak = lambda h: F.regexp_replace(h["etag"], "^W/", "")
    return F.coalesce(weak(stored) == weak(new), stored["last-modified"] == new["last-modified"])


def merged(stored: Column, new: Column) -> Column:
    """The stored headers, updated with the permitted ones of a 304; names are lower case."""
    may = F.map_filter(new, lambda k, v: ~k.isin(*NOT_MERGED) & v.isNotNull())
    rest = F.map_filter(stored, lambda k, v: ~F.map_contains_key(may, k))
    return F.map_concat(rest, may)


def latest_full(ws: Workspace, keys: DataFrame) -> DataFrame:
    """(canon, ts, record_id, part, before): for every row the struct(ts, record_id) of the latest full row of its URL before it, by (ts, record_id)."""
    laid = ws.write(keys.repartitionByRange("canon", "ts", "record_id").withColumn("part", F.spark_partition_id()), "keys")
    mark = F.when(F.col("full"), F.struct("ts", "record_id"))
    inner = W.partitionBy("canon", "part").orderBy("ts", "record_id").rowsBetween(W.unboundedPreceding, -1)
    near = laid.withColumn("near", F.last(mark, ignorenulls=True).over(inner))
    ends = laid.groupBy("canon", "part").agg(F.max(mark).alias("end"))
    over = W.partitionBy("canon").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row a part
    carried = ends.withColumn("carried", F.last("end", ignorenulls=True).over(over)).where("carried IS NOT NULL").select("canon", "part", "carried")
    return near.join(carried, ["canon", "part"], "left").select("canon", "ts", "record_id", "full", F.coalesce("near", "carried").alias("before"))


def resolve(spark: SparkSession, records: DataFrame) -> DataFrame:
    """Every record with canon, refers_to, state, headers and digest as after resolution.

    records: record_id long, url, ts, kind (response or revisit), status, headers
    map<string, string> with lower-case names, digest (of the payload, null without
    one).  State: full and other (responses), resolved, unchecked (no common
    validator; resolved all the same), mismatch, missing.  A null url, id, time or
    kind matches nothing: state missing for a revisit.  Of rows with equal time
    the smaller id is the earlier; ids should be unique, repeated ones resolve alike.
    """
    ws = Workspace(spark, "revisits")
    full = F.coalesce((F.col("kind") == "response") & (F.col("status") == 200) & F.col("digest").isNotNull(), F.lit(False))
    rows = records.select("record_id", "url", "ts", "kind", "status", F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"), "digest", canonical(F.col("url")).alias("canon"), full.alias("full"))
    rows = ws.write(rows, "records")
    keys = rows.where("canon IS NOT NULL AND ts IS NOT NULL AND record_id IS NOT NULL AND kind IS NOT NULL").select("canon", "ts", "record_id", "full").distinct()
    found = latest_full(ws, keys).where("NOT full AND before IS NOT NULL").select("record_id", F.col("ts").alias("_ts"), F.col("canon").alias("_canon"), F.col("before.record_id").alias("refers_to"))
    stored = rows.where("full").groupBy(F.col("record_id").alias("refers_to"), F.col("canon").alias("_canon")).agg(F.max_by(F.struct("headers", "digest"), F.struct("ts", "digest")).alias("stored"))
    target = found.join(stored, ["refers_to", "_canon"])
    out = rows.alias("r").join(target.alias("t"), (F.col("r.record_id") == F.col("t.record_id")) & (F.col("r.canon") == F.col("t._canon")) & (F.col("r.ts") == F.col("t._ts")) & (F.col("r.kind") == "revisit"), "left")
    same = same_validators(F.col("t.stored.headers"), F.col("r.headers"))
    state = F.when(F.col("r.full"), "full").when(F.coalesce(F.col("r.kind") != "revisit", F.lit(True)), "other").when(F.col("t.refers_to").isNull(), "missing").when(same.isNull(), "unchecked").when(same, "resolved").otherwise("mismatch")
    out = out.select("r.record_id", "r.canon", "r.ts", "r.kind", "r.headers", "r.digest", F.col("t.refers_to"), F.col("t.stored").alias("stored"), state.alias("state"))
    done = F.col("state").isin("resolved", "unchecked")
    return out.select("record_id", "canon", "ts", "kind", "state", F.when(done, F.col("refers_to")).alias("refers_to"), F.when(done, merged(F.col("stored.headers"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"), F.when(done, F.col("stored.digest")).otherwise(F.col("digest")).alias("digest"))


def records_of(pages: DataFrame) -> DataFrame:
    """Archive records derived from a table of pages (page_id, url, html).

    Every page is a full response; every third is visited again some captures
    later, with a 304.  Entity tags come from the canonical URL and the url's
    length, so spellings of one URL may disagree; some revisits have a changed tag,
    and some have none.
    """
    canon = F.coalesce(canonical(F.col("url")), F.lit(""))
    i = F.col("page_id").cast("long")
    version = F.length(F.coalesce("url", F.lit(""))) % 2
    tag = lambda v: F.concat(F.lit('"'), F.substring(F.md5(F.concat(canon, F.lit(":"), v.cast("string"))), 1, 12), F.lit('"'))
    day = F.coalesce(F.pmod(i, F.lit(97)), F.lit(0)).cast("string")
    old = F.create_map(F.lit("etag"), tag(version), F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.coalesce(F.octet_length("html"), F.lit(0)).cast("string"), F.lit("date"), day)
    new = F.create_map(F.lit("content-length"), F.lit("0"), F.lit("date"), day, F.lit("cache-control"), F.lit("max-age=60"))
    tagged = F.map_concat(new, F.create_map(F.lit("etag"), F.concat(F.lit("W/"), tag(version + F.when(i % 5 == 0, 2).otherwise(0)))))
    first = pages.select((2 * i).alias("record_id"), "url", (10 * i).alias("ts"), F.lit("response").alias("kind"), F.lit(200).alias("status"), old.alias("headers"), F.sha2("html", 256).alias("digest"))
    again = pages.where(F.pmod(i, F.lit(3)) == 2).select((2 * i + 1).alias("record_id"), "url", (10 * i + 5 + 10 * F.pmod(i, F.lit(11))).alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), F.when(i % 7 == 0, new).otherwise(tagged).alias("headers"), F.lit(None).cast("string").alias("digest"))
    return first.unionByName(again)


def headers_text(headers: Column) -> Column:
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit(""))))), "; ")


def resolve_sql() -> str:
    """(record_id, canon, kind, state, refers_to, headers, digest) over pages, for DuckDB; unique ids."""
    bare = "'^(www|m)\\.', ''), ':(80|443)$', ''"
    return f"""WITH cut AS (SELECT *, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
named AS (SELECT *, regexp_replace(regexp_replace(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {bare}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, list_sort(list_filter(string_split(regexp_extract(coalesce(url, ''), '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '{_TRACK}'))) AS own FROM cut),
keyed AS MATERIALIZED (SELECT *, CASE WHEN host <> '' THEN host || regexp_replace(path, '/+$', '') || CASE WHEN len(own) > 0 THEN '?' || array_to_string(own, '&') ELSE '' END END AS canon FROM named),
rec AS MATERIALIZED (SELECT 2 * page_id AS id, 10 * page_id AS ts, page_id, canon, false AS again, '"' || substr(md5(coalesce(canon, '') || ':' || (length(coalesce(url, '')) % 2)), 1, 12) || '"' AS tag, octet_length(encode(coalesce(html, ''))) AS n, page_id % 97 AS day, sha256(html) AS digest FROM keyed
UNION ALL SELECT 2 * page_id + 1, 10 * page_id + 5 + 10 * (page_id % 11), page_id, canon, true, CASE WHEN page_id % 7 <> 0 THEN '"' || substr(md5(coalesce(canon, '') || ':' || (length(coalesce(url, '')) % 2 + CASE WHEN page_id % 5 = 0 THEN 2 ELSE 0 END)), 1, 12) || '"' END, 0, page_id % 97, NULL FROM keyed WHERE page_id % 3 = 2),
before_it AS (SELECT *, CASE WHEN again THEN last_value(CASE WHEN digest IS NOT NULL THEN id END IGNORE NULLS) OVER (PARTITION BY canon ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS ref FROM rec),
met AS (SELECT a.*, s.tag AS old_tag, s.n AS old_n, s.digest AS old_digest, CASE WHEN NOT a.again AND a.digest IS NOT NULL THEN 'full' WHEN NOT a.again THEN 'other' WHEN s.id IS NULL THEN 'missing' WHEN a.tag IS NULL THEN 'unchecked' WHEN s.tag = a.tag THEN 'resolved' ELSE 'mismatch' END AS state FROM before_it a LEFT JOIN rec s ON a.ref = s.id AND a.canon = s.canon)
SELECT id AS record_id, canon, CASE WHEN again THEN 'revisit' ELSE 'response' END AS kind, state, CASE WHEN state IN ('resolved', 'unchecked') THEN ref END AS refers_to,
CASE WHEN state IN ('resolved', 'unchecked') THEN 'cache-control: max-age=60; content-length: ' || old_n || '; content-type: text/html; date: ' || day || '; etag: ' || coalesce('W/' || tag, old_tag) WHEN again THEN 'cache-control: max-age=60; content-length: 0; date: ' || day || coalesce('; etag: W/' || tag, '') ELSE 'content-length: ' || n || '; content-type: text/html; date: ' || day || '; etag: ' || tag END AS headers,
CASE WHEN state IN ('resolved', 'unchecked') THEN old_digest ELSE digest END AS digest FROM met"""
