"""Not-modified revisits of a crawl, resolved to the response they stand for.

A revisit (status 304) is joined to the latest earlier full response of the same canonical URL. If the validators agree (entity tags
by weak comparison, else equal last-modified dates), it takes over that response's body and headers, updated by those of its own
headers that a 304 may change.

Records: ``record_id, url, ts`` (seconds), ``kind`` (response or revisit), ``etag, last_modified, headers`` (map), ``payload`` (a digest or
reference). The as-of join runs in two steps, so that one very frequent URL does not end in one task: inside spans of time, then
from the last response of the spans before.

Defined cases: a revisit without an earlier response has outcome ``no_response``, one without a common validator ``no_validator``;
a null URL has none earlier; earlier means smaller (ts, record_id); repeated records resolve alike; null headers are empty;
null ``ts`` sorts first; of header names that differ in letter case only, the spelling that sorts last counts; records of equal (ts,
record_id) are ordered by Spark, revisits before or after responses of that place alike; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers of a 304 that replace those of the stored response.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
SPAN = 21_600


def canonical(url: Column) -> Column:
    """Host in lower case without www and default port, path without a slash at the end, sorted query without tracking fields; scheme and fragment dropped."""
    u = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(u, "^([^/?]*)", 1)), "^www[0-9]*\\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(u, "^[^/?]*([^?]*)", 1), "/+$", "")
    fields = F.array_sort(F.filter(F.split(F.regexp_extract(u, "\\?(.*)$", 1), "&"), lambda x: (x != "") & ~x.rlike("^(utm_[a-z]+|ref)(=|$)")))
    return F.concat(host, path, F.when(F.size(fields) > 0, F.concat(F.lit("?"), F.array_join(fields, "&"))).otherwise(""))


def strong(etag: Column) -> Column:
    return F.regexp_replace(F.trim(etag), "^W/", "")


def lower_names(headers: Column) -> Column:
    """The map with names in lower case; of names that differ in case only, the spelling that sorts last gives the value."""
    own = F.map_entries(F.coalesce(headers, F.expr("cast(map() as map<string,string>)")))
    spelt, each = F.array_sort(own), F.transform(own, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.array_distinct(F.transform(each, lambda e: e["key"]))
    last = F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(spelt, lambda e: F.lower(e["key"]) == n), -1)["value"]))
    return F.when(F.size(names) < F.size(each), last).otherwise(F.map_from_entries(each))


def resolve(records: DataFrame, span: int = SPAN) -> DataFrame:
    """``record_id, url_key, base_id, outcome, headers, payload`` for every revisit."""
    url_key = canonical(F.col("url"))
    # records without a URL have nobody to meet and each a group of its own
    group = F.coalesce(url_key, F.concat(F.lit("\0"), F.coalesce(F.col("record_id").cast("string"), F.lit(""))))
    r = records.select("record_id", url_key.alias("url_key"), group.alias("group"), "ts", F.floor(F.col("ts") / span).alias("span"), "kind", "etag", "last_modified", lower_names(F.col("headers")).alias("headers"), "payload")
    full = F.when(F.col("kind") == "response", F.struct("record_id", "etag", "last_modified", "headers", "payload"))
    near = Window.partitionBy("group", "span").orderBy("ts", "record_id")
    inside = r.withColumn("base", F.last(full, ignorenulls=True).over(near))
    ends = r.filter("url_key IS NOT NULL").groupBy("url_key", "span").agg(F.max_by(full, F.when(F.col("kind") == "response", F.struct("ts", "record_id"))).alias("end"))
    before = ends.withColumn("end", F.last("end", ignorenulls=True).over(Window.partitionBy("url_key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.filter("end IS NOT NULL").select(F.col("url_key").alias("k"), F.col("span").alias("s"), "end")
    v = inside.filter("kind = 'revisit'").join(before, (F.col("url_key") == F.col("k")) & F.col("span").eqNullSafe(F.col("s")), "left")
    v = v.withColumn("base", F.when(F.col("url_key").isNotNull(), F.coalesce("base", "end")))
    same = F.when(F.col("etag").isNotNull() & F.col("base.etag").isNotNull(), strong(F.col("etag")) == strong(F.col("base.etag"))).otherwise(F.col("last_modified") == F.col("base.last_modified"))
    outcome = F.when(F.col("base").isNull(), "no_response").when(same.isNull(), "no_validator").when(same, "resolved").otherwise("validator_mismatch")
    v = v.withColumn("outcome", outcome)
    own = F.map_filter("headers", lambda k, x: k.isin(PERMITTED))
    merged = F.map_concat(F.map_filter("base.headers", lambda k, x: ~F.map_contains_key(own, k)), own)
    ok = F.col("outcome") == "resolved"
    return v.select("record_id", "url_key", F.when(ok, F.col("base.record_id")).alias("base_id"), "outcome", F.when(ok, merged).alias("headers"), F.when(ok, F.col("base.payload")).alias("payload"))


def records_of(pages: DataFrame) -> DataFrame:
    """A crawl's records made from pages: each page's response, a changed second one for some, and revisits with agreeing, weak, other and missing validators, some before any response."""
    p = pages.select("page_id", "url", F.md5("html").alias("d"), (F.lit(1_700_000_000) + F.pmod("page_id", F.lit(997)) * 3600).alias("t"))
    q = lambda s: F.concat(F.lit('"'), s, F.lit('"'))
    none = F.lit(None).cast("string")

    def record(k, kind, url, ts, etag, modified, headers, payload, when):
        names = F.map_from_arrays(F.array(*[F.lit(n) for n, _ in headers]), F.array(*[x for _, x in headers]))
        return F.when(when, F.struct((F.col("page_id") * 8 + k).alias("record_id"), url.alias("url"), ts.cast("long").alias("ts"), F.lit(kind).alias("kind"), etag.alias("etag"), modified.alias("last_modified"), names.alias("headers"), payload.alias("payload")))

    pid, url, t, d, second = F.col("page_id"), F.col("url"), F.col("t"), F.col("d"), F.md5(F.concat("d", F.lit("2")))
    text, base = (lambda x: x.cast("string")), lambda e, x: [("Content-Type", F.lit("text/html")), ("Content-Length", F.lit("100")), ("ETag", e), ("Date", text(x)), ("Server", F.lit("s"))]
    again = lambda x: [("Date", text(x)), ("Cache-Control", F.lit("max-age=60")), ("Content-Length", F.lit("0")), ("X-Cache", F.lit("hit"))]
    bare = F.regexp_replace(url, "#.*$", "")
    marked = F.concat(bare, F.when(F.instr(bare, "?") > 0, "&").otherwise("?"), F.lit("utm_source=again#x"))
    every = [
        record(0, "response", url, t, q(d), text(t - 60), base(q(d), t), d, F.lit(True)),
        record(1, "revisit", marked, t + 7200, q(d), text(t - 60), again(t + 7200), none, F.lit(True)),
        record(2, "response", url, t + 40_000, q(second), text(t + 30_000), base(q(second), t + 40_000), second, F.pmod(pid, F.lit(4)) == 0),
        record(3, "revisit", url, t + 90_000, F.concat(F.lit("W/"), q(second)), none, again(t + 90_000), none, F.pmod(pid, F.lit(2)) == 0),
        record(4, "revisit", url, t + 95_000, none, text(t - 60), again(t + 95_000), none, F.pmod(pid, F.lit(3)) == 0),
        record(5, "revisit", url, t + 99_000, none, none, again(t + 99_000), none, F.pmod(pid, F.lit(5)) == 0),
        record(6, "revisit", url, t - 500, q(d), none, again(t - 500), none, F.pmod(pid, F.lit(7)) == 0),
    ]
    return p.select(F.inline(F.array_compact(F.array(*every))))


def query(pages: DataFrame) -> DataFrame:
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return resolve(records_of(pages)).select("record_id", F.expr("record_id div 8").alias("page_id"), "url_key", "base_id", "outcome", F.array_join(lines, "\n").alias("headers"), F.col("payload").alias("payload_md5"))


SQL = r"""
WITH p AS (SELECT page_id, url, md5(html) AS d, 1700000000 + (page_id % 997) * 3600 AS t, regexp_replace(url, '#.*$', '') AS bare FROM pages),
x AS (SELECT *, md5(d || '2') AS d2, bare || CASE WHEN contains(bare, '?') THEN '&' ELSE '?' END || 'utm_source=again#x' AS marked FROM p),
r AS (
 SELECT page_id * 8 AS record_id, url, t AS ts, 'response' AS kind, '"' || d || '"' AS etag, (t - 60)::VARCHAR AS lm, d AS payload FROM x
 UNION ALL SELECT page_id * 8 + 1, marked, t + 7200, 'revisit', '"' || d || '"', (t - 60)::VARCHAR, NULL FROM x
 UNION ALL SELECT page_id * 8 + 2, url, t + 40000, 'response', '"' || d2 || '"', (t + 30000)::VARCHAR, d2 FROM x WHERE page_id % 4 = 0
 UNION ALL SELECT page_id * 8 + 3, url, t + 90000, 'revisit', 'W/"' || d2 || '"', NULL, NULL FROM x WHERE page_id % 2 = 0
 UNION ALL SELECT page_id * 8 + 4, url, t + 95000, 'revisit', NULL, (t - 60)::VARCHAR, NULL FROM x WHERE page_id % 3 = 0
 UNION ALL SELECT page_id * 8 + 5, url, t + 99000, 'revisit', NULL, NULL, NULL FROM x WHERE page_id % 5 = 0
 UNION ALL SELECT page_id * 8 + 6, url, t - 500, 'revisit', '"' || d || '"', NULL, NULL FROM x WHERE page_id % 7 = 0),
u AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://', '') AS b FROM r),
c AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(b, '^([^/?]*)', 1)), '^www[0-9]*\.', ''), ':(80|443)$', '') || regexp_replace(regexp_extract(b, '^[^/?]*([^?]*)', 1), '/+$', '') AS hp,
  list_sort(list_filter(string_split(regexp_extract(b, '\?(.*)$', 1), '&'), lambda f: f <> '' AND NOT regexp_matches(f, '^(utm_[a-z]+|ref)(=|$)'))) AS q FROM u),
k AS (SELECT *, hp || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url_key FROM c),
a AS (SELECT *, last_value(CASE WHEN kind = 'response' THEN {'id': record_id, 'ts': ts, 'etag': etag, 'lm': lm, 'payload': payload} END IGNORE NULLS) OVER (PARTITION BY url_key ORDER BY ts, record_id ROWS UNBOUNDED PRECEDING) AS base FROM k),
o AS (SELECT *, CASE WHEN base IS NULL THEN 'no_response' WHEN etag IS NOT NULL AND base.etag IS NOT NULL THEN CASE WHEN ltrim(regexp_replace(etag, '^W/', '')) = base.etag THEN 'resolved' ELSE 'validator_mismatch' END
  WHEN lm IS NULL OR base.lm IS NULL THEN 'no_validator' WHEN lm = base.lm THEN 'resolved' ELSE 'validator_mismatch' END AS outcome FROM a WHERE kind = 'revisit')
SELECT record_id, record_id // 8 AS page_id, url_key, CASE WHEN outcome = 'resolved' THEN base.id END AS base_id, outcome,
  CASE WHEN outcome = 'resolved' THEN 'cache-control: max-age=60' || chr(10) || 'content-length: 100' || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || ts || chr(10) || 'etag: ' || base.etag || chr(10) || 'server: s' END AS headers,
  CASE WHEN outcome = 'resolved' THEN base.payload END AS payload_md5
FROM o
"""
