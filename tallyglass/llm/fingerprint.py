"""Document fingerprints: bottom-k sketches of shingle hashes, in built-in expressions only.

A text's fingerprint is the ``K`` smallest of the hashes of its distinct five-word shingles, ascending. From two of them follow the
resemblance of the texts (shared shingles over all), the containment of one in the other and the number of distinct shingles; the
fingerprint of a whole is made from those of its parts, if consecutive parts share ``SHINGLE - 1`` words.

Defined cases: a null text is empty and has an empty fingerprint; a text of one to four words has one shingle, all of them; two empty
fingerprints resemble each other by 1, an empty and another one by 0. Documents stand in the order of ``doc_id`` (a null one
first), then of a hash of the text, then of the text: rows that repeat an id follow each other, and the next document of the last row is
the first row (itself, if it is the only one). An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, partitions, texts

#: Hashes of a fingerprint, hexadecimal digits of a hash (48 bits), words of a shingle.
K, DIGITS, SHINGLE = 128, 12, 5
BLANKS = " \t\n\x0b\x0c\r"
#: Ranges of ids for each shuffle partition.
RANGES = 4


def bottom(hashes: Column) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, K)


def with_sketch(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the sketch of a text as array ``name``; a hash is the first digits of an MD5 sum. Each step is a column, so that none is repeated.

    The smallest hashes are looked for among those so small that some ``4 * K`` are expected; where these hold too few, among all.
    """
    plain = F.concat(F.lit(" "), F.regexp_replace(F.btrim(F.col(text), F.lit(BLANKS)), f"{SPACE}+", " "))
    overlapping = F.lit(" (?=(" + " ".join(["[^ ]++"] * SHINGLE) + "))")  # looks ahead from each blank
    d = df.withColumn("_plain", plain).withColumn("_found", F.regexp_extract_all("_plain", overlapping, F.lit(1)))
    few = F.when(F.length("_plain") > 1, F.array(F.substring("_plain", F.lit(2), F.length("_plain")))).otherwise(F.array().cast("array<string>"))
    d = d.withColumn("_hashes", F.transform(F.when(F.size("_found") > 0, F.col("_found")).otherwise(few), lambda x: F.left(F.md5(x.cast("binary")), F.lit(DIGITS)))).drop("_plain", "_found")
    d = d.withColumn("_most", F.when(F.size("_hashes") > 4 * K, F.lpad(F.lower(F.hex((F.lit(4.0 * K * 16**DIGITS) / F.size("_hashes")).cast("long"))), DIGITS, "0")))
    d = d.withColumn("_low", F.when(F.col("_most").isNotNull(), F.array_distinct(F.filter("_hashes", lambda x: x < F.col("_most")))))
    return d.withColumn(name, F.when(F.size("_low") >= K, F.slice(F.sort_array("_low"), 1, K)).otherwise(bottom(F.col("_hashes")))).drop("_hashes", "_most", "_low")


def merged(a: Column, b: Column) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, K)


def resemblance(a: Column, b: Column, both: Column) -> Column:
    """Shared over all distinct shingles: exact below ``K`` of them, else the share among the ``K`` smallest hashes of both (``both``, their merged sketch)."""
    return F.when(F.size(both) == 0, 1.0).otherwise(F.size(F.array_intersect(both, F.array_intersect(a, b))) / F.size(both))


def distinct_shingles(a: Column) -> Column:
    """Exact below ``K``; else estimated from the K-th smallest hash."""
    share = (F.conv(F.element_at(a, K), 16, 10).cast("double") + 1) / float(16**DIGITS)
    return F.when(F.size(a) < K, F.size(a).cast("double")).otherwise((K - 1) / share)


def with_likeness(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """``df`` with the sketch of both texts together as ``{name}_both`` and their resemblance as ``name``."""
    d = df.withColumn(f"{name}_both", merged(F.col(a), F.col(b)))
    return d.withColumn(name, resemblance(F.col(a), F.col(b), F.col(f"{name}_both")))


def containment(a: Column, near: Column, both: Column) -> Column:
    """The share of ``a``'s shingles that the other text has (1 for an empty ``a``), from their resemblance and merged sketch."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(near * distinct_shingles(both) / distinct_shingles(a), F.lit(1.0)))


def merge_by(sketches: DataFrame, key: str, sketch: str = "sketch", parts: int = 64) -> DataFrame:
    """``key, sketch``: one sketch for each value of ``key``, which may hold most of the rows.

    Hashes are made distinct and cut to the ``K`` smallest in each of ``parts`` parts of a key first; at most ``parts * K`` meet in one task.
    """
    h = sketches.select(key, F.explode(sketch).alias("h")).groupBy(key, "h").agg(F.lit(1).alias("one"))
    h = h.withColumn("part", F.pmod(F.xxhash64("h"), F.lit(parts)))
    first = lambda df, *by: df.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).filter(F.col("nth") <= K)
    least = first(first(h, key, "part").drop("nth"), key)
    found = least.groupBy(key).agg(F.sort_array(F.collect_list("h")).alias("sketch"))
    return sketches.select(key).distinct().withColumnRenamed(key, "_key").join(found, F.col("_key").eqNullSafe(F.col(key)), "left").select(F.col("_key").alias(key), F.coalesce("sketch", F.array().cast("array<string>")).alias("sketch"))


def _ranges(d: DataFrame) -> tuple[list[int], int | None]:
    """(ids that exist and begin a range, ascending; the least id, null if a row has none). Their number follows the shuffle partitions."""
    n = RANGES * partitions(d.sparkSession)
    found = d.agg(F.percentile_approx("doc_id", [(k + 1) / (n + 1) for k in range(n)], 20 * n).alias("at"), F.min("doc_id").alias("least"), F.count_if(F.col("doc_id").isNull()).alias("none")).first()
    return sorted(set(found["at"] or []) - {found["least"]}), None if found["none"] else found["least"]


def _range_of(column: str, starts: list[int]) -> Column:
    """The number of starts up to the value; they are looked up in two steps, so that a row meets about twice the root of their number."""
    if not starts:
        return F.lit(0)
    step = max(1, round(len(starts) ** 0.5))
    runs = [starts[k : k + step] for k in range(0, len(starts), step)]
    upto = lambda a: F.size(F.filter(a, lambda x: x <= F.col(column)))
    longs = lambda x: F.array(*[F.lit(y).cast("long") for y in x])
    run = upto(longs([r[0] for r in runs])) - 1
    return F.when(F.col(column).isNull() | (run < 0), 0).otherwise(run * step + upto(F.get(F.array(*map(longs, runs)), run)))


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text, sketch`` of each row and ``next.text, next.sketch`` of the next one.

    Rows move once, to their range of ids. A row that begins a range goes to the range before as well, behind its last row.
    """
    d = texts(docs)
    starts, least = _ranges(d)
    at, last = _range_of("doc_id", starts), len(starts)
    ahead = F.when(F.col("doc_id").eqNullSafe(F.lit(least)), F.array(F.lit(last))).when(F.col("doc_id").isin(starts) if len(starts) <= 64 else F.array_contains(F.array(*[F.lit(s).cast("long") for s in starts]), F.col("doc_id")), F.array(F.col("own") - 1)).otherwise(F.array().cast("array<int>"))
    d = d.withColumn("own", at.cast("int")).select("doc_id", "text", F.explode(F.concat(F.array(F.struct(F.lit(False).alias("ahead"), F.col("own").alias("range"))), F.transform(ahead, lambda r: F.struct(F.lit(True).alias("ahead"), r.alias("range"))))).alias("to"))
    d = d.select("doc_id", "text", "to.ahead", "to.range").repartition(partitions(docs.sparkSession), "range")
    d = with_sketch(d, "text", "sketch")
    order = Window.partitionBy("range").orderBy("ahead", F.asc_nulls_first("doc_id"), F.xxhash64("text"), "text")
    return d.withColumn("next", F.lead(F.struct("text", "sketch")).over(order)).filter("NOT ahead").select("doc_id", "text", "sketch", "next")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, n_shingles`` (an estimate) of every row, without a shuffle."""
    return with_sketch(texts(docs), "text", "sketch").select("doc_id", F.array_join("sketch", "").alias("fingerprint"), distinct_shingles(F.col("sketch")).alias("n_shingles"))


def compare_edited(docs: DataFrame) -> DataFrame:
    """Every text against an edited one, whose last half is replaced by the beginning of the next document, and against that document."""
    d = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.left("text", F.col("n_chars").cast("int") - half), F.left(F.col("next.text"), half))
    d = d.select("doc_id", "n_chars", "sketch", F.col("next.sketch").alias("next_sketch"), edited.alias("edited"))
    d = with_likeness(with_likeness(with_sketch(d, "edited", "edited_sketch"), "sketch", "edited_sketch", "near_edited"), "sketch", "next_sketch", "near_next")
    return d.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.array_join("sketch", "").alias("fingerprint"), F.array_join("edited_sketch", "").alias("edited_fingerprint"),
        "near_edited", "near_next",
        F.round(containment(F.col("sketch"), F.col("near_edited"), F.col("near_edited_both")), 6).alias("kept_share"), F.round(distinct_shingles(F.col("sketch")), 3).alias("n_shingles"),
    )


_SKETCH = rf"""list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] ELSE list_transform(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1),
 lambda i: left(md5(array_to_string(w[i:i + {SHINGLE - 1}], ' ')), {DIGITS})) END))[1:{K}]"""


def _words_sql(t: str) -> str:
    return rf"list_filter(string_split_regex({t}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"


_SIZE = f"(CASE WHEN len({{0}}) < {K} THEN len({{0}})::DOUBLE ELSE {K - 1} / ((('0x' || {{0}}[{K}])::BIGINT::DOUBLE + 1) / {float(16**DIGITS)}) END)"
_ALL = f"list_sort(list_distinct(list_concat({{0}}, {{1}})))[1:{K}]"
_NEAR = f"(CASE WHEN len({_ALL}) = 0 THEN 1.0 ELSE len(list_intersect({_ALL}, list_intersect({{0}}, {{1}}))) / len({_ALL}) END)"

SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, t, {_SKETCH} AS a FROM (SELECT *, {_words_sql("t")} AS w FROM d)),
n AS (SELECT *, coalesce(lead(t) OVER o, first_value(t) OVER o) AS nt, coalesce(lead(a) OVER o, first_value(a) OVER o) AS na FROM s WINDOW o AS (ORDER BY doc_id NULLS FIRST)),
e AS (SELECT doc_id, length(t)::BIGINT AS n_chars, a, na, left(t, (length(t) - length(t) // 2)::BIGINT) || left(nt, (length(t) // 2)::BIGINT) AS edited FROM n),
f AS (SELECT *, {_SKETCH} AS b FROM (SELECT *, {_words_sql("edited")} AS w FROM e))
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, array_to_string(a, '') AS fingerprint, array_to_string(b, '') AS edited_fingerprint,
 {_NEAR.format("a", "b")} AS near_edited, {_NEAR.format("a", "na")} AS near_next,
 round(CASE WHEN len(a) = 0 THEN 1.0 ELSE least(({_NEAR.format("a", "b")}) * {_SIZE.format(_ALL.format("a", "b"))} / {_SIZE.format("a")}, 1.0) END, 6) AS kept_share,
 round({_SIZE.format("a")}, 3) AS n_shingles FROM f
"""
