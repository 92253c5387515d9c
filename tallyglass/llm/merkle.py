"""Merkle manifest of a dataset: stored every few levels, with proofs whose missing levels are worked out again.

Each row is a leaf. The leaves of a language, by ascending ``doc_id``, are hashed together by runs of ``FAN`` until one node is left, its
subroot; the subroots, ordered by language, likewise give the root. Of the levels between, only every ``STRIDE``-th is stored. A proof goes
from the root down: each stored node is joined with the up to ``FAN ** STRIDE`` stored nodes below it, from which the levels between are made
again; what a node needs of them, the hashes beside its way up, is given out and the rest is dropped.

No step holds more than one such aligned subtree, so a language may have any share of the rows. Positions come from a range-partitioned sort
and the number of rows before each partition.

Defined cases: any column may be null; a null ``doc_id`` comes first in its language and a null language before the others; rows that
repeat an id are leaves each, ordered by their hash; a single leaf is the subroot itself, a single subroot the root; an empty table gives
an empty manifest without a root; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, scratch

#: Nodes of a run; levels from one stored level to the next.
FAN, STRIDE = 8, 3
SPAN = FAN**STRIDE
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: One level of a way up: the hashes of a run on either side of the own node.
STEP = "struct<left:string,right:string>"


def leaf(*fields: Column) -> Column:
    """SHA-256 over the fields, each as its number of UTF-8 bytes, a colon and its text, or as a dash if it is null."""
    each = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*each).cast("binary"), 256)


def _positioned(rows: DataFrame, path: str, key: str, order: list[str]) -> DataFrame:
    """``rows``, which are stored, with their position from 0 (``pos``) among those of equal ``key`` and the number of those (``total``)."""
    spark = rows.sparkSession
    rows.repartitionByRange(partitions(spark), key, *order).sortWithinPartitions(key, *order).withColumn("at", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path).withColumn("part", F.shiftright("at", 33))
    first = rows.groupBy("part", key).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = first.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy(key))).drop("n")
    return rows.join(first, ["part", key]).withColumn("pos", F.col("before") + F.col("at") - F.col("first")).drop("part", "at", "first", "before")


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _up(nodes: str) -> Column:
    """One level up from an array of hashes."""
    n = F.size(nodes)
    return F.transform(F.sequence(F.lit(0), F.floor((n - 1) / FAN).cast("int")), lambda k: F.sha2(F.array_join(F.slice(nodes, k * FAN + 1, FAN), "").cast("binary"), 256))


def _subtrees(level: DataFrame, key: str, *more: str) -> DataFrame:
    """The aligned subtrees of a stored level, with all their inner levels: arrays ``n0`` (the stored nodes), ``n1`` .. and their height."""
    t = level.groupBy(key, F.floor(F.col("pos") / SPAN).alias("block"), "total").agg(F.sort_array(F.collect_list(F.struct("pos", "hash", *more))).alias("nodes"))
    height = F.lit(STRIDE)
    for k in reversed(range(STRIDE)):
        height = F.when(F.col("total") <= FAN**k, k).otherwise(height)
    t = t.withColumn("height", height).withColumn("n0", F.transform("nodes", lambda x: x["hash"]))
    for k in range(STRIDE):
        t = t.withColumn(f"n{k + 1}", F.when(F.col("height") > k, _up(f"n{k}")).otherwise(F.col(f"n{k}")))
    return t


def _tree(level: DataFrame, key: str, largest: int, path: str) -> list[DataFrame]:
    """The stored levels from ``level(key, pos, total, hash)``, each with at most a ``SPAN``-th of the one below, to the one of single nodes."""
    levels = [level]
    while largest > 1:
        t = _subtrees(levels[-1], key)
        total = F.ceil(F.col("total") / F.pow(F.lit(float(FAN)), "height")).cast("long")
        levels.append(_stored(t.select(key, F.col("block").alias("pos"), total.alias("total"), F.get(f"n{STRIDE}", F.lit(0)).alias("hash")), f"{path}-{len(levels)}"))
        largest = -(-largest // SPAN)
    return levels


def _ways(levels: list[DataFrame], key: str, top: DataFrame, below: list[str], above: list[str]) -> DataFrame:
    """From ``top(key, path, *above)``, the ways up of the single nodes, to those of the first level with its columns ``below``: level by level,
    each subtree meets the way of its own node."""
    way = top.withColumn("pos", F.lit(0).cast("long"))
    for depth in reversed(range(len(levels))):
        more = below if depth == 0 else []
        if depth == len(levels) - 1:  # single nodes
            way = levels[depth].select(key, "pos", "hash", *more).join(way, [key, "pos"])
            continue
        t = _subtrees(levels[depth], key, *more).join(way.select(key, F.col("pos").alias("block"), "path", *above), [key, "block"])

        def steps(i: Column) -> Column:
            found = []
            for k in range(STRIDE):
                at = F.floor(i / FAN**k).cast("int")
                place = F.pmod(at, F.lit(FAN))
                left, right = F.slice(f"n{k}", at - place + 1, place), F.slice(f"n{k}", at + 2, FAN - 1 - place)
                found.append(F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right")))
            return F.slice(F.array(*found), F.lit(1), F.col("height"))

        nodes = F.transform("nodes", lambda x, i: F.struct(x.alias("node"), F.concat(steps(i), F.col("path")).alias("path")))
        way = t.select(key, *above, F.explode(nodes).alias("x")).select(key, *above, "x.node.*", "x.path")
    return way


@dataclass
class Manifest:
    """Stored levels: of the languages' trees over ``doc_id, seen`` (leaves first), and of the tree over the subroots."""

    levels: list[DataFrame]
    top: list[DataFrame]

    @property
    def root(self) -> str | None:
        found = self.top[-1].select("hash").first()
        return found and found[0]

    def proofs(self, wanted: DataFrame | None = None) -> DataFrame:
        """``doc_id, leaf, seen, subroot, root, path`` of the documents, or of those in ``wanted(doc_id)``, whose subtrees alone are made again.

        ``path`` has for each level, from the leaf to the root, the hashes beside the way up."""
        ends = self.top[-1].select(F.lit(0).alias("all"), F.col("hash").alias("root"), F.array().cast(f"array<{STEP}>").alias("path"))
        langs = _ways(self.top, "all", ends, ["lang"], ["root"]).select("lang", "root", "path", F.col("hash").alias("subroot"))
        leaves = self.levels[0]
        if wanted is not None:
            ids = wanted.select("doc_id").distinct()
            leaves = leaves.withColumn("block", F.floor(F.col("pos") / SPAN))
            leaves = leaves.join(leaves.join(ids, "doc_id", "left_semi").select("lang", "block").distinct(), ["lang", "block"], "left_semi").drop("block")
        found = _ways([leaves, *self.levels[1:]], "lang", langs, ["doc_id", "seen"], ["root", "subroot"])
        found = found.select("doc_id", F.col("hash").alias("leaf"), "seen", "subroot", "root", "path")
        return found if wanted is None else found.join(ids, "doc_id", "left_semi")


def build(docs: DataFrame, seen: Column | None = None) -> Manifest:
    """The manifest of ``docs``. ``seen`` is a text to hold against it, such as that of a later copy; its leaf is kept beside the row's own."""
    path = scratch(docs.sparkSession, "merkle")
    ids = [F.col("doc_id").cast("long"), *map(F.col, ["source", "lang"]), F.col("n_chars").cast("long")]
    # a text that is seen unchanged is hashed once
    other = F.lit(None).cast("string") if seen is None else F.when(~seen.eqNullSafe(F.col("text")), leaf(*ids, seen))
    # a language as text that is never null and sorts as languages do
    rows = docs.select(ids[0].alias("doc_id"), F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("lang"), leaf(*ids, F.col("text")).alias("hash"), other.alias("seen"))
    leaves = _positioned(_stored(rows, f"{path}-rows"), f"{path}-leaves", "lang", ["doc_id", "hash"])
    levels = _tree(leaves, "lang", leaves.agg(F.max("total")).first()[0] or 0, f"{path}-level")
    subroots = _stored(levels[-1].select("lang", "hash").withColumn("all", F.lit(0)), f"{path}-subroots")
    top = _positioned(subroots, f"{path}-top", "all", ["lang"])
    return Manifest(levels, _tree(top, "all", top.agg(F.max("total")).first()[0] or 0, f"{path}-top-level"))


def folded(start: Column, path: str) -> Column:
    """The root that follows from a leaf and the hashes beside its way up."""
    return F.aggregate(path, start, lambda h, x: F.sha2(F.concat(x["left"], h, x["right"]).cast("binary"), 256))


def audit(docs: DataFrame) -> DataFrame:
    """Proofs of all documents, held against texts of which a third (by a checksum of the id) has its letters A-Z in lower case."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    seen = F.when(hit, F.translate("text", ascii_uppercase, ascii_lowercase)).otherwise(F.col("text"))
    p = build(docs, seen).proofs()
    beside = F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), "")
    p = p.select("doc_id", "leaf", "subroot", "root", F.sha2(beside.cast("binary"), 256).alias("proof_sha256"), folded(F.coalesce("seen", "leaf"), "path").alias("folded_root"))
    return p.withColumn("verified", F.col("folded_root") == F.col("root"))


#: Levels that the SQL text knows: up to 8 ** 8 documents of a language, 8 ** 4 languages.
_LOW, _HIGH = 8, 4


def _level_sql(name: str, key: str, k: int) -> str:
    same = f"{key}, " if key else ""
    return f"""{name}{k + 1} AS MATERIALIZED (SELECT {same}p // {FAN} AS p, (any_value(n) + {FAN - 1}) // {FAN} AS n, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY p)) END AS h,
 list(h ORDER BY p) AS run, any_value(n) > 1 AS more FROM {name}{k} GROUP BY {same}p // {FAN})"""


def _fold_sql(name: str, to: str, key: str, k: int) -> str:
    """The way up from level k: the siblings go to ``s``, the fold of ``f`` to the next level."""
    on = f"d.{key} IS NOT DISTINCT FROM r.{key} AND " if key else ""
    return f"""{to}{k + 1} AS MATERIALIZED (SELECT d.* EXCLUDE (p, s, f), d.p // {FAN} AS p, s || CASE WHEN more THEN left_ || right_ ELSE '' END AS s, CASE WHEN more THEN sha256(left_ || f || right_) ELSE f END AS f
 FROM (SELECT d.*, r.more, array_to_string(r.run[1:d.p % {FAN}], '') AS left_, array_to_string(r.run[d.p % {FAN} + 2:], '') AS right_ FROM {to}{k} d JOIN {name}{k + 1} r ON {on}r.p = d.p // {FAN}) d)""".replace("EXCLUDE (p, s, f)", "EXCLUDE (p, s, f, more, left_, right_)")


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen(({x})::VARCHAR) || ':' || ({x})::VARCHAR, '-')" for x in [*FIELDS[:-1], text]) + ")"


SQL = ",\n".join(
    [
        """WITH crc AS (SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t FROM range(256) r(b)),
ids AS (SELECT d.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 3 = 0 AS hit FROM documents d, crc),
leaves AS MATERIALIZED (SELECT doc_id, lang, """
        + _leaf_sql("text")
        + " AS h, "
        + _leaf_sql(f"CASE WHEN hit THEN translate(text, '{ascii_uppercase}', '{ascii_lowercase}') ELSE text END")
        + " AS f FROM ids)",
        "a0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS p, count(*) OVER (PARTITION BY lang) AS n FROM leaves)",
        *(_level_sql("a", "lang", k) for k in range(_LOW)),
        f"b0 AS MATERIALIZED (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS p, count(*) OVER () AS n FROM a{_LOW})",
        *(_level_sql("b", "", k) for k in range(_HIGH)),
        "c0 AS (SELECT doc_id, lang, h AS leaf, p, '' AS s, f FROM a0)",
        *(_fold_sql("a", "c", "lang", k) for k in range(_LOW)),
        f"e0 AS (SELECT c.doc_id, c.leaf, b0.h AS subroot, b0.p AS p, c.s, c.f FROM c{_LOW} c JOIN b0 ON c.lang IS NOT DISTINCT FROM b0.lang)",
        *(_fold_sql("b", "e", "", k) for k in range(_HIGH)),
    ]
) + f"\nSELECT doc_id, leaf, subroot, b{_HIGH}.h AS root, sha256(s) AS proof_sha256, f AS folded_root, f = b{_HIGH}.h AS verified FROM e{_HIGH}, b{_HIGH}"
