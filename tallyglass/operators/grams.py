"""Inverted indexes over the texts of a catalogue: pieces for substring search, trigrams for similarity; made for one search or stored.

A stored index is a set of tables in the shared folder, partitioned by field and by hash buckets of the gram, under a version that follows
from the catalogue's content. It is built once, read by every search and every micro-batch, and a search whose needles touch few buckets
reads only those. Texts of a catalogue that changed have another version and are indexed anew; the old tables stay until they are deleted.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import trigrams
from ..sources.shared import shared_base

KEY = ["game", "language"]
#: Texts that a bucket of a stored index is made for, and the most buckets. Tasks over which the rows of a bucket are written.
BUCKET_TEXTS, BUCKETS, SPREAD = 50_000, 1024, 8
#: Texts with one trigram from which on its rows are dealt to several tasks.
HOT = 20_000


def stretches(s: Column, n: Column) -> Column:
    """All distinct stretches of n characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - n + 1, F.lit(1))), lambda i: F.substring(s, i, n)))


def hashed_trigrams(s: Column) -> Column:
    return F.transform(trigrams(s), lambda x: F.xxhash64(x))


def by_rarity(texts: DataFrame, counts: DataFrame) -> DataFrame:
    """``*KEY, name, size, grams, place, x, n``: a row for each trigram of a distinct text with its place among all of them, the rarest first."""
    g = texts.select(*KEY, "name", F.explode(hashed_trigrams(F.col("name"))).alias("x")).join(counts, [*KEY, "x"], "left")
    g = g.groupBy(*KEY, "name").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "x"))).alias("s"))
    g = g.select(*KEY, "name", F.size("s").alias("size"), F.transform("s", lambda y: y["x"]).alias("grams"), F.posexplode("s").alias("place", "y"))
    return g.select(*KEY, "name", "size", "grams", (F.col("place") + 1).alias("place"), "y.x", "y.n")


@dataclass
class Texts:
    """The indexed texts of one field. ``buckets`` is 0 for an index that is not stored.

    ``pieces(*KEY, piece, name)`` and their ``piece_counts(*KEY, piece, n)``: stretches of one to three characters of the lower-case text;
    ``postings``: see :func:`by_rarity`; ``counts(*KEY, x, n)``: texts with a trigram."""

    pieces: DataFrame
    piece_counts: DataFrame
    postings: DataFrame
    counts: DataFrame
    buckets: int = 0

    @classmethod
    def of(cls, names: DataFrame) -> Texts:
        """Of ``names(*KEY, name)``, worked out within the search that uses it."""
        n = names.select(*KEY, "name").filter("name <> ''").distinct()
        pieces = n.select(*KEY, F.explode(F.flatten(F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda k: stretches(F.lower("name"), k)))).alias("piece"), "name")
        counts = n.select(*KEY, F.explode(hashed_trigrams(F.col("name"))).alias("x")).groupBy(*KEY, "x").agg(F.count("*").alias("n"))
        return cls(pieces, pieces.groupBy(*KEY, "piece").agg(F.count("*").alias("n")), by_rarity(n, counts), counts)

    def touched(self, needles: DataFrame, gram: str) -> Texts:
        """Of a stored index, only the buckets that the grams of ``needles`` fall into: at most as many numbers as there are buckets are asked for."""
        if self.buckets <= 1:
            return self
        found = [r[0] for r in needles.select(bucket_of(gram, self.buckets)).distinct().collect()]
        own = F.col("bucket").isin(found)
        if gram == "x":
            return Texts(self.pieces, self.piece_counts, self.postings.filter(own), self.counts.filter(own), self.buckets)
        return Texts(self.pieces.filter(own), self.piece_counts.filter(own), self.postings, self.counts, self.buckets)


def bucket_of(gram: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(gram)), F.lit(buckets)).cast("int").alias("bucket")


def _as_texts(texts: DataFrame | Texts) -> Texts:
    return texts if isinstance(texts, Texts) else Texts.of(texts)


def substring_pairs(needles: DataFrame, names: DataFrame | Texts) -> DataFrame:
    """``game, language, needle, name``: needles that occur in names, case ignored.

    Each needle is looked up by its rarest piece of up to three characters; the pieces' counts come from the names.
    """
    index = _as_texts(names)
    needles = needles.select(*KEY, "needle").filter("needle <> ''").distinct()
    own = needles.select(*KEY, "needle", F.explode(stretches(F.lower("needle"), F.least(F.length("needle"), F.lit(3)))).alias("piece"))
    index = index.touched(own, "piece")
    rare = own.join(index.piece_counts.select(*KEY, "piece", "n"), [*KEY, "piece"], "left").groupBy(*KEY, "needle").agg(F.min_by("piece", F.struct("n", "piece")).alias("piece"), F.count_if(F.col("n").isNull()).alias("absent"))
    return rare.filter("absent = 0").join(index.pieces.select(*KEY, "piece", "name"), [*KEY, "piece"]).filter(F.contains(F.lower("name"), F.lower("needle"))).select(*KEY, "needle", "name")


def candidate_pairs(needles: DataFrame, names: DataFrame | Texts, least: float) -> DataFrame:
    """``game, language, needle, name, a, b, c``: each pair of texts of whose trigrams (``a`` and ``b``) enough may be shared, with the number that is (``c``).

    Of two texts whose similarity exceeds ``least``, either shares more than ``least`` of its own trigrams with the other; so leaving out that many of
    each, the most frequent ones, leaves one in common. The first one in common, by rarity, also says how many more there can be, and is where a
    pair is made, once. Rows of a trigram that very many texts have are dealt to several tasks, each of which meets the needles.
    """
    index = _as_texts(names)
    n = needles.select(*KEY, F.col("needle").alias("name")).filter("needle <> ''").distinct()
    index = index.touched(n.select(F.explode(hashed_trigrams(F.col("name"))).alias("x")), "x")
    counts = index.counts.select(*KEY, "x", "n")
    some = F.col("place") <= F.col("size") - F.floor(F.col("size") * least - 1e-9)
    parts = F.ceil(F.greatest("n", F.lit(1)) / HOT).cast("int")
    left = by_rarity(n, counts).filter(some).select(*KEY, "x", F.col("name").alias("needle"), F.col("size").alias("a"), F.col("grams").alias("ga"), F.col("place").alias("i"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    right = index.postings.filter(some).select(*KEY, "x", "name", F.col("size").alias("b"), F.col("grams").alias("gb"), F.col("place").alias("j"), F.pmod(F.xxhash64("name"), parts).cast("int").alias("part"))
    enough = F.least(F.col("a") - F.col("i"), F.col("b") - F.col("j")) + 1 > (F.col("a") + F.col("b")) * (least / (1 + least)) - 1e-9
    both = left.join(right, [*KEY, "x", "part"]).filter(enough).withColumn("both", F.array_intersect("ga", "gb"))
    return both.filter(F.get("both", F.lit(0)) == F.col("x")).select(*KEY, "needle", "name", "a", "b", F.size("both").alias("c"))


def similar_pairs(needles: DataFrame, names: DataFrame | Texts, least: float) -> DataFrame:
    """``game, language, needle, name, sim``: distinct texts whose trigram similarity exceeds ``least``."""
    found = candidate_pairs(needles, names, least).withColumn("sim", F.col("c") / (F.col("a") + F.col("b") - F.col("c")))
    return found.filter(F.col("sim") > least).select(*KEY, "needle", "name", "sim")


def fields(catalog: DataFrame) -> dict[str, DataFrame]:
    """The texts of a catalogue by field; second-language names count for rows of that language."""
    out = {"name": catalog.select(*KEY, "name"), "set_name": catalog.select(*KEY, F.col("set_name").alias("name"))}
    return out | {"name_ja": catalog.filter("language = 'ja'").select(*KEY, F.col("name_ja").alias("name"))}


@dataclass
class Grams:
    """The indexes of a catalogue: its names, second-language names and set names."""

    name: Texts
    name_ja: Texts
    set_name: Texts
    version: str = ""

    @classmethod
    def of(cls, catalog: DataFrame) -> Grams:
        return cls(**{f: Texts.of(t) for f, t in fields(catalog).items()})


def version_of(catalog: DataFrame) -> tuple[str, int]:
    """(a name that follows from the indexed texts of the rows, whatever their order; number of rows)."""
    r = catalog.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(*KEY, "name", "name_ja", "set_name").cast("decimal(38,0)")), F.lit(0))).first()
    return f"{r[0]}_{str(r[1]).replace('-', 'm')}", r[0]


TABLES = ["pieces", "piece_counts", "postings", "counts"]


def stored(catalog: DataFrame, base: str | None = None) -> Grams:
    """The stored index of ``catalog`` below ``base`` (the shared folder), built if this version is not there.

    A build writes to a folder of its own and is named in a mark when it is whole, so one that broke off is not read, and of two at once the
    later counts."""
    spark = catalog.sparkSession
    version, n = version_of(catalog)
    base = f"{(base or shared_base(spark)).rstrip('/')}/grams"
    buckets = min(BUCKETS, 1 << max(0, -(-n // BUCKET_TEXTS) - 1).bit_length())
    try:
        path = spark.read.text(f"{base}/{version}").first()[0]
    except AnalysisException:
        path = f"{base}/tables-{uuid.uuid4().hex}"
        built = {f: Texts.of(t) for f, t in fields(catalog).items()}
        for name in TABLES:
            gram = "piece" if name.startswith("piece") else "x"
            rows = None
            for f, t in built.items():
                own = getattr(t, name).select(F.lit(f).alias("field"), bucket_of(gram, buckets), "*")
                rows = own if rows is None else rows.unionByName(own)
            spread = [F.pmod(F.xxhash64("name"), F.lit(SPREAD))] if "name" in rows.columns else []
            rows.repartition("field", "bucket", *spread).sortWithinPartitions("field", "bucket", *KEY, gram).write.partitionBy("field", "bucket").parquet(f"{path}/{name}")
        spark.createDataFrame([(path,)], "path string").coalesce(1).write.mode("overwrite").text(f"{base}/{version}")
    read = {name: _read(spark, f"{path}/{name}", name) for name in TABLES}
    return Grams(**{f: Texts(**{name: t.filter(F.col("field") == f) for name, t in read.items()}, buckets=buckets) for f in ("name", "name_ja", "set_name")}, version=version)


SCHEMAS = {
    "pieces": "field string, bucket int, game string, language string, piece string, name string",
    "piece_counts": "field string, bucket int, game string, language string, piece string, n long",
    "postings": "field string, bucket int, game string, language string, name string, size int, grams array<long>, place int, x long, n long",
    "counts": "field string, bucket int, game string, language string, x long, n long",
}


def _read(spark, path: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(path)
