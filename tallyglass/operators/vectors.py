"""Vector search: exact, by cells, and on 8-bit vectors; perceptual-hash re-ranking; parity of two vector tables.

Exact search lands its queries once in the shared folder. Up to ``STREAMED`` of them, every task reads its rows of the index in pieces of bounded
size and streams over the queries in blocks; only the k best of a piece for each query reach the shuffle. More queries go through :func:`.knn_join.knn_join`,
where each meets only the cells of the index that a bound leaves. Nothing passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import dot, hamming_hex, norm, top, two_places
from ..sources.shared import landing
from .knn_join import PART, best_of_parts, knn_join

#: Query vectors and index rows compared at a time; numbers of an index piece; most queries that every task streams over.
BLOCK, COLUMNS, HELD, STREAMED = 512, 16_384, 1 << 23, 20_000


def prepare(df: DataFrame, dim: int, version: str) -> DataFrame:
    """``vec_id, status, unit``: rows of another length or model version are marked; the others scaled to length 1 (a zero vector stays)."""
    n = norm(F.col("embedding"))
    status = F.when(F.col("embedding").isNull() | (F.size("embedding") != dim), "wrong length").when(F.col("version") != version, "other version").otherwise("ok")
    unit = F.when(n > 0, F.transform("embedding", lambda x: x.cast("double") / n)).otherwise(F.transform("embedding", lambda x: x.cast("double")))
    return df.withColumn("status", status).select("vec_id", "status", F.when(F.col("status") == "ok", unit).alias("unit"))


def _matrix(column: pa.ListArray, dtype=np.float64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), -1)


def _best(s: np.ndarray, own: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the k greatest of each row that reach ``least``, and all that equal the k-th."""
    if s.shape[1] > k:
        least = np.maximum(np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k], least)[:, None]
    return np.nonzero(s >= least)


def _partial(path: str, k: int, cosine: bool, floor: float | None):
    """Holds the index rows of its task and streams over the landed queries, block by block."""
    least = -2.0 if floor is None else floor

    def search(q, ids, v, own, scale):
        found = []
        for at in range(0, len(own), COLUMNS):
            c = slice(at, at + COLUMNS)
            s = (q @ v[c].T) * scale[c]
            if cosine:
                s = s / np.maximum(np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v[c], axis=1), 1e-30)
            s = np.round(s, 6)
            s[ids[:, None] == own[c]] = -9
            rows, columns = _best(s, own[c], k, least)
            found.append((rows, own[c][columns], s[rows, columns]))
        rows, cards, sims = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((cards, -sims, rows))
        rows, cards, sims = rows[order], cards[order], sims[order]
        nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = nth < k
        return pa.RecordBatch.from_arrays([pa.array(ids[rows[keep]]), pa.array(cards[keep]), pa.array(sims[keep])], ["query_id", "card_id", "sim"])

    def against(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, scale = (np.concatenate([b.column(n).to_numpy(zero_copy_only=False) for b in held]) for n in ("id", "scale"))
        lang, v = np.array([x for b in held for x in b.column("language").to_pylist()]), np.concatenate([_matrix(b.column("vector")) for b in held])
        mine = {at: np.flatnonzero(lang == at) for at in set(lang.tolist())}
        mine = {at: (v[rows], own[rows], scale[rows]) for at, rows in mine.items()}
        del v
        files, root = fs.FileSystem.from_uri(path)
        for info in files.get_file_info(fs.FileSelector(root)):
            if not info.path.endswith(".parquet"):
                continue
            for b in pq.ParquetFile(files.open_input_file(info.path)).iter_batches(BLOCK):
                ids, langs, q = b.column("id").to_numpy(), np.array(b.column("language").to_pylist()), _matrix(b.column("v"))
                for at in sorted(set(langs.tolist()) & set(mine)):
                    yield search(q[langs == at], ids[langs == at], *mine[at])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            b = b.filter(pc.and_(b.column("vector").is_valid(), b.column("language").is_valid()))
            if not b.num_rows:
                continue
            held.append(b)
            size += len(b.column("vector").flatten())
            if size >= HELD:
                yield from against(held)
                held, size = [], 0
        if held:
            yield from against(held)

    return run


def _knn(queries: DataFrame, index: DataFrame, k: int, cosine: bool, floor: float | None = None) -> DataFrame:
    path = landing(queries.sparkSession, "query-vectors")
    asked = queries.filter("embedding IS NOT NULL AND language IS NOT NULL").select(F.col("vec_id").cast("long").alias("id"), "language", F.col("embedding").cast("array<double>").alias("v"))
    asked.write.parquet(path)
    asked = queries.sparkSession.read.parquet(path)
    if asked.count() > STREAMED:
        return knn_join(asked, index.select("id", "language", F.col("vector").alias("v"), "scale"), k, cosine, floor)
    found = index.mapInArrow(_partial(path, k, cosine, floor), "query_id long, card_id long, sim double")
    return top(found, ["query_id"], [F.desc("sim"), F.asc("card_id")], k)


def knn_exact(queries: DataFrame, index: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, card_id, sim, rank``: cosine similarity within the query's language; no row matches itself; null vectors are skipped."""
    rows = index.select(F.col("vec_id").cast("long").alias("id"), "language", F.col("embedding").alias("vector"), F.lit(1.0).alias("scale"))
    return _knn(queries, rows, k, True)


def knn_int8(queries: DataFrame, index8: DataFrame, floor: float = 0.45, k: int = 10) -> DataFrame:
    """As :func:`knn_exact` on 8-bit vectors: dot product times scale; rows below the floor are dropped before the k best are taken."""
    return _knn(queries, index8.select(F.col("vec_id").cast("long").alias("id"), "language", F.col("q").alias("vector"), "scale"), k, False, floor)


def quantize(df: DataFrame) -> DataFrame:
    """``vec_id, language, scale, q``: each vector on its own to 8 bits, rounded half to even."""
    most = F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    q = F.transform("embedding", lambda x: F.greatest(F.least(F.bround(x.cast("double") / F.greatest(most, F.lit(1e-8)) * 127), F.lit(127.0)), F.lit(-127.0)).cast("tinyint"))
    return df.select("vec_id", "language", F.greatest(most / 127, F.lit(1e-8)).alias("scale"), q.alias("q"))


def build_ivf(index: DataFrame, lists: int | None = None, seed: int = 7) -> tuple[DataFrame, dict[str, list]]:
    """The index with a ``cell`` column, and each language's cell centres (a few hundred at most): ``lists`` or min(100, max(1, n // 100)) cells a language."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    sizes = {r.language: r["count"] for r in index.groupBy("language").count().collect()}
    out, centres = None, {}
    n = norm(F.col("embedding"))
    for language, size in sorted(sizes.items()):
        own = index.filter(F.col("language") == language).withColumn("unit", F.transform("embedding", lambda x: x.cast("double") / F.greatest(n, F.lit(1e-30))))
        model = KMeans(k=lists or min(100, max(1, size // 100)), seed=seed, featuresCol="v", predictionCol="cell").fit(own.select(array_to_vector("unit").alias("v")))
        part = model.transform(own.withColumn("v", array_to_vector("unit"))).select("vec_id", "language", "embedding", "cell")
        out, centres[language] = part if out is None else out.union(part), [c.tolist() for c in model.clusterCenters()]
    return out, centres


def knn_ivf(queries: DataFrame, index: DataFrame, centres: dict[str, list], probes: int = 20, k: int = 10) -> DataFrame:
    """Searches only the ``probes`` cells nearest to a query: a cell is dealt into parts of bounded size, which their task holds while it streams over the queries."""
    spark = queries.sparkSession
    c = spark.createDataFrame([(lang, i, list(map(float, v))) for lang, cs in centres.items() for i, v in enumerate(cs)], "language string, cell int, centre array<double>")
    near = queries.join(F.broadcast(c), "language").withColumn("d", F.aggregate(F.zip_with("embedding", "centre", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    near = top(near, ["vec_id"], [F.asc("d"), F.asc("cell")], probes).select(F.col("vec_id").alias("query_id"), "language", "cell", F.col("embedding").alias("q"))
    cells = index.filter("embedding IS NOT NULL")
    parts = F.broadcast(cells.groupBy("language", "cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")))
    held = cells.join(parts, ["language", "cell"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    asked = near.filter("q IS NOT NULL").join(parts, ["language", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    row = lambda df, kind, id_, v, least: df.select("language", "cell", "part", F.lit(kind).alias("kind"), F.col(id_).cast("long").alias("id"), F.col(v).cast("array<double>").alias("v"), F.lit(1.0).alias("scale"), F.lit(least).alias("least"))
    both = row(held, 0, "vec_id", "embedding", 0.0).unionByName(row(asked, 1, "query_id", "q", -2.0))
    both = both.repartition("language", "cell", "part").sortWithinPartitions("language", "cell", "part", "kind")
    found = both.mapInArrow(best_of_parts(k, True), "query_id long, card_id long, sim double")
    return top(found, ["query_id"], [F.desc("sim"), F.asc("card_id")], k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    j = exact.select("query_id", "card_id").join(found.select("query_id", "card_id", F.lit(1).alias("hit")), ["query_id", "card_id"], "left")
    return j.agg(F.count("*").alias("wanted"), F.count("hit").alias("found"), F.round(F.count("hit") / F.count("*"), 6).alias("recall"))


def hash_of(embedding: Column) -> Column:
    """A 64-bit hash as 16 hexadecimal digits: the signs of the first 64 numbers."""
    bits = F.array_join(F.transform(F.slice(embedding, 1, 64), lambda x: F.when(x >= 0, "1").otherwise("0")), "")
    return F.concat(*[F.lpad(F.lower(F.conv(F.substring(bits, 1 + 32 * h, 32), 2, 16)), 8, "0") for h in range(2)])


def hamming_rerank(hits: DataFrame, hashes: DataFrame, t: int = 20) -> DataFrame:
    """Hits whose hash is within ``t`` bits of the query's first, then by similarity. A missing hash counts as 999."""
    j = hits.join(hashes.select(F.col("vec_id").alias("query_id"), F.col("hash").alias("hq")), "query_id", "left").join(hashes.select(F.col("vec_id").alias("card_id"), F.col("hash").alias("hc")), "card_id", "left")
    j = j.withColumn("distance", hamming_hex(F.col("hq"), F.col("hc"))).withColumn("strong", F.col("distance") <= t)
    return j.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("strong"), F.desc("sim"), "card_id"))).select("query_id", "card_id", "sim", "distance", "strong", "rank")


def classify_hits(reranked: DataFrame, floor: float = 0.45, confident: float = 0.65) -> DataFrame:
    """Per query: best similarity, number of candidates (none under the floor), label and source."""
    g = reranked.groupBy("query_id").agg(F.max("sim").alias("best"), F.count("*").alias("n"), F.max_by("strong", -F.col("rank")).alias("strong"))
    shown = F.col("best") >= floor
    text = F.concat(F.lit("image:"), two_places(F.col("best")))
    return g.select("query_id", "best", F.when(shown, F.col("n")).otherwise(0).alias("candidates"), F.when(F.col("strong"), F.concat(text, F.lit("+phash"))).when(shown, text).otherwise("image:no_match").alias("label"), F.when(F.col("best") >= confident, "image").when(shown, "image:low").otherwise("none").alias("source"))


def choose_language(both: DataFrame, margin: float = 0.05, confident: float = 0.65, only_if_low: bool = True) -> DataFrame:
    """``query_id, primary_best, other_best, chosen``: the other language if better by more than the margin (in fallback mode only when the first is not confident)."""
    g = both.groupBy("query_id", "language").agg(F.max(F.when(F.col("card_language") == F.col("language"), F.col("sim"))).alias("primary_best"), F.max(F.when(F.col("card_language") != F.col("language"), F.col("sim"))).alias("other_best"))
    low = F.lit(True) if not only_if_low else F.coalesce("primary_best", F.lit(0.0)) < confident
    swap = low & (F.col("other_best") > F.coalesce("primary_best", F.lit(0.0)) + margin)
    return g.select("query_id", "primary_best", "other_best", F.when(F.coalesce(swap, F.lit(False)), F.when(F.col("language") == "ja", "en").otherwise("ja")).otherwise(F.col("language")).alias("chosen"))


def keyed(df: DataFrame) -> DataFrame:
    """A table of vectors as :func:`.knn_join.knn_join` takes it."""
    return df.select(F.col("vec_id").alias("id"), "language", F.col("embedding").alias("v"))


def parity(a: DataFrame, b: DataFrame, mean_drift: float = 0.02, p99_drift: float = 0.05, agreement: float = 0.99) -> DataFrame:
    """One row: similarity and drift of two tables of vectors by id, agreement of the nearest other row, and the pass flags."""
    j = a.select("vec_id", F.col("embedding").alias("x")).join(b.select("vec_id", F.col("embedding").alias("y")), "vec_id")
    s = j.select("vec_id", F.round(dot(F.col("x"), F.col("y")) / (norm(F.col("x")) * norm(F.col("y"))), 6).alias("s"))
    nearest = lambda t: knn_join(keyed(t), keyed(t).withColumn("scale", F.lit(1.0)), 1)
    near = nearest(a).select("query_id", F.col("card_id").alias("na")).join(nearest(b).select("query_id", F.col("card_id").alias("nb")), "query_id")
    agree = near.agg(F.round(F.avg((F.col("na") == F.col("nb")).cast("double")), 6).alias("agreement"))
    g = s.agg(F.count("*").alias("n"), F.round(F.avg("s"), 6).alias("mean_sim"), F.min("s").alias("min_sim"), F.round(F.percentile("s", 0.01), 6).alias("p1_sim"), F.round(F.avg(1 - F.col("s")), 6).alias("mean_drift"), F.round(F.percentile(1 - F.col("s"), 0.99), 6).alias("p99_drift"), F.round(F.max(1 - F.col("s")), 6).alias("max_drift"))
    return g.join(F.broadcast(agree)).withColumn("passed", (F.col("mean_drift") <= mean_drift) & (F.col("p99_drift") <= p99_drift) & (F.col("agreement") >= agreement))
