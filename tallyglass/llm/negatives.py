"""Hard negatives by exact integer scores: matrix products modulo small primes in float32, joined by Chinese remaindering.

The score of two vectors is the inner product of their scaled integer components. Every component is taken modulo several primes, into
(-p/2, p/2); as many products of such residues are summed in float32 as stay below 2 ** 24, where every integer is exact. As many primes are
used as the product of the largest norms asks for, so the signed scores that their remainders stand for are exact at any scale.

Anchors are landed once in the shared folder. Each task reads its rows of the index in pieces of bounded size and streams over the
anchors in blocks, first for the best positives, then, when these are known, for the best negatives in the window that each of them
opens; only the best few of a piece for an anchor reach the shuffle, where a window takes the best of all.

Defined cases: rows with a null id, label or vector, or a null or non-finite component, take no part; rows whose vector has another
length than the anchor's are not compared with it; rows that repeat an id take part each, but none as its own positive; rows that
repeat an anchor's id are one anchor each and give their rows again; scores beyond 2 ** 62 stop the job with an error; ties go to the smaller id;
an anchor without a positive, or a positive without a negative, gives no row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch

SCALE, ANCHORS, MOVED, LABELS = 256, 100, 7, 10
POSITIVES, NEGATIVES = 5, 5
#: Window of a negative's score, in hundredths of the positive's.
LEAST, MOST = 80, 100
#: Anchors and index rows scored at a time, index rows held at a time.
ROWS, COLUMNS, HELD = 64, 4096, 65_536
#: Primes under 256, largest first: sums of up to 1,040 products of their residues are exact in float32.
PRIMES = [p for p in range(255, 100, -1) if all(p % q for q in range(2, 16))]


def usable(embeddings: DataFrame) -> DataFrame:
    """``vec_id, label, v``: the rows that take part, with integer components (as doubles) and the label after the given change."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % MOVED == 0, F.pmod(label + 1, F.lit(LABELS))).otherwise(label)
    rows = embeddings.filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").filter(finite)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"), F.transform("embedding", lambda x: _floor(F.lit(float(SCALE)) * x.cast("double"))).alias("v"))


def _floor(x: Column) -> Column:
    """floor() of a double as a double; from 2 ** 53 on, doubles are whole and longs may not hold them."""
    return F.when(F.abs(x) < float(2**53), F.floor(x).cast("double")).otherwise(x)


class Residues:
    """Vectors modulo the first primes of the list, as float32 in (-p/2, p/2)."""

    def __init__(self, v: np.ndarray):
        self.v, self.norm, self.parts = v, float(np.sqrt((v * v).sum(axis=1).max(initial=0.0))), []

    def modulo(self, k: int) -> np.ndarray:
        while len(self.parts) <= k:
            p = PRIMES[len(self.parts)]
            r = np.fmod(self.v, p)
            self.parts.append((r - p * np.rint(r / p)).astype(np.float32))
        return self.parts[k]


def primes_for(bound: float) -> int:
    """How many primes have a product over four times the bound, so that scores end in the first or the last quarter of it."""
    if not bound < 2**62:
        raise ValueError("scores may exceed 2 ** 62")
    product, k = 1, 0
    while product <= 4 * bound + 4:
        product *= PRIMES[k]
        k += 1
    return k


def _mod(x: np.ndarray, p: int) -> np.ndarray:
    """``x`` modulo p: whole numbers under 2 ** 24 in float32, whose quotients by a prime under 256 are never rounded up to a whole number."""
    p = np.float32(p)
    q = np.divide(x, p)
    np.floor(q, out=q)
    np.multiply(q, p, out=q)
    return np.subtract(x, q, out=q)


def joined(remainders: list[np.ndarray]) -> np.ndarray:
    """The signed integers (as int64) with these remainders modulo the first primes, by mixed-radix digits, each under its prime."""
    digits: list[np.ndarray] = []
    for k, r in enumerate(remainders):
        p, so_far = PRIMES[k], np.float32(0)
        for q, d in zip(reversed(PRIMES[:k]), reversed(digits), strict=True):
            so_far = _mod(so_far * np.float32(q) + d, p)
        digits.append(_mod((r - so_far) * np.float32(pow(math.prod(PRIMES[:k]) % p, -1, p)) if k else r, p))
    product, top = math.prod(PRIMES[: len(digits)]), 2 * digits[-1] >= PRIMES[len(digits) - 1]
    if product < 2**53:
        out = np.zeros(digits[0].shape)
        for k, d in enumerate(digits):
            out += d * np.float64(math.prod(PRIMES[:k]))
        out[top] -= product
        return out.astype(np.int64)
    # sums may run over 64 bits and back: the results themselves fit
    out = np.zeros(digits[0].shape, np.uint64)
    for k, d in enumerate(digits):
        out += np.uint64(math.prod(PRIMES[:k]) % 2**64) * d.astype(np.uint64)
    return np.where(top, out - np.uint64(product % 2**64), out).view(np.int64)


def scores(a: Residues, b: Residues, columns: slice) -> np.ndarray:
    """Exact inner products of all of ``a`` with the given rows of ``b``, as int64."""
    found = []
    for k in range(primes_for(a.norm * b.norm * (1 + 1e-9) + 1)):
        x, y = a.modulo(k), b.modulo(k)[columns]
        step = 2**24 // ((PRIMES[k] // 2) ** 2)  # products that float32 sums exactly
        r = np.zeros((len(x), len(y)), np.float32)
        for at in range(0, x.shape[1], step):
            r += _mod(x[:, at : at + step] @ y[:, at : at + step].T, PRIMES[k])
        found.append(_mod(r, PRIMES[k]) if x.shape[1] > step else r)
    return joined(found)


def best(s: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the k greatest allowed of each row, ties to the left, best first."""
    low = np.iinfo(np.int64).min
    n = s.shape[1]
    if np.abs(s).max(initial=0) < 2**62 // max(n, 1):
        key = np.where(allowed, s * n + np.arange(n - 1, -1, -1), low)  # all different
        at = np.argpartition(key, n - k, axis=1)[:, n - k :] if n > k else np.broadcast_to(np.arange(n), s.shape)
        at = np.take_along_axis(at, np.argsort(-np.take_along_axis(key, at, axis=1), axis=1), axis=1)
    else:
        at = np.argsort(np.where(allowed, -s, np.iinfo(np.int64).max), axis=1, kind="stable")[:, :k]
    rows = np.repeat(np.arange(len(s)), at.shape[1])
    columns = at.ravel()
    keep = allowed[rows, columns]
    return rows[keep], columns[keep]


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _anchor_blocks(path: str) -> Iterator[pa.RecordBatch]:
    files, root = fs.FileSystem.from_uri(path)
    for info in files.get_file_info(fs.FileSelector(root)):
        if info.path.endswith(".parquet"):
            yield from pq.ParquetFile(files.open_input_file(info.path)).iter_batches(ROWS)


def _lengths(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch by the length of their vectors."""
    n = pc.list_value_length(batch.column("v"))
    for length in pc.unique(n).to_pylist():
        yield batch.filter(pc.equal(n, length))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[int, pa.Table]]:
    """The index rows of a task, up to ``HELD`` at a time, by the length of their vectors."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= HELD:
            yield _by_length(held)
            held, size = [], 0
    if size:
        yield _by_length(held)


def _by_length(held: list[pa.RecordBatch]) -> dict[int, pa.Table]:
    parts = sorted((p for b in held for p in _lengths(b)), key=lambda p: len(p.column("v")[0]))
    return {n: pa.Table.from_batches(list(own)).sort_by("vec_id").combine_chunks() for n, own in groupby(parts, key=lambda p: len(p.column("v")[0]))}


def _search(path: str, choose, names: list[str]):
    """For each piece of a task's rows and each block of anchors: what ``choose(anchors, scores, same label, own row)`` picks of a stretch of columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            ready = {n: (t.column("vec_id").to_numpy(), t.column("label").to_numpy(), Residues(_matrix(t.column("v").chunk(0)))) for n, t in piece.items()}
            for block in _anchor_blocks(path):
                for a in _lengths(block):
                    if (own := ready.get(len(a.column("v")[0]))) is None:
                        continue
                    ids, labels, b = own
                    anchors, a_ids, a_labels = Residues(_matrix(a.column("v"))), a.column("vec_id").to_numpy(), a.column("label").to_numpy()
                    for at in range(0, len(ids), COLUMNS):
                        c = slice(at, at + COLUMNS)
                        found = choose(a, scores(anchors, b, c), a_labels[:, None] == labels[c], a_ids[:, None] == ids[c])
                        for rows, columns, *more in found:
                            if len(rows):
                                yield pa.RecordBatch.from_arrays([a.column("anchor").take(pa.array(rows)), pa.array(ids[c][columns]), *map(pa.array, more)], names)

    return run


def _positives(a: pa.RecordBatch, s: np.ndarray, same: np.ndarray, own: np.ndarray):
    rows, columns = best(s, same & ~own, POSITIVES)
    yield rows, columns, s[rows, columns]


def _negatives(a: pa.RecordBatch, s: np.ndarray, same: np.ndarray, own: np.ndarray):
    wanted = a.column("scores").to_pylist()
    for nth in range(max(map(len, wanted), default=0)):
        asked = np.flatnonzero([len(w) > nth for w in wanted])
        score = np.array([wanted[i][nth] for i in asked], np.int64)
        # in whole numbers: LEAST * positive <= 100 * negative <= MOST * positive
        low, high = np.array([-(-LEAST * x // 100) for x in score.tolist()], np.int64), np.array([MOST * x // 100 for x in score.tolist()], np.int64)
        t = s[asked]
        allowed = ~same[asked] & (t >= low[:, None]) & (t <= high[:, None])
        some = np.flatnonzero(allowed.any(axis=1))
        rows, columns = best(t[some], allowed[some], NEGATIVES)
        yield asked[some[rows]], columns, t[some[rows], columns], np.full(len(rows), nth, np.int32)


def _first(df: DataFrame, by: list[str], score: str, id_: str, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), F.asc(id_)))).filter(F.col("rank") <= k)


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``, for each anchor and each of its positives."""
    spark = embeddings.sparkSession
    index, path = usable(embeddings), scratch(spark, "anchors")
    index.filter(F.col("vec_id") % ANCHORS == 0).withColumn("anchor", F.monotonically_increasing_id()).write.parquet(f"{path}/all")
    anchors = spark.read.parquet(f"{path}/all")
    found = index.mapInArrow(_search(f"{path}/all", _positives, ["anchor", "id", "score"]), "anchor long, id long, score long")
    p = _first(found, ["anchor"], "score", "id", POSITIVES).groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("positives"))
    p.join(anchors, "anchor").select("anchor", "vec_id", "label", "v", F.transform("positives", lambda x: x["id"]).alias("ids"), F.transform("positives", lambda x: x["score"]).alias("scores")).write.parquet(f"{path}/positive")
    positive = spark.read.parquet(f"{path}/positive")
    found = index.mapInArrow(_search(f"{path}/positive", _negatives, ["anchor", "id", "score", "nth"]), "anchor long, id long, score long, nth int")
    n = _first(found, ["anchor", "nth"], "score", "id", NEGATIVES)
    n = n.join(positive.select("anchor", "vec_id", "ids", "scores"), "anchor")
    return n.select(F.col("vec_id").alias("anchor_id"), F.get("ids", "nth").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.get("scores", "nth").alias("positive_score"), F.col("score").alias("negative_score"))


SQL = f"""
WITH u AS (SELECT vec_id, CASE WHEN vec_id % {MOVED} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::BIGINT AS s
 FROM u a JOIN u b ON a.vec_id % {ANCHORS} = 0 AND len(a.v) = len(b.v) WHERE a.vec_id <> b.vec_id),
p AS (SELECT a, b, s FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM s WHERE same) WHERE r <= {POSITIVES}),
n AS (SELECT p.a, p.b AS p, p.s AS ps, s.b AS n, s.s AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS r FROM p JOIN s ON s.a = p.a AND NOT s.same AND {LEAST} * p.s <= 100 * s.s AND 100 * s.s <= {MOST} * p.s)
SELECT a AS anchor_id, p AS positive_id, r::INT AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE r <= {NEGATIVES}
"""
