"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits link at Hamming distance ``RADIUS`` or less. The bits are dealt into partitions, correlated bits
together; partition i gets a threshold t_i (-1: unused) with sum(t_i) = RADIUS - m + 1, so any linked pair differs by at most
t_i bits in some used partition i. The thresholds come from dynamic programming over estimated probe and candidate counts.

Defined cases: a null text is empty; a text without a word has fingerprint 0 and links like any other; rows with the same
fingerprint are linked; a null ``doc_id`` takes part, and ``component_id`` is the smallest non-null id reachable (null if there
is none); repeated rows stay repeated rows; an empty table gives an empty result; further columns are ignored by
:func:`near_duplicates` and passed through by :func:`keep_one`, which leaves one row of a group whatever repeats in it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions, texts
from .components import components

BITS, RADIUS, SHINGLE = 64, 3, 3
#: Groups up to this size are compared by shifting the sorted column, larger ones one by one.
SMALL_GROUP = 48
#: Parts in which the fingerprints of a component meet its label.
PARTS = 16


def fingerprint(text: str, size: int = SHINGLE) -> tuple[int, int]:
    """(fingerprint, number of shingles). ``bytes.lower`` and ``bytes.split`` act on ASCII letters and white space only."""
    w = text.encode().lower().split()
    if not w:
        return 0, 0
    shingles = map(b" ".join, zip(*(w[k:] for k in range(size)), strict=False)) if len(w) >= size else [b" ".join(w)]
    h = np.array([xxhash.xxh64_intdigest(s, seed=42) for s in shingles], dtype=np.uint64)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(h), 8192):
        ones += np.unpackbits(h[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0]), len(h)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [fingerprint(t) for t in b.column("text").to_pylist()]
        fp = np.array([f for f, _ in found], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp, pa.int64()), pa.array([n for _, n in found], pa.int64())], ["doc_id", "fp", "n_shingles"])


def fingerprints(docs: DataFrame) -> DataFrame:
    return texts(docs).mapInArrow(_fingerprints, "doc_id long, fp long, n_shingles long")


def _keyed_fingerprints(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t)[0] for t in b.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("_no_id", "_id", "_text")), pa.array(fp, pa.int64())], ["_no_id", "_id", "_text", "fp"])

    return rows.mapInArrow(run, "_no_id boolean, _id long, _text long, fp long")


def bit_matrix(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _cooccurrence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros((BITS, BITS)), 0
    for b in batches:
        x = bit_matrix(np.ascontiguousarray(b.column("fp").to_numpy(zero_copy_only=False))).astype(np.float32)
        total, n = total + (x.T @ x), n + len(x)
    i, j = np.triu_indices(BITS)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1), pa.int32()), pa.array(np.append(j, -1), pa.int32()), pa.array(np.append(total[i, j], n), pa.float64())], ["i", "j", "n"])


def statistics(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and how often each pair of bits is set together: 2,081 sums over all of them."""
    n, both = 0, np.zeros((BITS, BITS))
    for r in distinct.select("fp").mapInArrow(_cooccurrence, "i int, j int, n double").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        if r.i < 0:
            n = int(r.n)
        else:
            both[r.i, r.j] = both[r.j, r.i] = r.n
    return n, both


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Deal the bits into ``parts`` groups of near-equal size, each grown by the bit most correlated with the group."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    left, groups = list(range(BITS)), []
    for k in range(parts):
        size = (BITS - sum(map(len, groups))) // (parts - k)
        own = [left.pop(0)]
        while len(own) < size:
            best = max(left, key=lambda b: (corr[b, own].sum(), -b))
            left.remove(best)
            own.append(best)
        groups.append(sorted(own))
    return groups


def within(q: np.ndarray, most: int) -> np.ndarray:
    """Chance that at most 0, 1, .. ``most`` of independent bits with disagreement rates ``q`` differ."""
    d = np.zeros(most + 1)
    d[0] = 1
    for x in q:
        d[1:] = d[1:] * (1 - x) + d[:-1] * x
        d[0] *= 1 - x
    return np.cumsum(d)


def thresholds(n: int, both: np.ndarray, groups: list[list[int]], radius: int = RADIUS, per_candidate: float = 0.005) -> tuple[float, list[int]]:
    """The cheapest thresholds for these groups: (cost per fingerprint, [t_i]). A probe costs 1, a candidate ``per_candidate``."""
    p = np.diag(both) / max(n, 1)
    q = np.maximum(2 * p * (1 - p), 0.01)
    need = radius - len(groups) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for g in groups:
        near, nxt = within(q[g], radius), {}
        for used, (cost, ts) in best.items():
            for t in range(-1, radius + 1):
                probes = sum(math.comb(len(g), k) for k in range(t + 1))
                c = cost + (0 if t < 0 else probes + per_candidate * n * near[t] * probes)
                if used + t not in nxt or c < nxt[used + t][0]:
                    nxt[used + t] = (c, [*ts, t])
        best = nxt
    return best[need]


def plan(n: int, both: np.ndarray, radius: int = RADIUS) -> tuple[list[list[int]], list[int]]:
    """The grouping and thresholds of the cheapest number of partitions."""
    options = []
    for m in range(2, 7):
        groups = group_bits(n, both, m)
        cost, ts = thresholds(n, both, groups, radius)
        options.append((cost, m, groups, ts))
    _, _, groups, ts = min(options, key=lambda x: x[:2])
    return groups, ts


def _keys(groups: list[list[int]], ts: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.ascontiguousarray(b.column("fp").to_numpy(zero_copy_only=False))
            for part, (g, t) in enumerate(zip(groups, ts, strict=True)):
                if t < 0:
                    continue
                own = sum(((fp.view(np.uint64) >> np.uint64(bit)) & np.uint64(1)) << np.uint64(k) for k, bit in enumerate(g)).astype(np.uint64)
                for size in range(t + 1):
                    for flips in combinations(range(len(g)), size):
                        mask = np.uint64(sum(1 << f for f in flips))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), part, np.int32)), pa.array((own ^ mask).view(np.int64)), pa.array(fp)], ["part", "value", "fp"])

    return run


def near_in_group(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links in one group: a search that compares each found member with those not yet reached."""
    left, out = np.unique(fps), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            u = queue.pop()
            near = np.bitwise_count((left ^ u).view(np.uint64)) <= radius
            if near.any():
                new, left = left[near], left[~near]
                out.extend((int(u), int(v)) for v in new)
                queue.extend(new)
    return out


def _links(radius: int):
    def groups(key: np.ndarray, fp: np.ndarray) -> Iterator[np.ndarray]:
        """Pairs (a, b) of every complete group of the sorted rows."""
        starts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
        sizes = np.diff(np.append(starts, len(key)))
        big = sizes > SMALL_GROUP
        small_rows = np.repeat(~big, sizes)
        gid = np.repeat(np.arange(len(starts)), sizes)[small_rows]
        f = fp[small_rows]
        for d in range(1, min(SMALL_GROUP, int(sizes[~big].max(initial=0)))):
            hit = (gid[d:] == gid[:-d]) & (np.bitwise_count((f[d:] ^ f[:-d]).view(np.uint64)) <= radius)
            if hit.any():
                yield np.stack([f[:-d][hit], f[d:][hit]])
        for s, n in zip(starts[big], sizes[big], strict=True):
            found = near_in_group(fp[s : s + n], radius)
            if found:
                yield np.array(found, np.int64).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out(key, fp):
            for ab in groups(key, fp):
                if (keep := ab[0] != ab[1]).any():
                    yield pa.RecordBatch.from_arrays([pa.array(ab[0][keep]), pa.array(ab[1][keep])], ["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column("part").to_numpy(zero_copy_only=False).astype(np.int64), b.column("value").to_numpy(zero_copy_only=False)], axis=1)
            held.append((key, b.column("fp").to_numpy(zero_copy_only=False)))
            if (held[0][0][0] == key[-1]).all():
                continue  # the group that came first goes on
            key, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            last = len(key) - int(np.argmax((key[::-1] != key[-1]).any(axis=1)))
            yield from out(key[:last], fp[:last])
            held = [(key[last:], fp[last:])]
        if held:
            yield from out(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints that connect exactly what distance ``radius`` connects."""
    n, both = statistics(distinct)
    groups, ts = plan(n, both, radius)
    keys = distinct.select("fp").mapInArrow(_keys(groups, ts), "part int, value long, fp long")
    keys = keys.repartition(partitions(distinct.sparkSession), "part", "value").sortWithinPartitions("part", "value")
    return keys.mapInArrow(_links(radius), "a long, b long")


def _labels(fps: DataFrame, first, radius: int) -> DataFrame:
    """``fps`` with ``least``: the least value of ``first`` in the component of the fingerprint ``fp``."""
    distinct = cut(fps.groupBy("fp").agg(F.min(first).alias("first")))
    roots = components(links(distinct, radius)).withColumnRenamed("node", "fp")
    linked = distinct.join(roots, "fp").withColumn("part", F.pmod(F.xxhash64("fp"), F.lit(PARTS)))
    # a component's label goes to each part of it, so that a very large one is no single task's
    least = linked.groupBy("root").agg(F.min("first").alias("least")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    named = linked.join(least, ["root", "part"]).select("fp", "least")
    return fps.join(distinct.join(named, "fp", "left").select("fp", F.coalesce("least", "first").alias("least")), "fp")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row."""
    found = _labels(cut(fingerprints(docs).select("doc_id", "fp")), F.col("doc_id"), radius)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("least").alias("component_id"))


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Of ``docs``, all columns, one row of each group: of its least ``doc_id``, and only without any a row that has no id.

    Rows are told apart by id and text; those alike in both are reduced to one afterwards, by their other columns.
    """
    key = [F.col("doc_id").isNull().alias("_no_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text")]
    names = ["_no_id", "_id", "_text"]
    fps = cut(_keyed_fingerprints(docs.select(*key, F.coalesce("text", F.lit("")).alias("text"))))
    found = _labels(fps, F.struct(*names), radius).select(*names, (F.struct(*names) == F.col("least")).alias("kept"))
    # keys whose rows go, or stay but for the repetitions
    marked = cut(found.groupBy(*names).agg(F.max("kept").alias("kept"), F.count("*").alias("n")).filter("NOT kept OR n > 1"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *key)
    single = rows.join(marked.select(*names), names, "left_anti").select("_row.*")
    repeated = marked.filter("kept").select(*names)
    if repeated.isEmpty():
        return single
    return single.union(rows.join(repeated, names, "left_semi").groupBy(*names).agg(F.min_by("_row", F.to_json("_row")).alias("_row")).select("_row.*"))
