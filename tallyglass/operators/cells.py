"""Approximate nearest neighbours over stored cells: a layout partitioned by language and cell, product codes for a first pass, exact re-ranking.

A language's cells are those of pivots out of its vectors. A cell of more than ``MOST`` rows is dealt to pivots of its own, and what is still
larger, such as one vector that very many rows have, into parts by a hash of the id; so no folder holds many more than ``MOST`` rows. A row is stored with its vector and with
its product code, a byte for each of ``SPLITS`` stretches of the vector, which names the nearest of ``WORDS`` words of that stretch. The words come from a
bounded sample (``SAMPLE`` rows a language, by least hash of the id); every row is indexed. A search reads the folders of the cells nearest to its queries, no others; in each it
sums up word scores from a table of the query, and works out exact similarities of the best ``AGAIN`` times ``k`` rows.

Defined cases: rows without a vector or language are skipped; a zero vector has similarity 0 to all; an empty index or query table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import top
from ..sources.shared import landing
from .knn_join import BLOCK, _by_language, _lengths, _matrix, _pivots

MOST, SPLITS, WORDS, SAMPLE, AGAIN = 20_000, 8, 64, 4096, 10


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(_lengths(v), 1e-30)[:, None]


def _words(sample: np.ndarray) -> list[np.ndarray]:
    """The words of each stretch: some rounds of k-means in memory, over the sample alone."""
    out = []
    for x in np.array_split(sample, min(SPLITS, sample.shape[1]), axis=1):
        words = np.unique(x, axis=0)
        words = words[np.linspace(0, len(words) - 1, min(WORDS, len(words))).astype(int)]
        for _ in range(8):
            own = _nearest(x, words)
            words = np.array([x[own == k].mean(axis=0) if (own == k).any() else w for k, w in enumerate(words)])
        out.append(words)
    return out


def _nearest(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    return ((to * to).sum(axis=1) - 2 * (x @ to.T)).argmin(axis=1)


def _dealt(centres: dict[str, np.ndarray]):
    """Rows with the cell of the nearest centre of their language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for language, own in _by_language(b):
                cell = _nearest(_unit(_matrix(own.column("v"))), centres[language]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([own.column("language"), pa.array(cell), own.column("id"), own.column("v")], ["language", "cell", "id", "v"])

    return run


def _coded(words: dict[str, list[np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for language, own in _by_language(b):
                parts = np.array_split(_unit(_matrix(own.column("v"))), len(words[language]), axis=1)
                codes = np.column_stack([_nearest(x, w) for x, w in zip(parts, words[language], strict=True)]).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([*(own.column(n) for n in ("language", "cell", "part", "id", "v")), pa.array([c.tobytes() for c in codes], pa.binary())], ["language", "cell", "part", "id", "v", "code"])

    return run


@dataclass
class StoredCells:
    """A stored index: its folder, each language's centres (a few hundred), and the words of its codes."""

    spark: SparkSession
    path: str
    centres: dict[str, np.ndarray]
    words: dict[str, list[np.ndarray]]

    def rows(self) -> DataFrame:
        return self.spark.read.schema("id long, v array<double>, code binary, language string, cell int, part int").parquet(self.path)


def build(index: DataFrame, path: str | None = None, most: int = MOST) -> StoredCells:
    """Stores ``index(id, language, v)`` by language, cell and part."""
    spark = index.sparkSession
    path = path or landing(spark, "cells")
    rows = index.filter("v IS NOT NULL AND language IS NOT NULL").select("language", F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    centres = _pivots(rows)
    dealt = rows.mapInArrow(_dealt(centres), "language string, cell int, id long, v array<double>")
    large = dealt.groupBy("language", "cell").agg(F.count("*").alias("n")).filter(F.col("n") > most)
    # rows of a large cell that become centres besides its own: two for each ``most`` rows
    wanted = F.least(F.ceil(2 * F.col("n") / most), F.lit(256))
    more = top(dealt.join(F.broadcast(large), ["language", "cell"]), ["language", "cell"], [F.xxhash64("id"), F.asc("id")], 256).filter(F.col("rank") <= wanted)
    for r in more.select("language", "v").orderBy("language", "id").collect():
        centres[r.language] = np.unique(np.concatenate([centres[r.language], _unit(np.array([r.v]))]), axis=0)
    dealt = rows.mapInArrow(_dealt(centres), "language string, cell int, id long, v array<double>")
    sizes = dealt.groupBy("language", "cell").agg(F.ceil(F.count("*") / most).alias("parts"))
    words = {g: _words(_unit(np.array(v, float))) for g, v in _sampled(rows).items()}
    parted = dealt.join(F.broadcast(sizes), ["language", "cell"]).select("language", "cell", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id", "v")
    coded = parted.mapInArrow(_coded(words), "language string, cell int, part int, id long, v array<double>, code binary")
    coded.repartition("language", "cell", "part").sortWithinPartitions("language", "cell", "part").write.partitionBy("language", "cell", "part").parquet(path)
    return StoredCells(spark, path, centres, words)


def _sampled(rows: DataFrame) -> dict[str, list]:
    out: dict[str, list] = {}
    for r in top(rows, ["language"], [F.xxhash64("id"), F.asc("id")], SAMPLE).select("language", "v").collect():
        out.setdefault(r.language, []).append(r.v)
    return out


def _asked(centres: dict[str, np.ndarray], probes: int):
    """Each query once for each of the ``probes`` cells nearest to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for language, own in _by_language(b):
                if language in centres:
                    near = np.argsort(-(_unit(_matrix(own.column("v"))) @ centres[language].T), axis=1, kind="stable")[:, :probes]
                    picked = own.take(pa.array(np.repeat(np.arange(own.num_rows), near.shape[1])))
                    yield pa.RecordBatch.from_arrays([picked.column("language"), pa.array(near.ravel().astype(np.int32)), picked.column("id"), picked.column("v"), pa.array([None] * picked.num_rows, pa.binary())], ["language", "cell", "id", "v", "code"])

    return run


def _ranked(words: dict[str, list[np.ndarray]], k: int):
    """Sorted by cell and part, rows before queries: for each query the best of the part, by codes and then exactly."""

    def compare(language: str, q: pa.RecordBatch, ids: np.ndarray, v: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
        own, x = q.column("id").to_numpy(), _unit(_matrix(q.column("v")))
        rough = np.zeros((len(x), len(ids)), np.float32)
        for m, (part, w) in enumerate(zip(np.array_split(x, len(words[language]), axis=1), words[language], strict=True)):
            rough += (part @ w.T).astype(np.float32)[:, codes[:, m]]
        n = min(len(ids), AGAIN * k + 1)
        at = np.argpartition(-rough, n - 1, axis=1)[:, :n]
        sims = np.round(np.einsum("qd,qnd->qn", x, v[at]), 6)
        sims[ids[at] == own[:, None]] = -np.inf
        order = np.lexsort((ids[at], -sims), axis=1)[:, :k]
        at, sims = np.take_along_axis(at, order, axis=1), np.take_along_axis(sims, order, axis=1)
        keep = np.isfinite(sims)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(own, keep.sum(axis=1))), pa.array(ids[at][keep]), pa.array(sims[keep])], ["query_id", "card_id", "sim"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, ready = None, [], None
        for b in batches:
            keys = list(zip(*(b.column(n).to_pylist() for n in ("language", "cell", "part")), strict=True))
            kinds = b.column("kind").to_numpy()
            ends = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1] or kinds[i] != kinds[i - 1]] + [len(keys)]
            at = 0
            for end in ends if keys else []:
                piece = b.slice(at, end - at)
                if keys[at] != key:
                    key, held, ready = keys[at], [], None
                if kinds[at] == 0:
                    held.append(piece)
                else:
                    if ready is None and held:
                        t = pa.Table.from_batches(held).combine_chunks()
                        codes = np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(t.num_rows, -1)
                        ready, held = (t.column("id").to_numpy(), _unit(_matrix(t.column("v").chunk(0))), codes), []
                    for i in range(0, piece.num_rows, BLOCK):
                        if ready is not None:
                            yield compare(key[0], piece.slice(i, BLOCK), *ready)
                at = end

    return run


def search(queries: DataFrame, cells: StoredCells, probes: int = 20, k: int = 10) -> DataFrame:
    """``query_id, card_id, sim, rank`` of ``queries(id, language, v)``: by cosine among the rows of the ``probes`` cells nearest to each."""
    n = int(cells.spark.conf.get("spark.sql.shuffle.partitions"))
    q = queries.filter("v IS NOT NULL AND language IS NOT NULL").select(F.col("id").cast("long").alias("id"), "language", F.col("v").cast("array<double>").alias("v"))
    asked = q.mapInArrow(_asked(cells.centres, probes), "language string, cell int, id long, v array<double>, code binary")
    touched: dict[str, list[int]] = {}
    for r in asked.select("language", "cell").distinct().collect():  # at most all cells
        touched.setdefault(r.language, []).append(r.cell)
    read = F.lit(False)
    for language, own in touched.items():
        read = read | ((F.col("language") == language) & F.col("cell").isin(own))
    rows = cells.rows().filter(read)
    parts = rows.select("language", "cell", "part").distinct()
    visits = asked.join(F.broadcast(parts), ["language", "cell"])
    names = ["language", "cell", "part", "kind", "id", "v", "code"]
    both = rows.withColumn("kind", F.lit(0)).select(names).unionByName(visits.withColumn("kind", F.lit(1)).select(names))
    both = both.repartition(n, "language", "cell", "part").sortWithinPartitions("language", "cell", "part", "kind")
    found = both.mapInArrow(_ranked(cells.words, k), "query_id long, card_id long, sim double")
    return top(found, ["query_id"], [F.desc("sim"), F.asc("card_id")], k)
