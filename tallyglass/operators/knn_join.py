"""Exact nearest-neighbour join of two tables of vectors, with cells that a bound rules out.

Each language has some of its index vectors as pivots. An index row belongs to the cell of the pivot at the least angle, and a cell
knows the range of its rows' angles to the pivot and of their lengths. By the triangle inequality of angles, no row of a cell is closer to a query than the
difference between the query's angle to the pivot and that range. A query visits cells by falling bound until these hold k rows, then
those whose bound reaches the k-th best it has found; all others are never met. Cells are dealt into parts of bounded size, so a
frequent vector is no single task's; a part's rows are held, the queries that visit it are streamed past them in blocks.

Queries are sent through the shuffle to their first cells only, which are few. For the second round they are landed with the k-th best that they have
found, and each task that holds parts reads them block by block and compares those that a bound of its cells lets in. So what is stored follows the number of
rows, however many cells a query visits.

Defined cases: rows without a vector or language are skipped; zero vectors have similarity 0 to all; rows whose vector has another length than the
pivots of their language stop the job with an error; an empty index or query table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import top
from ..sources.shared import landed, landing

#: Most pivots of a language, rows of a part, queries compared at a time; slack for rounding of angles and of similarities to six digits.
PIVOTS, PART, BLOCK, SLACK = 256, 8192, 256, 4e-6
#: Numbers of the rows that a task holds while it reads the landed queries once.
HELD = 1 << 23
#: Queries of a part are sent with these columns; vectors as floats where all are.
VISIT = ["language", "cell", "part", "kind", "id", "v", "scale", "least"]


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _lengths(v: np.ndarray) -> np.ndarray:
    return np.linalg.norm(v, axis=1)


def _angles(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Angles to unit pivots; a zero vector stands at a right angle to all."""
    return np.arccos(np.clip((v @ pivots.T) / np.maximum(_lengths(v), 1e-30)[:, None], -1, 1))


def _by_language(b: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
    languages = b.column("language").to_pylist()
    for language in sorted(set(languages)):
        yield language, b.filter(pa.array([x == language for x in languages]))


def _assign(pivots: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for language, own in _by_language(b):
                v = _matrix(own.column("v"))
                angles = _angles(v, pivots[language])
                cell = angles.argmin(axis=1)
                more = [pa.array(cell.astype(np.int32)), pa.array(angles[np.arange(len(v)), cell]), pa.array(_lengths(v) * np.abs(own.column("scale").to_numpy()))]
                yield pa.RecordBatch.from_arrays([*(own.column(n) for n in ("language", "id", "v", "scale")), *more], ["language", "id", "v", "scale", "cell", "angle", "length"])

    return run


class Cells:
    """What is known of the cells of a language: pivots, ranges of angles and lengths, numbers of rows and parts."""

    def __init__(self, pivots: np.ndarray, rows: list):
        self.number, self.pivots = [r.cell for r in rows], pivots[[r.cell for r in rows]]
        self.near, self.far, self.short, self.long, self.n = (np.array([r[c] for r in rows], float) for c in ("near", "far", "short", "long", "n"))
        self.parts = [-(-r.n // PART) for r in rows]

    def some(self, numbers: list[int]) -> Cells:
        """What is known of these cells only."""
        out, at = object.__new__(Cells), [self.number.index(x) for x in numbers]
        out.number, out.parts, out.pivots = numbers, [self.parts[x] for x in at], self.pivots[at]
        out.near, out.far, out.short, out.long, out.n = (x[at] for x in (self.near, self.far, self.short, self.long, self.n))
        return out

    def bounds(self, v: np.ndarray, cosine: bool) -> np.ndarray:
        """For each vector and cell, a number that no similarity of the cell's rows exceeds."""
        a = _angles(v, self.pivots)
        cos = np.cos(np.maximum(0, np.maximum(a - self.far, self.near - a)))
        return (cos if cosine else _lengths(v)[:, None] * np.where(cos > 0, cos * self.long, cos * self.short)) + SLACK * (1 if cosine else 1 + self.long * _lengths(v)[:, None])


def _visits(cells: dict[str, Cells], k: int, cosine: bool, floor: float, again: bool):
    """Which cells of a language (of ``numbers`` only, where given) each query meets: in the first round the best ones that hold ``k`` rows besides itself, in
    the second all whose bound reaches ``least``. (The cells, a flag for each query and cell.)"""

    def visits(language: str, v: np.ndarray, least: np.ndarray, numbers: list[int] | None = None) -> tuple[Cells, np.ndarray]:
        c = cells[language] if numbers is None else cells[language].some(numbers)
        bounds = c.bounds(v, cosine)
        if again:
            return c, (bounds >= least[:, None]) & (bounds >= floor)
        order = np.argsort(-bounds, axis=1, kind="stable")
        before = np.cumsum(c.n[order], axis=1) - c.n[order]
        first = np.empty_like(order, dtype=bool)
        np.put_along_axis(first, order, before < k + 1, axis=1)
        return c, first & (bounds >= floor)

    return visits


def _sent(visits, known: set[str]):
    """A row for each part of a cell that a query meets. A block of queries at a time meets the cells, so memory does not follow the size of the batches that come in."""

    def send(language: str, own: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        c, wanted = visits(language, _matrix(own.column("v")), own.column("least").to_numpy())
        rows, columns = np.nonzero(wanted)
        for at in range(0, len(rows), 4096):
            r, s = rows[at : at + 4096], columns[at : at + 4096]
            for part in range(max((c.parts[x] for x in s), default=0)):
                more = np.array(c.parts)[s] > part
                picked, cell = own.take(pa.array(r[more])), np.array(c.number, np.int32)[s[more]]
                n = len(cell)
                yield pa.RecordBatch.from_arrays(
                    [picked.column("language"), pa.array(cell), pa.array(np.full(n, part, np.int32)), pa.array(np.ones(n, np.int32)), picked.column("id"), picked.column("v"), pa.array(np.ones(n)), picked.column("least")],
                    VISIT,
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for language, own in _by_language(b):
                if language not in known:
                    continue
                for at in range(0, own.num_rows, BLOCK):
                    yield from send(language, own.slice(at, BLOCK))

    return run


def _streamed(visits, path: str, k: int, cosine: bool):
    """Sorted by language and cell: holds rows of cells and reads the landed queries (id, language, v, least) once for all that it holds; gives the best ``k`` of
    these for each query that reach ``least``."""

    def hold(batches: list[pa.RecordBatch]) -> dict[str, dict[int, tuple]]:
        t, out = pa.Table.from_batches(batches), {}
        languages, cell = np.array(t.column("language").to_pylist()), t.column("cell").to_numpy()
        ids, scale, v = t.column("id").to_numpy(), t.column("scale").to_numpy(), _matrix(t.column("v").combine_chunks())
        for language in sorted(set(languages.tolist())):
            own = np.flatnonzero(languages == language)
            out[language] = {c: (ids[x], v[x], scale[x], _lengths(v[x])) for c in sorted(set(cell[own].tolist())) for x in [own[cell[own] == c]]}
        return out

    def compare(language: str, own: np.ndarray, x: np.ndarray, least: np.ndarray, cells: dict[int, tuple]) -> pa.RecordBatch | None:
        c, wanted = visits(language, x, least, list(cells))
        lengths, found = _lengths(x), []
        for number, asks in zip(c.number, wanted.T, strict=True):
            asks = np.flatnonzero(asks)
            if not len(asks):
                continue
            ids, v, scale, long = cells[number]
            for at in range(0, len(ids), PART):
                s = (x[asks] @ v[at : at + PART].T) * scale[at : at + PART]
                if cosine:
                    s = s / np.maximum(lengths[asks][:, None] * long[at : at + PART], 1e-30)
                # rounding moves a similarity by half of the sixth digit at most
                rows, columns = np.nonzero(s >= least[asks][:, None] - 1e-6)
                sims, rows, cards = np.round(s[rows, columns], 6), asks[rows], ids[at + columns]
                keep = (sims >= least[rows] - 1e-9) & (own[rows] != cards) & np.isfinite(sims)
                found.append((rows[keep], cards[keep], sims[keep]))
        if not found:
            return None
        rows, cards, sims = (np.concatenate(f) for f in zip(*found, strict=True))
        order = np.lexsort((cards, -sims, rows))
        rows, cards, sims = rows[order], cards[order], sims[order]
        keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        return pa.RecordBatch.from_arrays([pa.array(own[rows[keep]]), pa.array(cards[keep]), pa.array(sims[keep])], ["query_id", "card_id", "sim"])

    def against(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = hold(batches)
        files, root = fs.FileSystem.from_uri(path)
        for info in files.get_file_info(fs.FileSelector(root)):
            if not info.path.endswith(".parquet"):
                continue
            for b in pq.ParquetFile(files.open_input_file(info.path)).iter_batches(BLOCK):
                for language, own in _by_language(b):
                    if language in cells:
                        out = compare(language, own.column("id").to_numpy(), _matrix(own.column("v")), own.column("least").to_numpy(), cells[language])
                        if out is not None and out.num_rows:
                            yield out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += len(b.column("v").flatten())
            if size >= HELD:
                yield from against(held)
                held, size = [], 0
        if held:
            yield from against(held)

    return run


def best_of_parts(k: int, cosine: bool):
    """Sorted by part, rows before queries: holds a part's rows and gives for each query the best ``k`` that reach ``least``."""

    def compare(q: list[pa.RecordBatch], ids: np.ndarray, v: np.ndarray, scale: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
        q = pa.Table.from_batches(q).combine_chunks().to_batches()[0]
        own, least, x = q.column("id").to_numpy(), q.column("least").to_numpy(), _matrix(q.column("v"))
        s = (x @ v.T) * scale
        if cosine:
            s = s / np.maximum(_lengths(x)[:, None] * lengths, 1e-30)
        s = np.round(s, 6)
        s[own[:, None] == ids] = -np.inf
        least = least[:, None] - 1e-9
        if s.shape[1] > k:
            least = np.maximum(least, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k][:, None])
        rows, columns = np.nonzero((s >= least) & np.isfinite(s))
        sims = s[rows, columns]
        order = np.lexsort((ids[columns], -sims, rows))
        rows, columns, sims = rows[order], columns[order], sims[order]
        keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        return pa.RecordBatch.from_arrays([pa.array(own[rows[keep]]), pa.array(ids[columns[keep]]), pa.array(sims[keep])], ["query_id", "card_id", "sim"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, ready, waiting = None, [], None, []

        def flush():
            nonlocal waiting
            n = sum(b.num_rows for b in waiting)
            if n and ready is not None:
                yield compare(waiting, *ready)
            waiting = []

        for b in batches:
            keys = list(zip(b.column("language").to_pylist(), b.column("cell").to_pylist(), b.column("part").to_pylist(), strict=True))
            kinds = b.column("kind").to_numpy()
            ends = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1] or kinds[i] != kinds[i - 1]] + [len(keys)]
            at = 0
            for end in ends if keys else []:
                piece, own = b.slice(at, end - at), keys[at]
                if own != key:
                    yield from flush()
                    key, held, ready = own, [], None
                if kinds[at] == 0:
                    held.append(piece)
                else:
                    if ready is None and held:
                        t = pa.Table.from_batches(held).combine_chunks()
                        v = _matrix(t.column("v").chunk(0))
                        ready, held = (t.column("id").to_numpy(), v, t.column("scale").to_numpy(), _lengths(v)), []
                    for i in range(0, piece.num_rows, BLOCK):
                        waiting.append(piece.slice(i, BLOCK))
                        if sum(x.num_rows for x in waiting) >= BLOCK:
                            yield from flush()
                at = end
        yield from flush()

    return run


def _pivots(rows: DataFrame) -> dict[str, np.ndarray]:
    """Unit pivots of each language: its rows of least hash, about the square root of their number, ``PIVOTS`` at most."""
    n = rows.groupBy("language").agg(F.least(F.lit(PIVOTS), F.greatest(F.lit(1), F.ceil(F.sqrt(F.count("*"))))).alias("wanted"))
    least = top(rows.select("language", "id", "v"), ["language"], [F.xxhash64("id"), F.asc("id")], PIVOTS).join(n, "language").filter("rank <= wanted")
    out: dict[str, list] = {}
    for r in least.select("language", "v").collect():
        out.setdefault(r.language, []).append(r.v)
    units = {g: np.array(v, float) / np.maximum(_lengths(np.array(v, float)), 1e-30)[:, None] for g, v in out.items()}
    return {g: np.unique(v, axis=0) for g, v in units.items()}


def _numbers(*frames: DataFrame) -> str:
    """The type in which vectors of all ``frames`` are stored: floats hold what was floats or short whole numbers."""
    kinds = {f.schema["v"].dataType.elementType.typeName() for f in frames}
    return "array<float>" if kinds <= {"float", "byte", "short"} else "array<double>"


def knn_join(queries: DataFrame, index: DataFrame, k: int = 10, cosine: bool = True, floor: float | None = None) -> DataFrame:
    """``query_id, card_id, sim, rank`` for ``queries(id, language, v)`` over ``index(id, language, v, scale)``: the ``k`` of greatest cosine (or dot product
    times ``scale``), rounded to six digits, that reach ``floor``; within the language, no row matches its own id, ties to the smaller id."""
    spark: SparkSession = index.sparkSession
    n, kind = int(spark.conf.get("spark.sql.shuffle.partitions")), _numbers(queries, index)
    rows = index.filter("v IS NOT NULL AND language IS NOT NULL").select(F.col("id").cast("long").alias("id"), "language", F.col("v").cast(kind).alias("v"), F.col("scale").cast("double").alias("scale"))
    pivots = _pivots(rows)
    cells = landed(rows.mapInArrow(_assign(pivots), f"language string, id long, v {kind}, scale double, cell int, angle double, length double"), "cells")
    stats: dict[str, list] = {}
    about = cells.groupBy("language", "cell").agg(F.count("*").alias("n"), F.min("angle").alias("near"), F.max("angle").alias("far"), F.min("length").alias("short"), F.max("length").alias("long"))
    for r in about.orderBy("language", "cell").collect():
        stats.setdefault(r.language, []).append(r)
    known = {g: Cells(pivots[g], rs) for g, rs in stats.items()}
    parts = about.select("language", "cell", F.ceil(F.col("n") / PART).alias("parts"))
    mine = cells.join(F.broadcast(parts), ["language", "cell"]).select("language", "cell", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("kind"), "id", "v", "scale", F.lit(0.0).alias("least"))
    least = -np.inf if floor is None else floor
    asked = queries.filter("v IS NOT NULL AND language IS NOT NULL").select(F.col("id").cast("long").alias("id"), "language", F.col("v").cast(kind).alias("v"))
    by_part, order, result = ["language", "cell", "part"], [F.desc("sim"), F.asc("card_id")], "query_id long, card_id long, sim double"

    nearest = _visits(known, k, cosine, least - SLACK, False)
    sent = asked.withColumn("least", F.lit(float(least))).mapInArrow(_sent(nearest, set(known)), f"language string, cell int, part int, kind int, id long, v {kind}, scale double, least double")
    first = mine.unionByName(sent).repartition(n, *by_part).sortWithinPartitions(*by_part, "kind").mapInArrow(best_of_parts(k, cosine), result)
    reached = top(first, ["query_id"], order, k).groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("sim")).alias("reached"))
    path = landing(spark, "nearest")
    asked.join(reached.withColumnRenamed("query_id", "id"), "id", "left").select("id", "language", "v", F.coalesce("reached", F.lit(float(least))).alias("least")).write.parquet(path)

    every = _visits(known, k, cosine, least - SLACK, True)
    found = mine.select(*by_part, "id", "v", "scale").repartition(n, *by_part).sortWithinPartitions(*by_part).mapInArrow(_streamed(every, path, k, cosine), result)
    return top(found, ["query_id"], order, k)
