"""Benchmark decontamination under word edit distance.

A document is contaminated by an item of L words if some passage of it turns into the item by at most (1 - similarity) * L word
edits. Steps, all inside one pass over the documents:

1. A lossless count of shared q-grams marks the places where such a passage can begin; only there windows are cut.
2. Each item-sized window is embedded by the CGK random walk, which maps edit distance to Hamming distance: at step j the walk
   writes the word it stands on and moves on by a random bit that depends on j and that word.
3. Bit-sampling LSH: a key of ``SAMPLES`` coordinates of the embedding, repeated with fresh walks as often as
   :func:`repetitions` finds necessary for the target recall. A window is a candidate for the items of its length with an equal key.
4. Candidates are verified exactly by fitting the item into the window and its surroundings.

Defined cases: null text is empty; items without a word match nothing; a null ``doc_id`` is reported as null; repeated rows and
ties are reported each; several places of one item in a document give one row, the closest, then the first; empty tables give
empty results; further columns are ignored by :func:`contaminated` and passed through by :func:`clean`.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts

SIMILARITY, RECALL, SAMPLES = 0.8, 0.995, 2
#: The benchmark goes to the executors in blocks of at most so many characters (and one item).
BLOCK_CHARS = 4_000_000
#: Every ASCII character that is no letter, digit or underscore separates words, and so do blanks and punctuation beyond ASCII.
_SEPARATE = bytes(c if c > 127 or chr(c).isalnum() or c == 95 else 32 for c in range(256))
_WIDE = re.compile("[\u00a0-\u00bf\u2000-\u206f\u3000-\u303f\uff01-\uff0f]")
#: Repetitions at most.
MOST = 128
#: Documents whose windows are embedded together.
TOGETHER = 2000
SCHEMA = "doc_id long, item_id long, start long, n_words long, distance long, similarity double"


def words(text: str | None) -> list[bytes]:
    low = (text or "").lower()
    if _WIDE.search(low):
        low = _WIDE.sub(" ", low)
    return low.encode("utf-8", "surrogatepass").translate(_SEPARATE).split()


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit mixing of integers (splitmix64's finaliser)."""
    with np.errstate(over="ignore"):
        x = (x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def embed_keys(windows: np.ndarray, reps: int, samples: int = SAMPLES) -> np.ndarray:
    """LSH keys (reps x windows) of word-id windows (windows x L); 0 is a word that no item has."""
    n, length = windows.shape
    steps = 3 * length
    token = mix(np.append(windows, np.zeros((n, 1), windows.dtype), axis=1)).T.copy()  # a column of padding after the end
    odd = mix(np.arange(reps * steps, dtype=np.uint64) + np.uint64(1 << 32)).reshape(reps, steps) | np.uint64(1)
    rng = np.random.default_rng(steps)
    sampled = np.zeros((reps, steps), bool)
    for r in range(reps):
        sampled[r, rng.choice(steps, min(samples, steps), replace=False)] = True
    at, key = np.zeros((reps, n), np.int64), np.zeros((reps, n), np.uint64)
    column = np.arange(n)[None, :]
    with np.errstate(over="ignore"):
        for j in range(steps):
            t = token[at, column]
            if (own := sampled[:, j]).any():
                # a walk past the end writes one and the same blank
                out = np.where(at[own] >= length, np.uint64(7), t[own])
                key[own] = mix(key[own] * np.uint64(31) + out)
            at += ((t * odd[:, j, None]) >> np.uint64(63)).astype(np.int64)
            np.minimum(at, length, out=at)
    return key


@lru_cache
def repetitions(recall: float = RECALL, similarity: float = SIMILARITY, samples: int = SAMPLES, length: int = 40) -> int:
    """How many repetitions bring passages at the limit of ``similarity`` to ``recall``: from the measured agreement of the embeddings of 60 made pairs.

    Raises where ``MOST`` do not.
    """
    rng, chances = np.random.default_rng(5), []
    edits = int(round((1 - similarity) * length))
    for _ in range(60):
        a = rng.integers(1, 1 << 40, length)
        b = list(a)
        for _ in range(edits):
            p, kind = rng.integers(0, len(b)), rng.integers(0, 3)
            b[p : p + (kind != 0)] = [] if kind == 2 else [int(rng.integers(1, 1 << 40))]
        b = np.array((b + [0] * length)[:length])
        k = embed_keys(np.stack([a, b]), 64, 1)
        chances.append((k[:, 0] == k[:, 1]).mean() ** samples)
    reps = 1
    while np.mean([1 - (1 - c) ** reps for c in chances]) < recall:
        reps += 1
        if reps > MOST:
            raise ValueError(f"{MOST} repetitions do not reach a recall of {recall} for items of {length} words")
    return reps


class Items:
    """A block of benchmark items, compiled: word ids, q-grams by item length, LSH keys."""

    def __init__(self, items: list[tuple[int, str]], similarity: float, recall: float):
        self.vocabulary: dict[bytes, int] = {}
        by_length = defaultdict(list)
        for item, text in items:
            w = [self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in words(text)]
            if w:
                by_length[len(w)].append((item, w))
        self.similarity, self.reps = similarity, repetitions(recall, similarity)
        self.classes, grams = [], defaultdict(lambda: defaultdict(list))
        for length, own in sorted(by_length.items()):
            k = int((1 - similarity) * length + 1e-9)
            q = max(1, min(3, (length - k) // (k + 1)))
            for _, w in own:
                for i in range(length - q + 1):
                    grams[q][self.code(w[i : i + q])].append(len(self.classes))
            ids = np.array([w for _, w in own])
            keys = embed_keys(ids, self.reps)
            order = np.argsort(keys, axis=1)
            self.classes.append((length, k, q, max(1, length - q + 1 - k * q), [i for i, _ in own], ids, np.take_along_axis(keys, order, 1), order))
        self.codes = [np.unique(c[5] + np.arange(len(c[5]))[:, None] * (len(self.vocabulary) + 1)) for c in self.classes]
        self.margin = max((c[0] + 2 * c[1] for c in self.classes), default=0) + 1
        # for each q: the sorted codes, and for each code the classes (lengths) that have it
        self.grams = {}
        for q, found in grams.items():
            codes = np.array(sorted(found), np.int64)
            owner = [sorted(set(found[c])) for c in codes.tolist()]
            self.grams[q] = codes, np.concatenate([[0], np.cumsum([len(o) for o in owner])]), np.array([x for o in owner for x in o])

    def enough_words(self, c: int, item: np.ndarray, flat: np.ndarray, s: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Whether the surroundings of each start have as many of the item's words as a match needs."""
        length, k, own, base = self.classes[c][0], self.classes[c][1], self.codes[c], len(self.vocabulary) + 1
        out = np.zeros(len(s), bool)
        for at in range(0, len(s), 20_000):
            p = slice(at, at + 20_000)
            x = np.minimum(s[p, None] + np.arange(-k, length + 2 * k), len(flat) - 1)
            code = np.where(x >= first[p, None], flat[np.maximum(x, 0)], 0) + item[p, None] * base
            found = own[np.minimum(np.searchsorted(own, code), len(own) - 1)] == code
            out[p] = found.sum(axis=1) >= length - k
        return out

    def code(self, w) -> int:
        out = 0
        for x in w:
            out = out * 2_000_003 + int(x)
        return out

    def places(self, flat: np.ndarray) -> dict[int, np.ndarray]:
        """By class: where the count of shared q-grams allows a match to begin."""
        out = {}
        for q, (codes, first, owner) in self.grams.items():
            own = np.flatnonzero(flat[: len(flat) - q + 1] > 0)
            for j in range(1, q):
                own = own[flat[own + j] > 0]
            code = np.zeros(len(own), np.int64)
            for j in range(q):
                code = code * 2_000_003 + flat[own + j]
            at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            hit = codes[at] == code
            own, at = own[hit], at[hit]
            n = first[at + 1] - first[at]
            pos = np.repeat(own, n)
            cls = owner[np.repeat(first[at] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())]
            order = np.argsort(cls, kind="stable")
            pos, cls = pos[order], cls[order]
            if not len(cls):
                continue
            bounds = np.flatnonzero(np.append(True, cls[1:] != cls[:-1]))
            for b, e in zip(bounds, np.append(bounds[1:], len(cls)), strict=True):
                length, k, q_, need, *_ = self.classes[cls[b]]
                p = pos[b:e]
                if len(p) < need:
                    continue
                # window [s, s + length + k) with at least `need` of the places: s lies in (p[i + need - 1] - length - k + q, p[i]]
                lo, hi = p[need - 1 :] - (length + k - q_), p[: len(p) - need + 1]
                ok = lo <= hi
                if ok.any():
                    # before p[i-1] + 1 the earlier group of places already covers the start
                    spans = [np.arange(a, z + 1) for a, z in zip(lo[ok], hi[ok], strict=True)]
                    out[int(cls[b])] = np.unique(np.concatenate(spans))
        return out


def fit(items: np.ndarray, regions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of rows: (least edits that turn some stretch of the region into the item, where the first such stretch ends)."""
    steps = np.arange(regions.shape[1] + 1, dtype=np.int32)
    row = np.zeros((len(items), len(steps)), np.int32)
    for i in range(items.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        np.minimum(row[:, :-1] + (regions != items[:, i, None]), row[:, 1:] + 1, out=new[:, 1:])
        row = np.minimum.accumulate(new - steps, axis=1) + steps
    end = row.argmin(axis=1)
    return row[np.arange(len(row)), end], end


def search(items: Items, docs: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
    """(document's index, item id, first word, item's words, edits) for the best place of each item in each document."""
    if not items.classes:
        return
    gap = np.zeros(items.margin, np.int64)
    pieces, starts, ends, size = [gap], [], [], len(gap)
    for t in docs:
        w = words(t)
        starts.append(size)
        pieces += [np.fromiter(map(items.vocabulary.get, w, repeat(0)), np.int64, len(w)), gap]
        ends.append(size + len(w))
        size += len(w) + len(gap)
    flat, starts, ends = np.concatenate(pieces), np.array(starts, np.int64), np.array(ends, np.int64)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for c, s in items.places(flat).items():
        length, k, _, _, ids, known, keys, order = items.classes[c]
        # a start between two documents belongs to the one that follows
        doc = np.searchsorted(ends, s, "right")
        s, doc = s[doc < len(ends)], doc[doc < len(ends)]
        hits = []
        for at in range(0, len(s), 20_000):
            own = s[at : at + 20_000]
            found = embed_keys(flat[own[:, None] + np.arange(length)], items.reps)
            for r in range(items.reps):
                lo = np.searchsorted(keys[r], found[r], "left")
                n = np.searchsorted(keys[r], found[r], "right") - lo
                w = np.repeat(np.arange(len(own)), n)
                nth = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)
                hits.append(order[r][lo[w] + nth] * len(s) + at + w)
        hit = np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.int64)
        item, w = hit // max(len(s), 1), hit % max(len(s), 1)
        near = items.enough_words(c, item, flat, s[w], starts[doc[w]])
        item, w = item[near], w[near]
        exact = (flat[s[w][:, None] + np.arange(length)] == known[item]).all(axis=1)
        place = doc[w] * len(ids) + item
        rest = ~exact & ~np.isin(place, place[exact])  # an exact place is the best there is
        found = [(int(d), int(i), 0, int(at)) for d, i, at in zip(doc[w][exact], item[exact], s[w][exact], strict=True)]
        item, w = item[rest], w[rest]
        for at in range(0, len(w), 4096):
            i, d = item[at : at + 4096], doc[w[at : at + 4096]]
            low = np.maximum(s[w[at : at + 4096]] - k, starts[d])
            x = low[:, None] + np.arange(length + 3 * k)
            regions = np.where(x < len(flat), flat[np.minimum(x, len(flat) - 1)], 0)
            cost, end = fit(known[i], regions)
            ok = cost <= k
            if ok.any():
                # the same stretch read backwards ends where it begins
                back = np.where(np.arange(length + 3 * k) < end[ok, None], regions[ok], -1)[:, ::-1]
                begin = length + 3 * k - fit(known[i[ok]][:, ::-1], back)[1]
                found += zip(d[ok].tolist(), i[ok].tolist(), cost[ok].tolist(), (low[ok] + begin).tolist(), strict=True)
        for d, i, cost, start in found:
            new = (cost, max(0, start - int(starts[d])), length)
            best[d, ids[i]] = min(best.get((d, ids[i]), new), new)
    for (d, item), (cost, start, length) in sorted(best.items()):
        yield d, item, start, length, cost


def blocks(benchmark: DataFrame, most: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The query set in blocks of bounded size, streamed through the driver one partition at a time."""
    held, size = [], 0
    for r in benchmark.selectExpr("CAST(item_id AS long) AS item_id", "coalesce(text, '') AS text").toLocalIterator():
        if held and size + len(r.text) > most:
            yield held
            held, size = [], 0
        held.append((r.item_id, r.text))
        size += len(r.text)
    if held:
        yield held


def _match(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                b = whole.slice(at, TOGETHER)
                ids = b.column("doc_id").to_pylist()
                rows = [(ids[d], i, s, n, c, 1 - c / n) for d, i, s, n, c in search(items, b.column("text").to_pylist())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.int64()] * 5 + [pa.float64()], strict=True)], SCHEMA.replace(",", "").split()[::2])

    return run


def _spare(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                b = whole.slice(at, TOGETHER)
                hit = {d for d, *_ in search(items, b.column(b.schema.get_field_index("text")).to_pylist())}
                yield b.filter(pa.array([k not in hit for k in range(b.num_rows)]))

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row for each document and each item found in it. No shuffle: each block of items is one pass over the documents."""
    spark, out = docs.sparkSession, None
    for block in blocks(benchmark):
        found = texts(docs).mapInArrow(_match(spark.sparkContext.broadcast(Items(block, similarity, recall))), SCHEMA)
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], SCHEMA) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs``, all columns, in which no item is found."""
    for block in blocks(benchmark):
        docs = docs.mapInArrow(_spare(docs.sparkSession.sparkContext.broadcast(Items(block, similarity, recall))), docs.schema)
    return docs
