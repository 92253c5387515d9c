"""Log-bilinear language model, trained in numpy with noise-contrastive estimation.

The model's symbols are the ``WORDS`` most frequent words seen twice or more, one for all other words and one for the end of a text. They are dealt into
classes of like frequency, and the probability of w after u, v is that of its class times that of w inside the class, each a softmax over
log-bilinear scores: S[class] . q + s[class] and R[w] . q + b[w] with q = A[u] + B[v]. Both are normalised exactly, in batched matrix
products. A word without a symbol has the probability of the symbol for others times its smoothed share of their occurrences.

Texts are encoded once into files of symbols. Training has ``ROUNDS`` rounds over all training documents: in each, every task trains on its
own documents from the common parameters, which are then averaged by the number of tokens, chunk by chunk. Counts of all words come from one aggregation and stay distributed; only the ``HEAD`` most frequent go to the executors, the rest is joined.

Defined cases: null text is empty (the end alone); a null ``doc_id`` is not held out; repeated rows are scored each, and counted each
in training; without training documents counts are zero and the score equals the base; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions, scratch, texts

#: Words with a symbol, width of the vectors, noise classes a batch, noise words a class and batch, tokens a batch, step size.
WORDS, WIDTH, NOISE, BESIDE, BATCH, STEP = 8190, 16, 16, 4, 4096, 0.05
#: Passes over the training documents.
ROUNDS = 2
#: Most words whose counts are sent to the executors.
HEAD = 300_000
#: Words counted in a task before it hands them on; parameters in a chunk; tokens scored together, and at most in one product; parts of a range of counts.
COUNTED, CHUNK, TOGETHER, BLOCK, PARTS = 300_000, 4096, 1 << 15, 1024, 1024


def split(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, n = Counter(), 0

    def out(words, counts):
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(counts, pa.int64())], ["word", "c"])

    for b in batches:
        n += b.num_rows
        for t in b.column("text").to_pylist():
            seen.update(split(t))
            if len(seen) > COUNTED:
                yield out(list(seen), list(seen.values()))
                seen.clear()
    yield out([*seen, None], [*seen.values(), n])


def counts(train: DataFrame) -> DataFrame:
    """``word, c`` over all training documents; words are UTF-8 bytes, and the null word counts the documents."""
    return cut(train.select("text").mapInArrow(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")))


def head(c: DataFrame, n_words: int, most: int) -> Column:
    """A test for the ``most`` most frequent words: all above a count, and of those with that count the ones of smallest hash (or, by their
    spread, a few less). The count is found by splitting its range in ``PARTS``, again and again."""
    if n_words <= most:
        return F.lit(True)
    lo, hi, above = 1, int(c.agg(F.max("c")).first()[0]), 0
    tied = n_words
    while lo < hi:
        width = -(-(hi - lo + 1) // PARTS)
        sizes = {int(r.k): r.n for r in c.filter(F.col("c").between(lo, hi)).groupBy(F.floor((F.col("c") - lo) / width).alias("k")).agg(F.count("*").alias("n")).collect()}
        for k in sorted(sizes, reverse=True):
            if above + sizes[k] > most:
                lo, hi, tied = lo + k * width, min(hi, lo + (k + 1) * width - 1), sizes[k]
                break
            above += sizes[k]
    hashed, share = F.pmod(F.xxhash64("word"), F.lit(1 << 40)), (most - above) / tied
    same = c.filter(F.col("c") == lo)
    while (bound := int(share * (1 << 40))) and same.filter(hashed < bound).count() > most - above:
        share *= 0.98
    return (F.col("c") > lo) | ((F.col("c") == lo) & (hashed < bound))


class Parameters:
    """A, B (contexts), R, b (words), S, s (classes) of symbols sorted by falling count; ``edges`` bounds the classes."""

    def __init__(self, symbol_counts: np.ndarray):
        p = (symbol_counts + 1) / (symbol_counts + 1).sum()
        n = len(p)
        # classes of equal sums of square roots, which balances how many there are and how many words a class has
        upto = np.cumsum(np.sqrt(p))
        self.of = np.unique((upto / upto[-1] * math.ceil(math.sqrt(n))).astype(np.int64).clip(0, math.ceil(math.sqrt(n)) - 1), return_inverse=True)[1]
        self.edges = np.append(np.searchsorted(self.of, np.arange(self.of[-1] + 1)), n)
        own = np.add.reduceat(p, self.edges[:-1])
        rng = np.random.default_rng(1)
        start = lambda k: (rng.standard_normal((k, WIDTH)) * 0.05).astype(np.float32)
        self.noise = own
        self.tables = [start(n), start(n), start(n), np.log(p / own[self.of]).astype(np.float32), start(len(own)), np.log(own).astype(np.float32)]

    def flat(self) -> np.ndarray:
        return np.concatenate([t.ravel() for t in self.tables])

    def filled(self, flat: np.ndarray) -> Parameters:
        new = object.__new__(Parameters)
        new.of, new.edges, new.noise = self.of, self.edges, self.noise
        ends = np.cumsum([t.size for t in self.tables])
        new.tables = [x.reshape(t.shape).astype(np.float32) for x, t in zip(np.split(flat, ends[:-1]), self.tables, strict=True)]
        return new

    def log_p(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """log P(w | u, v), ``v`` the nearer."""
        a, b, r, bias, s, s_bias = self.tables
        words, classes = (np.column_stack(t) for t in ((r, bias), (s, s_bias)))
        out = np.empty(len(w))
        for at in range(0, len(w), TOGETHER):
            # in the order of the words, and so of the classes; a last column of ones takes in the biases
            order = np.argsort(w[at : at + TOGETHER].astype(np.uint16), kind="stable") + at
            x = w[order]
            q, k = np.ones((len(x), WIDTH + 1), np.float32), self.of[x]
            np.add(a[u[order]], b[v[order]], out=q[:, :WIDTH])
            own = np.empty(len(x))
            for i in range(0, len(x), BLOCK):
                own[i : i + BLOCK] = _log_softmax(q[i : i + BLOCK], classes, k[i : i + BLOCK])
            starts = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(x)], strict=True):
                lo, hi = self.edges[k[i]], self.edges[k[i] + 1]
                if hi - lo > 1:
                    for i2 in range(i, j, BLOCK):
                        j2 = min(j, i2 + BLOCK)
                        own[i2:j2] += _log_softmax(q[i2:j2], words[lo:hi], x[i2:j2] - lo)
            out[order] = own
        return out


def _log_softmax(q: np.ndarray, table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of the scores ``q . table``, the log of the softmax at ``at``. Scores of moderate size need no shift to keep their exponentials finite."""
    scores = q @ table.T
    own = scores[np.arange(len(at)), at]
    if max(scores.max(), -scores.min()) > 60:
        top = scores.max(axis=1)
        own -= top
        scores -= top[:, None]
    np.exp(scores, out=scores)
    return own - np.log(scores @ np.ones(scores.shape[1], np.float32))


def _sums(at: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct places of ``at`` and the sums of the rows of ``g`` there."""
    order = np.argsort(at.astype(np.uint16), kind="stable")
    return _runs(at[order], g.take(order, axis=0))


def _runs(at: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`_sums` of places in order."""
    starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return at[starts], np.add.reduceat(g, starts, axis=0)


class Trainer:
    """Noise-contrastive estimation for the class and for the word in its class, and AdaGrad steps.

    Noise classes come from their frequencies and are shared by a batch; noise words are evenly drawn from their class and shared by the
    batch's tokens of that class.
    """

    def __init__(self, start: Parameters, seed: int):
        self.p, self.rng, self.n = start.filled(start.flat()), np.random.default_rng(seed), 0
        self.square = [np.full(t.shape, 1e-5, np.float32) for t in self.p.tables]  # low, as few tokens of a batch are of a rare word
        self.upto, self.log_noise = np.cumsum(start.noise), np.log(NOISE * start.noise).astype(np.float32)
        self.sizes = np.diff(start.edges)
        self.log_beside = np.log(BESIDE / self.sizes).astype(np.float32)

    def _step(self, table: int, rows: np.ndarray, g: np.ndarray) -> None:
        g = g / np.float32(BATCH)
        t, s = self.p.tables[table], self.square[table]
        now = g * g
        now += s.take(rows, axis=0)
        s[rows] = now
        g *= np.float32(STEP)
        g /= np.sqrt(now, out=now)
        t[rows] += g

    def learn(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> None:
        """One batch: symbols ``w`` after ``u``, ``v`` (``v`` the nearer), worked on in the order of the words, and so of the classes."""
        a, b, r, bias, s, s_bias = self.p.tables
        order = np.argsort(w.astype(np.uint16), kind="stable")
        u, v, w = u[order], v[order], w[order]
        n, k = len(w), self.p.of[w]
        q = a.take(u, axis=0)
        q += b.take(v, axis=0)
        noise = np.minimum(np.searchsorted(self.upto, self.rng.random(NOISE)), len(self.upto) - 1)
        beside = self.p.edges[:-1, None] + (self.rng.random((len(self.sizes), BESIDE)) * self.sizes[:, None]).astype(np.int64)
        starts = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        classes, bounds = k[starts], list(zip(starts.tolist(), [*starts[1:].tolist(), n], strict=True))
        sk, sn, rw, rn = s.take(k, axis=0), s[noise], r.take(w, axis=0), r[beside[classes]]
        pull = 1 / (1 + np.exp(np.einsum("nd,nd->n", q, sk) + (s_bias - self.log_noise)[k]))
        push = -1 / (1 + np.exp((self.log_noise - s_bias)[noise] - q @ sn.T))
        # a class of one word has nothing to tell apart
        several = (self.sizes > 1).astype(np.float32)[k]
        pull_w = several / (1 + np.exp(np.einsum("nd,nd->n", q, rw) + bias[w] - self.log_beside[k]))
        score = np.empty((n, BESIDE), np.float32)
        for (lo, hi), x in zip(bounds, rn, strict=True):
            np.dot(q[lo:hi], x.T, out=score[lo:hi])
        push_w = -several[:, None] / (1 + np.exp((self.log_beside[:, None] - bias[beside])[k] - score))
        # by class: what its noise words teach the contexts, and what these learn themselves
        gq, g_beside = np.empty((n, WIDTH), np.float32), np.empty((len(classes), BESIDE, WIDTH), np.float32)
        for i, (lo, hi) in enumerate(bounds):
            np.dot(push_w[lo:hi], rn[i], out=gq[lo:hi])
            np.dot(push_w[lo:hi].T, q[lo:hi], out=g_beside[i])
        sk *= pull[:, None]
        rw *= pull_w[:, None]
        gq += sk
        gq += rw
        gq += push @ sn
        self._step(0, *_sums(u, gq))
        self._step(1, *_sums(v, gq))
        words, g = _runs(w, np.column_stack([pull_w[:, None] * q, pull_w]))
        self._step(2, words, g[:, :WIDTH])
        self._step(3, words, g[:, WIDTH])
        pushed = np.add.reduceat(push_w, starts, axis=0)
        places, g = _sums(beside[classes].ravel(), np.column_stack([g_beside.reshape(-1, WIDTH), pushed.ravel()]))
        self._step(2, places, g[:, :WIDTH])
        self._step(3, places, g[:, WIDTH])
        g = np.add.reduceat(np.column_stack([pull[:, None] * q, pull]), starts, axis=0)
        classes, g = _sums(np.append(classes, noise), np.concatenate([g, np.column_stack([push.T @ q, push.sum(axis=0)])]))
        self._step(4, classes, g[:, :WIDTH])
        self._step(5, classes, g[:, WIDTH])
        self.n += n


def contexts(texts_: list[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, w) of all tokens of texts that are given as symbols with the end; before a text stand two ends."""
    w = np.concatenate(texts_).astype(np.int64)
    starts = np.cumsum([0, *map(len, texts_[:-1])])
    v = np.append(end, w[:-1])
    v[starts] = end
    u = np.append(end, v[:-1])
    u[starts] = end
    return u, v, w


def _train(shared, end: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        trainer, held, size = Trainer(shared.value, seed + TaskContext.get().partitionId()), [], 0

        def learn(least: int):
            nonlocal held, size
            u, v, w = (np.concatenate(x) for x in zip(*held, strict=True))
            order = trainer.rng.permutation(len(w))
            full = len(w) - len(w) % BATCH if least > 1 else len(w)
            for at in range(0, full, BATCH):
                k = order[at : at + BATCH]
                trainer.learn(u[k], v[k], w[k])
            k = order[full:]
            held, size = [(u[k], v[k], w[k])], len(k)

        for b in batches:
            found = [np.frombuffer(x, np.uint16) for x in b.column("symbols").to_pylist()]
            at = 0
            while at < len(found):
                some = []
                while at < len(found) and size < 32 * BATCH:
                    some.append(found[at])
                    size += len(found[at])
                    at += 1
                if some:
                    held.append(contexts(some, end))
                if size >= 32 * BATCH:
                    learn(BATCH)
        if size:
            learn(1)
        if trainer.n:
            flat = trainer.p.flat().astype("<f4")
            chunks = [flat[k : k + CHUNK].tobytes() for k in range(0, len(flat), CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(chunks)), pa.int32()), pa.array([float(trainer.n)] * len(chunks)), pa.array(chunks, pa.binary())], ["chunk", "n", "p"])

    return run


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums chunk by chunk as they come: memory holds one sum for each chunk of this part."""
    sums: dict[int, list] = {}
    for b in batches:
        for k, n, p in zip(b.column("chunk").to_pylist(), b.column("n").to_pylist(), b.column("p").to_pylist(), strict=True):
            x = np.frombuffer(p, "<f4").astype(np.float64) * n
            if k in sums:
                sums[k][0] += n
                sums[k][1] += x
            else:
                sums[k] = [n, x]
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([(x / n).astype("<f4").tobytes() for n, x in sums.values()], pa.binary())], ["chunk", "p"])


def fit(encoded: DataFrame, start: Parameters, end: int) -> Parameters:
    """``ROUNDS`` rounds over all training documents; each ends in an average of what the tasks learned."""
    spark = encoded.sparkSession
    train = encoded.filter("NOT held_out").select("symbols")
    for k in range(ROUNDS):
        shared = spark.sparkContext.broadcast(start)
        found = train.mapInArrow(_train(shared, end, 100_003 * k), "chunk int, n double, p binary")
        rows = found.repartition(partitions(spark), "chunk").mapInArrow(_average, "chunk int, p binary").collect()
        if rows:
            start = start.filled(np.concatenate([np.frombuffer(r.p, "<f4") for r in sorted(rows, key=lambda r: r.chunk)]))
    return start


@dataclass
class Vocabulary:
    """The most frequent words with their counts, by falling count; the symbols; and the corpus' sums."""

    words: list[bytes]
    c: np.ndarray
    n_words: int
    n_docs: int
    n_distinct: int

    def __post_init__(self):
        # words seen once stand for those never seen
        own = self.c[:WORDS][self.c[:WORDS] > 1]
        others = self.n_words - int(own.sum())
        # symbols by falling count; the last two rows before sorting are the symbol of other words and the end
        every = np.concatenate([own, [others, self.n_docs]])
        order = np.argsort(-every, kind="stable")
        self.symbol_counts = every[order]
        symbol = np.empty(len(every), np.int64)
        symbol[order] = np.arange(len(every))
        self.symbol, self.unknown, self.end = symbol[:-2], int(symbol[-2]), int(symbol[-1])
        self.denominator = self.n_words + self.n_docs + self.n_distinct + (self.n_docs > 0) + 1
        # all words without a symbol, with one more for those never seen
        self.outside = float(others + (self.n_distinct - len(own)) + 1)


def _encode(shared):
    names = ["doc_id", "n_tokens", "n_head", "base_head", "share_head", "rest", "symbols"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = shared.value
        known = {w: i for i, w in enumerate(v.words)}
        none = len(v.words)
        log_base = np.append(np.log10((v.c + 1) / v.denominator), 0.0)
        log_share = np.append(np.where(np.arange(none) < len(v.symbol), 0.0, np.log10((v.c + 1) / v.outside)), 0.0)
        symbols = np.full(none + 1, v.unknown, np.uint16)
        symbols[: len(v.symbol)] = v.symbol
        base_end = math.log10((v.n_docs + 1) / v.denominator)
        for batch in batches:
            rows = []
            for t in batch.column("text").to_pylist():
                w = split(t)
                at = np.fromiter(map(known.get, w, repeat(none)), np.int64, len(w))
                unseen = np.flatnonzero(at == none)
                rows.append((len(w) + 1, len(w) - len(unseen), float(log_base[at].sum()) + base_end, float(log_share[at].sum()), [w[i] for i in unseen], np.append(symbols[at], np.uint16(v.end)).tobytes()))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    return run


def _score(shared, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Parameters = shared.value
        for b in batches:
            found, out = [np.frombuffer(x, np.uint16) for x in b.column("symbols").to_pylist()], []
            at = 0
            while at < len(found):
                some, size = [], 0
                while at < len(found) and (not some or size + len(found[at]) <= 8 * TOGETHER):
                    some.append(found[at])
                    size += len(found[at])
                    at += 1
                out.append(np.add.reduceat(p.log_p(*contexts(some, end)), np.cumsum([0, *map(len, some[:-1])])))
            if out:
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("row", "doc_id", "held_out", "n_tokens", "n_head", "base_head")), pa.array(np.concatenate(out) / math.log(10) + b.column("share_head").to_numpy())], ["row", "doc_id", "held_out", "n_tokens", "n_head", "base_head", "lm_head"])

    return run


def learned(docs: DataFrame) -> tuple[DataFrame, DataFrame, Vocabulary, Parameters]:
    """(texts as symbols, counts outside the head, vocabulary, fitted parameters)."""
    spark = docs.sparkSession
    d = texts(docs)
    every = counts(d.filter(~held_out()))
    c = every.filter("word IS NOT NULL")
    n_docs = every.filter("word IS NULL").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    n_words, distinct = c.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    frequent = head(c, distinct, HEAD)
    top = c.filter(frequent).toPandas().sort_values(["c", "word"], ascending=[False, True])
    v = Vocabulary([bytes(w) for w in top["word"]], top["c"].to_numpy(np.int64), int(n_words), int(n_docs), int(distinct))
    path = scratch(spark, "symbols")
    encoded = d.mapInArrow(_encode(spark.sparkContext.broadcast(v)), "doc_id long, n_tokens long, n_head long, base_head double, share_head double, rest array<binary>, symbols binary")
    encoded.select(F.monotonically_increasing_id().alias("row"), held_out().alias("held_out"), "*").write.parquet(path)
    encoded = spark.read.parquet(path)
    p = Parameters(v.symbol_counts)
    return encoded, c.filter(~frequent), v, fit(encoded, p, v.end) if n_docs else p


def score(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row."""
    encoded, others, v, p = learned(docs)
    shared = docs.sparkSession.sparkContext.broadcast(p)
    s = encoded.select("row", "doc_id", "held_out", "n_tokens", "n_head", "base_head", "share_head", "symbols")
    s = s.mapInArrow(_score(shared, v.end), "row long, doc_id long, held_out boolean, n_tokens long, n_head long, base_head double, lm_head double")
    rest = encoded.select("row", F.explode("rest").alias("word")).join(others, "word", "left")
    f = F.coalesce("c", F.lit(0)) + 1
    rest = rest.groupBy("row").agg(F.count("c").alias("known"), F.sum(F.log10(f / F.lit(float(v.denominator)))).alias("base"), F.sum(F.log10(f / F.lit(v.outside))).alias("lm"))
    zero = lambda x: F.coalesce(x, F.lit(0))
    base = F.col("base_head") + zero("base")
    return s.join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_head") + zero("known") + int(v.n_docs > 0)).cast("long").alias("n_known"), F.lit(v.n_words + v.n_docs).cast("long").alias("train_tokens"),
        base.alias("base_score"), (F.col("lm_head") + zero("lm") if v.n_docs else base).alias("score"),
    )
