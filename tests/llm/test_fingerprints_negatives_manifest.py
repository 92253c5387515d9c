"""Document fingerprints, hard negatives and the Merkle manifest against brute force, and their edge cases."""

import hashlib
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parents[1]))

from tallyglass.llm import fingerprint, merkle, negatives, queries  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, hash string, pos string, node string, next string"


def docs(spark, rows):
    """(doc_id, text, lang); further columns have names that the operators use inside."""
    return spark.createDataFrame([(i, t, g, "s", len(t or ""), "h", "p", "n", "x") for i, t, g in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{k % 977}x{k}" for k in range(30_000))
    same = "la " * 20_000
    return docs(spark, [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "one", "b"), (4, "one", "b"), (4, "One two", None), (None, "one two three four", "b"), (5, long, "c"), (6, long, "c"), (9, same, "Ü"), (7, "É a b c d e f g\n" * 40, "")])


# fingerprints


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def shingles(t):
    w = words(t)
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({" ".join(w)} if w else set())


def sketch(t):
    return sorted({hashlib.md5(s.encode()).hexdigest()[:12] for s in shingles(t)})[:128]


def near(a, b):
    both = sorted({*a, *b})[:128]
    return len(set(both) & set(a) & set(b)) / len(both) if both else 1.0


def want_fingerprints(rows):
    order = sorted(((i, t or "") for i, t, *_ in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        a, b, c = sketch(t), sketch(edited), sketch(nxt)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), "".join(a), "".join(b), near(a, b), near(a, c)))
    return sorted(out, key=repr)


def got_fingerprints(df):
    return sorted((tuple(r)[:7] for r in fingerprint.compare_edited(df).collect()), key=repr)


@pytest.mark.parametrize("n", [2, 7])
def test_fingerprints_brute(spark, sf, n):
    """Whatever the number of ranges of ids."""
    some = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        assert got_fingerprints(some) == want_fingerprints([tuple(r) for r in some.collect()])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_fingerprints_edge_cases(spark, odd):
    got = got_fingerprints(odd.filter("doc_id <> 4 OR text = 'One two' OR doc_id IS NULL"))
    assert got == want_fingerprints([tuple(r)[:2] for r in odd.filter("doc_id <> 4 OR text = 'One two' OR doc_id IS NULL").collect()])
    assert fingerprint.compare_edited(odd).count() == 11 and fingerprint.compare_edited(odd.limit(0)).count() == 0
    alone = fingerprint.compare_edited(docs(spark, [(3, "a b c d e f", "a")])).first()
    assert alone.near_next == 1 and alone.n_chars == 11
    by = {(r.doc_id, r.fingerprint) for r in fingerprint.fingerprints(odd).collect()}
    assert len({f for i, f in by if i in (5, 6)}) == 1 and {f for i, f in by if i in (1, 2, 3)} == {""}


def test_estimates_and_merged_parts(spark):
    """Resemblance, containment and distinct shingles within four standard errors; the sketch of parts is the sketch of the whole."""
    rng = np.random.default_rng(5)
    w = [f"v{k}" for k in rng.integers(0, 10**9, 6000)]
    a, b = " ".join(w[:4000]), " ".join(w[1000:])
    parts = [(0, " ".join(w[:2000]), "a"), (0, " ".join(w[1996:4000]), "a"), (1, b, "b"), (1, b, "b"), (2, None, "c")]
    s = fingerprint.with_sketch(docs(spark, parts).select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "sketch")
    whole = {r.doc_id: r.sketch for r in fingerprint.merge_by(s, "doc_id").collect()}
    assert whole == {0: sketch(a), 1: sketch(b), 2: []}
    two = fingerprint.with_likeness(spark.createDataFrame([(whole[0], whole[1])], "a array<string>, b array<string>"), "a", "b", "j")
    r = two.select("j", fingerprint.containment(F.col("a"), F.col("j"), F.col("j_both")).alias("c"), fingerprint.distinct_shingles(F.col("a")).alias("n")).first()
    assert abs(r.j - 0.5) < 0.18 and abs(r.c - 0.75) < 0.3 and abs(r.n / 3996 - 1) < 0.36
    assert two.select(fingerprint.merged(F.col("a"), F.col("b")).alias("m")).first().m == sketch(" ".join(w))


# hard negatives


def brute_negatives(rows):
    use = [(i, (lb + 1) % 10 if i % 7 == 0 else lb, [int(np.floor(256.0 * float(x))) for x in v]) for i, lb, v in rows if i is not None and lb is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, la, va in use:
        if a % 100:
            continue
        s = sorted(((-sum(x * y for x, y in zip(va, v, strict=True)), i, lb) for i, lb, v in use if i != a and len(v) == len(va)))
        for ps, p, _ in [x for x in s if x[2] == la][:5]:
            inside = [(n, i) for n, i, lb in s if lb != la and 80 * -ps <= 100 * -n <= 100 * -ps]
            out += [(a, p, k + 1, i, -ps, -n) for k, (n, i) in enumerate(inside[:5])]
    return sorted(out)


EMB = "vec_id long, label int, embedding array<float>, v string, score string, anchor string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, lb, v, "v", "s", "a") for i, lb, v in rows], EMB)


def test_negatives_brute(spark):
    """Ties, copies, nulls, odd lengths and vectors of several scales."""
    rng = np.random.default_rng(2)
    f = lambda x: [float(y) for y in np.float32(x)]
    base = rng.normal(size=(12, 6))
    rows = [(k, int(rng.integers(0, 3)), f(base[k % 12] + rng.normal(size=6) * 0.1 * (k % 3))) for k in range(420)]
    rows += [(1000 + k, k % 10, f([1000.0 * x for x in rng.normal(size=7)])) for k in range(201)]
    rows += [(None, 1, f(base[0])), (2001, None, f(base[0])), (2002, 1, None), (2003, 1, [None, 1.0]), (2004, 1, [float("nan")] * 6), (2005, 1, [float("inf")] * 6), (2100, 1, []), (2101, 2, []), (2102, 1, []), (2200, 3, f(np.zeros(6)))]
    got = sorted(tuple(r) for r in negatives.hard_negatives(vectors(spark, rows).repartition(5)).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    assert got == brute_negatives(rows) and len(got) > 40
    assert negatives.hard_negatives(vectors(spark, rows).limit(0)).count() == 0


def test_scores_are_exact_at_any_scale():
    rng = np.random.default_rng(0)
    for most, d in ((100, 64), (1000, 1500), (10**6, 64), (10**8, 300), (10**9, 1)):
        x, y = (np.floor(rng.uniform(-most, most, (n, d))) for n in (20, 30))
        y[:5], y[5:10] = x[:5], -x[:5]
        want = x.astype(np.int64).astype(object) @ y.astype(np.int64).astype(object).T
        assert (negatives.scores(negatives.Residues(x), negatives.Residues(y), slice(0, 30)) == want).all()
    with pytest.raises(ValueError):
        negatives.primes_for(2.0**62)


def test_best_breaks_ties_to_the_left():
    s = np.array([[5, 7, 7, 7, 1], [0, 0, 0, 0, 0]])
    for scale in (1, 2**60):
        rows, columns = negatives.best(s * scale, np.array([[True, True, False, True, True], [False, True, True, True, False]]), 2)
        assert list(zip(rows.tolist(), columns.tolist(), strict=True)) == [(0, 1), (0, 3), (1, 1), (1, 2)]


# manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def want_leaf(*fields):
    return h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + 8]) for k in range(0, len(levels[-1]), 8)])
    return levels


def way(levels, p):
    out = []
    for level in levels[:-1]:
        run = level[p // 8 * 8 : p // 8 * 8 + 8]
        out.append((run[: p % 8], run[p % 8 + 1 :]))
        p //= 8
    return out


def brute_manifest(rows):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    by = {}
    for i, t, g, s, n in rows:
        seen = t.translate(low) if t is not None and i is not None and zlib.crc32(str(i).encode()) % 3 == 0 else t
        by.setdefault(g, []).append((i, want_leaf(i, s, g, n, t), want_leaf(i, s, g, n, seen)))
    langs = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    for g in langs:
        by[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    trees = {g: tree([x[1] for x in by[g]]) for g in langs}
    top = tree([trees[g][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for p, (i, own, seen) in enumerate(by[g]):
            steps, node = way(trees[g], p) + way(top, k), seen
            for a, b in steps:
                node = h(*a, node, *b)
            root = top[-1][0]
            out.append((i, own, trees[g][-1][0], root, h(*(x for a, b in steps for x in a + b)), node, node == root))
    return sorted(out, key=repr)


def got_manifest(df):
    return sorted((tuple(r) for r in merkle.audit(df).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def test_manifest_brute(spark, sf, odd):
    for d in (spark.read.parquet(f"{sf}/documents.parquet"), odd):
        assert got_manifest(d) == brute_manifest([tuple(r) for r in d.select("doc_id", "text", "lang", "source", "n_chars").collect()])
    assert merkle.audit(odd.limit(0)).count() == 0 and merkle.build(odd.limit(0)).root is None


@pytest.mark.parametrize("n", [1, 65, 513, 4700])
def test_manifest_of_any_height(spark, n):
    """One language holds nearly all; its top level ends inside, at or beyond a stored one."""
    rows = [(k, f"T{k}", "de") for k in range(n)] + [(10**6 + k, "t", f"l{k}") for k in range(n % 11)]
    d = docs(spark, rows).repartition(3)
    assert got_manifest(d) == brute_manifest([(i, t, g, "s", len(t)) for i, t, g in rows])


def test_stored_levels_and_proofs_of_some(spark):
    """Only every third level is stored; proofs of a few documents equal theirs among all."""
    d = docs(spark, [(k, f"t{k}", "de" if k % 5 else None) for k in range(5000)])
    m = merkle.build(d)
    assert [x.count() for x in m.levels] == [5000, 8 + 2, 1 + 1]
    every = {r.doc_id: tuple(r) for r in m.proofs().collect()}
    some = m.proofs(spark.createDataFrame([(7,), (4999,), (4999,), (70_000,)], "doc_id long")).collect()
    assert sorted(r.doc_id for r in some) == [7, 4999] and all(tuple(r) == every[r.doc_id] for r in some)
    assert m.root == every[7][4]


@pytest.mark.parametrize("name", ["op11_document_fingerprints", "op12_hard_negatives", "op13_merkle_manifest"])
def test_queries_have_rows(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0 and name in queries.ORACLES
