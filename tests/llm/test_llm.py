"""The training-data operators: SQL checks, brute force, and defined results on edge cases."""

import os
import re
import subprocess
import sys
import time
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parents[1]))
from oracle import check, connect  # noqa: E402

from tallyglass.llm import decontam, licenses, linededup, lm, mixing, passages, quality, queries, simhash, tokenbin, warc  # noqa: E402
from tallyglass.llm.components import components  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, words string, rules string"


def docs(spark, rows):
    """Documents with further columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "r", "w", "x") for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{k % 977}x{k}" for k in range(30_000))
    return docs(spark, [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "one", "b"), (4, "one", "b"), (None, "one two three four", "b"), (5, long, "c"), (6, long, "c"), (7, "a b c\n" * 40, "a")])


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, [])


@pytest.fixture(scope="module")
def some(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def bench(spark, sf):
    return spark.read.parquet(f"{sf}/benchmark.parquet")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, sf, name):
    check(queries.QUERIES[name](spark, sf), connect(sf), queries.ORACLES[name])


def test_edge_cases_run(spark, odd, none, bench):
    for d, n in ((odd, 9), (none, 0)):
        assert quality.judge(d).count() == n
        assert simhash.near_duplicates(d).count() == n
        assert licenses.license_scan(d).count() == n
        assert tokenbin.round_trip(d).count() == n
        assert lm.score(d).count() == n
        assert linededup.dedup_lines(d).count() == n
        assert mixing.mix(d, keep_all=True, entropy=None, max_epochs=1.0).count() == n
        assert mixing.mix(d, keep_all=True, entropy=None).columns == d.columns
        assert quality.keep_good(d).columns == simhash.keep_one(d).columns == decontam.clean(d, bench).columns == d.columns
        assert decontam.contaminated(d, bench).count() == 0
        assert passages.near_passages(d).count() == (1 if n else 0)
    assert decontam.contaminated(odd, bench.limit(0)).count() == 0
    assert decontam.clean(odd, bench.limit(0)).count() == 9


def test_quality_by_hand(spark):
    text = " ".join(f"the word{k} of" for k in range(30))
    got = {r.doc_id: r for r in quality.judge(docs(spark, [(1, text, "a"), (2, "a b c a b c", "a"), (3, "x\ny\nx\n\n \nx", "a"), (4, None, "a"), (5, text + " ### $$$" * 20, "a")])).collect()}
    assert got[1].kept and got[1].n_words == 90
    assert got[2].n_repeat_words == 6 and got[2].base_failed
    assert got[3].n_dup_lines == 2 and got[4].n_words == 0 and not got[4].kept
    assert "symbols" in got[5].failed_rules


def test_quality_of_long_texts_sorts_whole_hashes(spark, some, odd, monkeypatch):
    short, more = sorted(map(tuple, quality.judge(some).collect())), sorted(map(repr, quality.judge(odd).collect()))
    monkeypatch.setattr(quality, "LONG", 20)
    assert sorted(map(tuple, quality.judge(some).collect())) == short and sorted(map(repr, quality.judge(odd).collect())) == more
    assert any(r[5] for r in short)


@pytest.mark.parametrize("n", [8_000, 400_000, 600_000])
def test_quality_counts_repeats_of_long_texts(spark, n):
    """One window comes twice, one three times; all others once."""
    w = [f"w{k}" for k in range(n)] + ["w5", "w6", "w7", "x", "w90", "w91", "w92", "y", "w90", "w91", "w92"]
    got = quality.judge(docs(spark, [(1, " ".join(w), "a")])).first()
    assert got.n_words == n + 11 and got.n_repeat_words == 15


def test_quality_keeps_good_labels(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    j = quality.judge(spark.read.parquet(f"{sf}/documents.parquet")).filter("n_words >= 50").join(labels, "doc_id")
    assert j.filter("quality = 1 AND NOT kept").count() == 0 and j.filter("quality = 0 AND kept").count() == 0


def brute_fingerprint(text):
    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum((2 * sum(h >> b & 1 for h in hs) > len(hs)) << b for b in range(64))


def components_of(n, near):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(n):
        for j in range(i):
            if near(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash_brute(spark, some):
    rows = some.orderBy("doc_id").collect()
    fp = [brute_fingerprint(r.text) for r in rows]
    root = components_of(len(rows), lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 3)
    want = {(r.doc_id, f"{f:016x}", rows[k].doc_id) for r, f, k in zip(rows, fp, root, strict=True)}
    assert {tuple(r) for r in simhash.near_duplicates(some).collect()} == want
    assert simhash.keep_one(some).count() == len(set(root))


def test_pigeonhole_finds_all_links_of_a_dense_group(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 3)
    fps = {int(b) for b in base}
    for b in base:
        x = int(b)
        for _ in range(120):
            x ^= 1 << int(rng.integers(0, 62))
            fps.add(x)
    fps = sorted(fps)
    root = components_of(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    d = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {r.node: r.root for r in components(simhash.links(d)).collect()}
    assert [got.get(f, f) for f in fps] == [fps[k] for k in root]
    n, both = simhash.statistics(d)
    for m in range(2, 7):
        groups = simhash.group_bits(n, both, m)
        assert sorted(b for g in groups for b in g) == list(range(64))
        assert sum(simhash.thresholds(10**9, both, groups)[1]) == simhash.RADIUS - m + 1


def word_distance(a, b):
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination_brute(spark, some, bench):
    items = [(r.item_id, r.text) for r in bench.collect()]
    rows = [(r.doc_id, r.text) for r in some.collect() if len(r.text) < 3000]
    rng = np.random.default_rng(1)
    for k, (_, t) in enumerate(items[:20]):
        w = t.split()
        for _ in range(int(0.15 * len(w))):
            w[int(rng.integers(0, len(w)))] = f"zz{k}"
        rows.append((10_000 + k, "Before it. " + " ".join(w) + " After it."))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    words = {i: decontam.words(t) for i, t in items}
    want = set()
    for doc, t in rows:
        w = decontam.words(t)
        seen = set(w)
        for i, x in words.items():
            if sum(y in seen for y in x) >= 0.8 * len(x) and word_distance(x, w) <= int(0.2 * len(x) + 1e-9):
                want.add((doc, i))
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(d, bench).collect()}
    assert set(got) == want and len(want) >= 20
    assert all(r.distance == word_distance(words[i], decontam.words(dict(rows)[doc])) for (doc, i), r in got.items())
    assert {r.doc_id for r in decontam.clean(d, bench).collect()} == {doc for doc, _ in rows} - {doc for doc, _ in want}


@pytest.mark.parametrize("length", [5, 10, 20, 40, 80, 160, 320])
def test_decontamination_recall_at_the_limit(length):
    rng = np.random.default_rng(length)
    items, texts, k = [], [], int(0.2 * length + 1e-9)
    for n in range(60):
        w = [f"a{x}" for x in rng.integers(0, 1 << 40, length)]
        items.append((n, " ".join(w)))
        for _ in range(k):
            at, kind = int(rng.integers(0, len(w))), int(rng.integers(0, 3))
            w[at : at + (kind != 0)] = [] if kind == 2 else [f"e{rng.integers(0, 1 << 40)}"]
        texts.append(" ".join([f"b{x}" for x in rng.integers(0, 1 << 40, 30)] + w + [f"c{x}" for x in rng.integers(0, 1 << 40, 30)]))
    found = {(d, i) for d, i, *_ in decontam.search(decontam.Items(items, decontam.SIMILARITY, decontam.RECALL), texts)}
    assert sum((n, n) in found for n in range(60)) >= 59


def test_decontamination_says_when_the_recall_is_out_of_reach():
    with pytest.raises(ValueError):
        decontam.repetitions(0.9999999, 0.3)


def test_tokens_round_trip(spark, some):
    from tokenizers import Tokenizer

    d = some.select("doc_id", "text").union(spark.createDataFrame([(5000, "a ❤ b❤ x  y é́ Σας <|endoftext|> don't"), (5001, None), (5001, "")], "doc_id long, text string"))
    t, at, want = Tokenizer.from_file(tokenbin.default_vocabulary()), 0, []
    for r in d.orderBy("doc_id", F.coalesce("text", F.lit(""))).collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [2]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [tuple(r) for r in tokenbin.round_trip(d).orderBy("start").collect()] == want


def wording(template, keep=lambda k: True, fill=1):
    """A text that the template stands for: the optional regions that ``keep`` names, and ``fill`` words in each replaceable one."""
    out = []
    for k, (kind, v) in enumerate(licenses.parse(template)):
        out += v if kind == "words" else (v if keep(k) else []) if kind == "opt" else ["anyone"] * min(v, fill)
    return out


def test_license_phrases(spark):
    mit = dict(licenses.TEMPLATES)["mit-text"]
    texts = {1: "Licensed under the Apache License, Version 2.0.", 2: "licensed under the MIT license", 3: "MIT License MIT license", 4: "under the apache of licenses", 5: "Copyright x. " + " ".join(wording(mit)).upper() + ".", 6: " ".join(wording(mit)[:120]), 7: None, 8: ""}
    got = {r.doc_id: r for r in licenses.license_scan(docs(spark, [(k, v, "a") for k, v in texts.items()])).collect()}
    assert {k: got[k].labels for k in texts} == {1: "apache,apache-2.0", 2: "mit", 3: "mit", 4: "", 5: "mit-text", 6: "", 7: "", 8: ""}
    assert (got[3].n_base, got[3].first_word, got[3].last_word) == (2, 0, 2) and got[5].score == 1.0 and got[7].n_words == 0
    with pytest.raises(ValueError):
        licenses.Automaton("<<opt a>> b")


@pytest.mark.parametrize("n", range(len(licenses.TEMPLATES)), ids=lambda n: licenses.TEMPLATES[n][0])
def test_license_templates_hold_their_mandatory_wording(n):
    _, template = licenses.TEMPLATES[n]
    a, p, parts = licenses.Automaton(template), re.compile(licenses.pattern(template)), licenses.parse(template)

    def accepted(words):
        found = a.accepts([x.encode() for x in words], 0)
        assert found == bool(p.match(" " + " ".join(words) + " "))
        return found

    for left_out in (None, *(k for k, (kind, _) in enumerate(parts) if kind == "opt")):
        for fill in (0, 1, 99):
            assert accepted(wording(template, lambda k: k != left_out, fill))
    assert accepted(wording(template, lambda k: False))
    at = 0
    for k, (kind, v) in enumerate(parts):
        for i in range(len(v)) if kind == "words" else []:
            w = wording(template, lambda k: False, 0)
            w[at + i] = "changed"
            assert not accepted(w), (k, i)
        at += len(v) if kind == "words" else 0
        if kind == "var" and k + 1 < len(parts) and parts[k + 1][0] == "words":
            long = [x for j, (kind2, v2) in enumerate(parts) for x in (v2 if kind2 == "words" else ["q"] * (v2 + 1) if j == k else [])]
            assert not accepted(long)


def test_license_texts_are_told_apart():
    for label, t in licenses.TEMPLATES:
        if label.endswith(("-text", "-notice")):
            found = licenses.scan(" ".join(wording(t)), licenses.compiled())[5].split(",")
            assert [x for x in found if x.endswith(("-text", "-notice"))] == [label]


def test_passages_brute(spark, some):
    rows = {r.doc_id: r.text.lower().split() for r in some.collect()}
    seen, want = {}, set()
    for i in sorted(rows):
        for k in range(len(rows[i]) - 59):
            key = tuple(rows[i][k : k + 60])
            if seen.setdefault(key, i) != i:
                want.add(i)
    got = passages.near_passages(some).collect()
    assert want <= {r.doc_id for r in got} and want
    for r in got:
        a, b = rows[r.doc_id][r.start_word : r.end_word], rows[r.other_id][r.other_start : r.other_end]
        sa, sb = ({tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (a, b))
        assert len(a) >= 50 and len(sa & sb) / len(sa | sb) >= 0.8 - 1e-9


def test_near_passages_against_brute_force(spark):
    """Families of edited passages, some led by an earlier text that has a mere phrase or half a passage of them."""
    rng = np.random.default_rng(11)
    word = lambda n: [f"v{k}" for k in rng.integers(0, 50_000, n)]

    def edited(w, share):
        w = list(w)
        for at in rng.choice(len(w), int(share * len(w)), replace=False):
            w[at] = f"e{rng.integers(0, 1 << 30)}"
        return w

    rows = []
    for family in range(16):
        base = word(int(rng.integers(60, 140)))
        if family % 2:
            rows += [word(40) + base[at : at + 5] + word(80) for at in (0, 10, 20, 30, 40)] + [word(60) + base[: len(base) // 2] + word(60)]
        rows += [word(int(rng.integers(0, 200))) + edited(base, (0.0, 0.01, 0.015, 0.02)[k % 4]) + word(int(rng.integers(0, 200))) for k in range(6)]
    rows = [" ".join(w) for w in rows]
    sh = [passages.shingles(passages.word_hashes(t)) for t in rows]
    truth = {(i, j) for i in range(len(rows)) for j in range(i) if len(np.intersect1d(sh[i], sh[j])) >= 30 and passages.verify(sh[i], sh[j])}
    data = [(k, t) for k, t in enumerate(rows)]
    found = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (2, 7, 32):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            found.append(sorted(tuple(r) for r in passages.near_passages(spark.createDataFrame(spark.sparkContext.parallelize(data, n), "doc_id long, text string")).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2]
    pairs = {(r[0], r[3]) for r in found[0]}
    late = {i for i, _ in truth}
    assert len(late) > 60 and len(late & {i for i, _ in pairs}) / len(late) >= 0.95
    assert all(i > j for i, j in pairs)
    # the pairs that are not given follow from the classes
    members = {}
    for r in found[0]:
        members.setdefault(r[7:], set()).update((r[0], r[3]))
    implied = {(i, j) for m in members.values() for i in m for j in m if j < i}
    assert len(truth & implied) / len(truth) >= 0.98
    roots = components_of(len(rows), lambda i, j: (i, j) in truth)
    assert all(roots[i] == roots[j] for i, j in implied)


@pytest.mark.parametrize(("tile", "few"), [(passages.TILE, passages.FEW), (3000, 5)])
def test_passages_beside_many_decoys(spark, tile, few, monkeypatch):
    """Two late texts share a passage of which many earlier ones have parts that are just too short, so that these come first in every group; then a family in one class."""
    monkeypatch.setattr(passages, "TILE", tile)
    monkeypatch.setattr(passages, "FEW", few)
    rng = np.random.default_rng(5)
    word = lambda n: [f"v{k}" for k in rng.integers(0, 50_000, n)]
    base, other = word(110), word(220)
    rows = [word(25) + base[at : at + 49] + word(25) for at in range(0, 62, 4) for _ in range(14)]
    n = len(rows)
    rows += [word(30) + base + word(30), word(10) + base + word(50)]
    rows += [word(20) + other[: 100 + 2 * k] + ["x"] + other[100 + 2 * k :] + word(20) for k in range(6)]
    got = passages.near_passages(spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(rows)], "doc_id long, text string")).collect()
    pairs, members = {(r.doc_id, r.other_id) for r in got}, {}
    assert (n + 1, n) in pairs and all(i >= n and j >= n for i, j in pairs)
    for r in got:
        members.setdefault((r.class_doc, r.class_start), set()).update((r.doc_id, r.other_id))
    assert sorted(map(sorted, members.values())) == [[n, n + 1], list(range(n + 2, n + 8))]
    assert (10, 120, 30, 140, 1.0) in {(r.start_word, r.end_word, r.other_start, r.other_end, r.similarity) for r in got if r.doc_id == n + 1}


def test_postings_lose_no_pair_that_shares_enough():
    """Common shingles are left out, yet any two rows with enough of them in common meet in a list."""
    rng = np.random.default_rng(6)
    need, pool = passages.SHARED_LEAST, np.sort(rng.integers(0, 1 << 60, 400).astype(np.uint64))
    weights = 1 / np.arange(1, 401)
    rows = [rng.choice(pool, int(rng.integers(46, 120)), replace=k % 3 == 0, p=weights / weights.sum()) for k in range(150)]
    met = {(i, j) for x in passages.postings(rows) for i in x.tolist() for j in x.tolist()}
    enough = 0
    for i in range(len(rows)):
        for j in range(i):
            if min(np.isin(rows[i], rows[j]).sum(), np.isin(rows[j], rows[i]).sum()) >= need:
                enough += 1
                assert (i, j) in met
    assert enough > 20
    line = pool[:30]
    assert not passages.postings([np.concatenate([line, rng.integers(0, 1 << 60, 40).astype(np.uint64)]) for _ in range(50)])


def test_stretches_around_a_place():
    """No stretch with the place in it is missed, and few flags without one are let through."""
    rng, let, none = np.random.default_rng(9), 0, 0
    for k in range(3000):
        flags = np.ones(int(rng.integers(46, 184)), bool)
        for at in rng.integers(0, len(flags), int(rng.integers(0, 5))).tolist():
            flags[at : at + int(rng.integers(1, 9))] = False
        c = int(rng.integers(0, len(flags)))
        has = any(s <= c < e for s, e in passages.stretches(flags, passages.SHARED))
        got = bool(passages.around(flags[None], c)[0])
        assert got or not has
        let, none = let + (got and not has), none + (not has)
    assert none > 500 and let < none / 20


def test_windows_of_a_text_of_few_words():
    """Equal hashes are one node, so that a million words of one kind are no more work than others."""
    began = time.monotonic()
    assert passages.compact_windows(passages.mix(passages.shingles(passages.word_hashes("la " * 1_000_000)))) == [(0, 0, 999_995)]
    assert time.monotonic() - began < 20
    h = np.array([3, 1, 2, 2, 2, 1, 5, 4, 4, 4, 1], np.uint64)
    assert sorted(passages.compact_windows(h, 3)) == [(0, 1, 10), (2, 2, 4), (6, 7, 9)]


def test_passages_of_a_long_text_of_one_word(spark):
    data = [(k, "la " * 120_000) for k in range(3)] + [(9, "la " * 60)]
    got = passages.near_passages(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == {1, 2, 9} and {(r.class_doc, r.class_start) for r in got} == {(0, 0)}


def test_compact_windows_cover_each_stretch_once():
    h = np.random.default_rng(0).permutation(60).astype(np.uint64)
    w = passages.compact_windows(h, 5)
    for i in range(60):
        for j in range(i + 4, 60):
            own = [(lo, c, hi) for lo, c, hi in w if lo <= i <= c <= j <= hi]
            assert len(own) == 1 and own[0][1] == i + int(h[i : j + 1].argmin())


def test_language_model(spark, sf, some):
    got = {r.doc_id: r for r in lm.score(some).collect()}
    words = {r.doc_id: r.text.encode().lower().split() + ["end"] for r in some.collect()}
    out = {i for i in words if zlib.crc32(str(i).encode()) % 7 == 2}
    counts = {}
    for i in set(words) - out:
        for w in words[i]:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, w in words.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i in out, len(w), sum(x in counts for x in w), n)
        assert abs(r.base_score - sum(np.log10((counts.get(x, 0) + 1) / (n + v + 1)) for x in w)) < 1e-6


def test_language_model_gains_on_held_out_texts(spark, sf):
    """With a thousand texts; of a hundred, as above, the model has too little to learn from to do better than the counts."""
    more = spark.read.parquet(str(Path(sf).parent / "sf0.01" / "documents.parquet"))
    r = lm.score(more).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1] + 0.001 * abs(r[1])


def test_language_model_is_normalised():
    for counts_ in (np.arange(600)[::-1] ** 2, np.zeros(2), np.array([5.0, 1, 0])):
        p = lm.Parameters(counts_.astype(float))
        n = len(counts_)
        at = lambda x: np.full(n, min(x, n - 1))
        assert abs(np.exp(p.log_p(at(3), at(7), np.arange(n))).sum() - 1) < 1e-4
        trainer = lm.Trainer(p, 1)
        rng = np.random.default_rng(2)
        for _ in range(20):
            trainer.learn(rng.integers(0, n, 500), rng.integers(0, n, 500), rng.integers(0, n, 500))
        assert abs(np.exp(trainer.p.log_p(at(3), at(7), np.arange(n))).sum() - 1) < 1e-4


def brute_score(text, v, p, counts_):
    """log10 of the text from the fitted tables, word by word, with plain softmaxes."""
    a, b, r, bias, s, s_bias = (t.astype(float) for t in p.tables)
    known = {w: int(v.symbol[i]) for i, w in enumerate(v.words[: len(v.symbol)])}
    words = (text or "").encode().lower().split()
    symbols, total = [v.end, v.end, *(known.get(w, v.unknown) for w in words), v.end], 0.0
    for k, x in enumerate(symbols[2:]):
        q = a[symbols[k]] + b[symbols[k + 1]]
        c = p.of[x]
        own = np.flatnonzero(p.of == c)
        cs, ws = s @ q + s_bias, r[own] @ q + bias[own]
        total += cs[c] - np.log(np.exp(cs).sum()) + ws[x - own[0]] - np.log(np.exp(ws).sum())
        if x == v.unknown:
            total += np.log((counts_.get(words[k], 0) + 1) / v.outside)
    return total / np.log(10)


@pytest.mark.parametrize(("most", "symbols"), [(300_000, 8190), (10, 5), (300, 300)])
def test_language_model_scores_by_brute_force(spark, monkeypatch, most, symbols):
    """Also where most words are outside the head, with many equal counts, and where the vocabulary is smaller than the symbols."""
    from collections import Counter

    monkeypatch.setattr(lm, "HEAD", most)
    monkeypatch.setattr(lm, "WORDS", symbols)
    monkeypatch.setattr(lm, "PARTS", 4)
    rng = np.random.default_rng(5)
    texts = [" ".join(f"t{k}" for k in rng.zipf(1.3, 60) if k < 300) for _ in range(120)] + ["never seen words", None, "", "T1 t1"]
    d = docs(spark, [(k, t, "a") for k, t in enumerate(texts)])
    train = Counter()
    for k, t in enumerate(texts):
        if zlib.crc32(str(k).encode()) % 7 != 2:
            train.update((t or "").encode().lower().split())
    encoded, others, v, p = lm.learned(d)
    assert len(v.words) <= most and min(v.c, default=0) >= max((r.c for r in others.collect()), default=0)
    assert len(v.words) + others.count() == len(train) and {w: train[w] for w in v.words} == dict(zip(v.words, v.c.tolist(), strict=True))
    assert len(v.words) >= min(most, len(train)) * 0.5
    got = {r.doc_id: r.score for r in lm.score(d).collect()}
    for k, t in enumerate(texts):
        # training is the same again but for the order in which sums are formed
        assert abs(got[k] - brute_score(t, v, p, train)) < 1e-3 * max(1, abs(got[k])), k


def test_mixing_budget(spark):
    d = docs(spark, [(k, "w " * 10, "big" if k < 80 else f"s{k % 2}") for k in range(100)])
    plan = {r.source: r for r in mixing.targets(mixing.source_tokens(d), entropy=0.95, max_epochs=10.0).collect()}
    assert abs(sum(r.weight for r in plan.values()) - 1) < 1e-9
    w = np.array([r.weight for r in plan.values()])
    assert -(w * np.log(w)).sum() >= 0.95 * np.log(3) - 1e-6
    drawn = mixing.draw(d, entropy=0.95, max_epochs=10.0).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()
    for r in drawn:
        p = plan[r.source]
        assert 0 <= p.passes * p.total + p.rest - r.n < 10
    limited = {r.source: r for r in mixing.targets(mixing.source_tokens(d), entropy=1.0, max_epochs=2.0).collect()}
    assert max((r.passes * r.total + r.rest) / r.total for r in limited.values()) <= 2.0 + 1e-6
    kept = mixing.mix(d, keep_all=True, entropy=None, max_epochs=2.0)
    assert kept.select("doc_id").distinct().count() == 100


def test_repeated_rows_and_null_ids_leave_one(spark):
    a, b = " ".join(f"p{k}" for k in range(40)), " ".join(f"q{k * k}" for k in range(40))
    d = docs(spark, [(1, a, "s")] * 3 + [(1, b, "s"), (None, a, "s"), (2, a, "t"), (None, b, "s"), (None, "z y x", "s"), (None, "z y x", "s")])
    kept = sorted((r.doc_id or 0, r.text) for r in simhash.keep_one(d).collect())
    assert kept == sorted([(1, a), (1, b), (0, "z y x")])


def brute_draws(rows, how):
    """Times that each row (id, text, source) is drawn: whole passes, then the permutation up to the budget, equal keys together."""
    import hashlib
    import math

    n_words = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    total = {}
    for n, (_, _, s) in zip(n_words, rows, strict=True):
        total[s or ""] = total.get(s or "", 0) + n
    every = sum(total.values())
    p = {s: n / every for s, n in total.items() if n}
    keep_all, a = how.get("keep_all"), 1.0
    if keep_all:
        # the largest exponent that repeats no source more than max_epochs times as often as the one repeated least
        ratio = lambda a: max(x ** (a - 1) for x in p.values()) / min(x ** (a - 1) for x in p.values())
        lo, hi = 0.0, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if ratio(mid) > how["max_epochs"] else (lo, mid)
        a = round(hi, 9)
    else:
        spread = lambda a: math.log(sum(x**a for x in p.values())) - a * sum(x**a * math.log(x) for x in p.values()) / sum(x**a for x in p.values())
        lo, hi = 0.0, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if spread(mid) >= how["entropy"] * math.log(len(p)) else (lo, mid)
        a = round(lo, 9)
    z, least = sum(x**a for x in p.values()), min((x ** (a - 1) for x in p.values()), default=1)
    times = [0] * len(rows)
    key = lambda epoch, doc: hashlib.md5(f"mix-1|{epoch}|{'' if doc is None else doc}".encode()).hexdigest()
    for s, n in total.items():
        own = [k for k, r in enumerate(rows) if (r[2] or "") == s]
        if not n:
            for k in own:
                times[k] = int(bool(keep_all))
            continue
        target = math.floor((p[s] ** (a - 1) * n / least if keep_all else p[s] ** a / z * every) + 1e-6)
        target = max(target, n) if keep_all else target
        passes, rest = divmod(target, n)
        keys = {k: key(passes, rows[k][0]) for k in own}
        for k in own:
            before = sum(n_words[j] for j in own if keys[j] <= keys[k])
            begun = sum(n_words[j] for j in own if keys[j][:3] < keys[k][:3]) < rest
            times[k] = passes + (begun and before <= rest)
    return times


@pytest.mark.parametrize("how", [{"keep_all": True, "entropy": None, "max_epochs": 2.0}, {"entropy": 0.9, "max_epochs": None}])
def test_mix_brute(spark, how):
    from collections import Counter

    rows = [(k, "w " * (1 + k % 7), "big") for k in range(300)] + [(1000 + k, "v w", "small") for k in range(40)] + [(7, "a b", "small"), (7, "c d e", "big"), (7, "c d e", "big")]
    rows += [(2000, " ", "none"), (2001, None, "none"), (3, "", None), (None, "x y", "small"), (None, "x y", "small"), (None, "z", None), (5000, "q " * 30, "other")]
    times = brute_draws(rows, how)
    want = Counter()
    for r, n in zip(rows, times, strict=True):
        want[r] += n
    d = docs(spark, rows)
    got = Counter((r.doc_id, r.text, r.source) for r in mixing.mix(d, **how).collect())
    assert got == +want and (not how.get("keep_all") or min(times) >= 1)
    told = Counter((r.doc_id, r.source, r.n_tokens) for r in mixing.draw(d, **how).collect())
    by = Counter()
    for (i, t, s), n in want.items():
        by[i, s or "", len((t or "").split())] += n
    assert told == +by


@pytest.mark.parametrize("few", [0, 50_000])
def test_mix_order_holds_the_weights_everywhere(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "FEW_SOURCES", few)
    d = docs(spark, [(k, "w w w w", "big" if k % 10 else "small") for k in range(4000)])
    got = [r.source for r in mixing.mix(d, keep_all=True, entropy=None, max_epochs=2.0).collect()]
    assert got.count("big") == 3600 and got.count("small") == 800
    for part in (got[:1100], got[1100:2200], got[3300:]):
        assert abs(part.count("small") / len(part) - 800 / 4400) < 0.05


def test_keep_all_loses_no_document(spark):
    d = docs(spark, [(1, "a b", "s"), (2, "", "empty"), (3, None, "empty")])
    assert sorted(r.doc_id for r in mixing.mix(d, keep_all=True, entropy=None).collect()) == [1, 2, 3]
    big = [3 * 10**15 + 7 * k * k for k in range(40)]
    tokens = spark.createDataFrame([(k, f"s{k}", n) for k, n in enumerate(big)], "doc_id long, source string, n_tokens long")
    assert all(r.passes >= 1 for r in mixing.targets(tokens, keep_all=True, entropy=None, max_epochs=2.0).collect())


def test_lines(spark):
    got = {r.doc_id: r for r in linededup.dedup_lines(docs(spark, [(1, "a\nb\nc\nd", "x"), (2, "q\na\nb\n\nc\nz", "x"), (3, "a\nb", "x")])).collect()}
    assert got[1].text == "a\nb\nc\nd" and got[2].text == "q\n\nz" and got[2].n_removed == 3 and got[3].text == "a\nb"


def brute_lines(rows):
    """(doc_id, n_lines, n_removed, text) of rows in their order of (doc_id, place in the input), null ids first."""
    seen, out = set(), []
    for doc, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = (t or "").split("\n")
        own = [k for k, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x)]
        gone = set()
        for k in range(len(own) - 2):
            key = tuple(lines[i] for i in own[k : k + 3])
            if key in seen:
                gone |= {own[k], own[k + 1], own[k + 2]}
            seen.add(key)
        out.append((doc, len(own), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    return sorted(out, key=repr)


def test_lines_brute(spark, some):
    rows = [(9, "a\nb\nc\ntail"), (9, "u1\nu2\nu3\nt2"), (1, "a\nb\nc"), (None, "a\nb\nc\nown"), (None, "n1\n\n \nn2\nn3"), (5, "x\ny\nz"), (5, "x\ny\nz"), (6, None), (6, ""), (7, "r\nr\nr\nr\nr"), (8, "p\nq\nr\np\nq\nr")]
    rows += [(100, "\n".join(f"line {k}" for k in range(20_000))), (101, "\n".join(f"line {k}" for k in range(10_000, 30_000)))]
    for parts in (1, 3):
        # one task or a few in a row: the order of the input is the same
        d = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "doc_id long, text string")
        assert sorted((tuple(r) for r in linededup.dedup_lines(d).collect()), key=repr) == brute_lines(rows)
    whole = [(r.doc_id, r.text) for r in some.collect()]
    assert sorted((tuple(r) for r in linededup.dedup_lines(some).collect()), key=repr) == brute_lines(whole)


def test_revisits(spark):
    rows = [
        (1, "http://www.A.com:80/x/?b=2&a=1", 100, "response", '"e1"', None, {"Content-Type": "t", "Date": "d1"}, "p1"),
        (2, "https://a.com/x?a=1&b=2#f", 50_000, "revisit", 'W/"e1"', None, {"date": "d2", "Content-Length": "0"}, None),
        (3, "https://a.com/x?a=1&b=2", 50, "revisit", '"e1"', None, None, None),
        (4, "https://a.com/x?a=1&b=2", 60_000, "revisit", '"e9"', None, None, None),
        (5, None, 60_000, "revisit", '"e9"', None, None, None),
        (6, "https://a.com/x?a=1&b=2", 60_000, "revisit", None, "m", None, None),
    ]
    d = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>, payload string")
    got = {r.record_id: r for r in warc.resolve(d).collect()}
    assert {k: r.outcome for k, r in got.items()} == {2: "resolved", 3: "no_response", 4: "validator_mismatch", 5: "no_response", 6: "no_validator"}
    assert got[2].base_id == 1 and got[2].headers == {"content-type": "t", "date": "d2"} and got[2].payload == "p1"
    assert warc.resolve(d.limit(0)).count() == 0


RECORDS = "record_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>, payload string, url_key string, span string, end string"


def test_revisits_with_ties_repeats_and_odd_headers(spark):
    u, more = "https://a.com/x", ("k", "s", "e")
    rows = [
        (1, u, 100, "response", '"e"', None, {"Date": "d0", "date": "d1", "ETAG": "y", "Server": None, "X": "own"}, "p1", *more),
        (2, u, 100, "response", '"f"', None, {"Date": "d2"}, "p2", *more),
        (3, u, 100, "revisit", '"f"', None, {"DATE": "d3", "Date": "d4", "X": "not taken"}, None, *more),
        (3, u, 100, "revisit", '"f"', None, {"DATE": "d3", "Date": "d4", "X": "not taken"}, None, *more),
        (4, u, None, "revisit", '"f"', None, None, None, *more),
        (5, u, 30_000, "revisit", 'W/"f"', None, {}, None, *more),
        (6, None, 200, "response", '"f"', None, {}, "p6", *more),
        (7, None, 300, "revisit", '"f"', None, {}, None, *more),
        (None, None, 300, "revisit", '"f"', None, {}, None, *more),
        (8, u, 30_001, "response", None, "m", {"Vary": "v", "Content-Type": "c"}, None, *more),
        (9, u, 30_002, "revisit", None, "m", {"vary": "w", "expires": "never"}, None, *more),
        (10, "", 5, "revisit", None, "m", None, None, *more),
    ]
    got = sorted(((r.record_id or 0), r.outcome, r.base_id, r.headers, r.payload) for r in warc.resolve(spark.createDataFrame(rows, RECORDS)).collect())
    two = {"date": "d4"}
    assert got == [
        (0, "no_response", None, None, None), (3, "resolved", 2, two, "p2"), (3, "resolved", 2, two, "p2"), (4, "no_response", None, None, None), (5, "resolved", 2, {"date": "d2"}, "p2"),
        (7, "no_response", None, None, None), (9, "resolved", 8, {"content-type": "c", "vary": "w", "expires": "never"}, None), (10, "no_response", None, None, None),
    ]
    first = spark.createDataFrame([*rows[:1], (20, u, 200, "revisit", '"e"', None, {"etag": "z"}, None, *more)], RECORDS)
    assert warc.resolve(first).first().headers == {"date": "d1", "etag": "z", "server": None, "x": "own"}


def test_token_fallbacks():
    path = tokenbin.default_vocabulary()
    assert tokenbin.id_type(path) == "<u2"
    made = ["a \u2764 b\u2764 c", "It's one-two  \n three,\tfour.", "", "x " * 50]
    want = [x.tolist() for x in tokenbin.Encoder(path, "<u4").encode(made)]
    for name, value in (("by_words", False), ("between", None)):
        e = tokenbin.Encoder(path, "<u4")
        setattr(e, name, value)
        assert [x.tolist() for x in e.encode(made)] == want


def test_files_are_read_alike_when_not_local(tmp_path):
    from pyarrow import fs

    np.arange(100, dtype="<u2").tofile(tmp_path / "x.bin")
    far = fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem())
    a, b = tokenbin.Mapped(fs.LocalFileSystem(), str(tmp_path / "x.bin"), "<u2"), tokenbin.Mapped(far, "x.bin", "<u2")
    assert a.size == b.size == 100 and b.file is not None
    for lo, hi in ((0, 10), (90, 200), (5, 5)):
        assert a[lo:hi].tolist() == b[lo:hi].tolist()


def test_tokens_keep_the_stored_order(spark, tmp_path):
    rows = [(int(k), f"w{k} x") for k in np.random.default_rng(2).permutation(400)] + [(5, "again"), (None, "none")]
    spark.createDataFrame(spark.sparkContext.parallelize(rows, 3), "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    d = spark.read.parquet(str(tmp_path / "d"))
    got = tokenbin.round_trip(d, order=tokenbin.stored_order(d)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [i for i, _ in rows]
    assert tokenbin.stored_order(spark.range(3)) is None


def test_pipeline(spark, sf, odd, none, tmp_path):
    import corpus_pipeline

    made = spark.read.parquet(f"{sf}/documents.parquet")
    columns = made.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, made, sf)
        assert made.columns == columns, name
    mixed = [r.doc_id for r in made.select("doc_id").collect()]
    out = corpus_pipeline.run(spark, sf).orderBy("start").collect()
    assert [r.doc_id for r in out] == mixed and sum(r.n_tokens for r in out) == max(r.start + r.n_tokens for r in out)
    good = " ".join(f"the word{k} of" for k in range(30))
    more = docs(spark, [(None, " ".join(f"the {k * k}thing of" for k in range(50)), "a"), (8, good + " and more of it", "a"), (8, good + " and more of it", "a"), (8, " ".join(f"the other{k} in" for k in range(40)), "b"), (9, good.replace("word", "item"), None)])
    for k, (d, want) in enumerate(((odd.union(more), None), (none, []))):
        folder = tmp_path / f"sf{k}"
        d.write.parquet(str(folder / "documents.parquet"))
        spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(str(folder / "benchmark.parquet"))
        got = [r.doc_id for r in corpus_pipeline.run(spark, str(folder)).collect()]
        if want is None:
            assert None in got and got.count(8) >= 2 and 9 in got and not {1, 2, 3, 4} & set(got)
        else:
            assert got == want


def test_encoder_starts_no_threads():
    """Threads of the tokenizer keep memory in every worker of an executor (pipeline on check_h: more than 3000 MB)."""
    code = "import os; from tallyglass.llm import tokenbin as t; n = lambda: len(os.listdir('/proc/self/task')); a = n(); e = t.Encoder(t.default_vocabulary(), '<u2'); e.encode([f'word{k} other{k}' for k in range(50_000)]); print(n() - a)"
    env = {k: v for k, v in os.environ.items() if k not in ("TOKENIZERS_PARALLELISM", "RAYON_NUM_THREADS")}
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, env=env, cwd=Path(__file__).parents[2])
    assert out.stdout.strip() == "0"
