"""The stored gram index, similarity joins with hot trigrams, token search with bounds, and the nearest-neighbour join."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyglass.operators import grams, knn_join, search, vectors
from tallyglass.plans import identify, landed
from tallyglass.sources.views import view

CARD = "card_id long, game string, language string, name string, name_ja string, set_name string, set_code string, card_number string, set_total int"
QUERY = "query_id long, game string, language string, text string, card_number string, set_total int"


def cards(spark, names, language="en"):
    return spark.createDataFrame([(k, "g", language, n, None, f"set {k % 3}", "s", "1", 9) for k, n in enumerate(names)], CARD)


def asked(spark, texts, language="en"):
    return spark.createDataFrame([(k, "g", language, t, None, None) for k, t in enumerate(texts)], QUERY)


def rows(df):
    return sorted(map(tuple, df.collect()))


def words(t):
    return "".join(c if c.isalnum() else " " for c in t.lower()).split()


def trigrams(t):
    return {("  " + w + " ")[i : i + 3] for w in words(t) for i in range(len(w) + 1)}


def similar(a, b):
    a, b = trigrams(a), trigrams(b)
    return len(a & b) / len(a | b) if a | b else 0.0


@pytest.fixture(scope="module")
def names():
    rng = np.random.default_rng(3)
    syllables = ["ka", "lo", "mi", "ter", "zu", "ön", "x"]
    return ["card " + " ".join("".join(rng.choice(syllables, 3)) for _ in range(2)) for _ in range(120)] + ["card", "", "card card"]


@pytest.mark.parametrize("least", [0.1, 0.35, 0.8])
@pytest.mark.parametrize("hot", [grams.HOT, 7])
def test_similar_pairs_brute(spark, names, least, hot, monkeypatch):
    """Every text has the trigrams of one word; with a low limit these are dealt to many tasks."""
    monkeypatch.setattr(grams, "HOT", hot)
    needles = names[::9] + ["card kalomi", "tertertermi zu"]
    got = grams.similar_pairs(asked(spark, needles).withColumnRenamed("text", "needle"), cards(spark, names), least).select("needle", "name", F.round("sim", 9)).collect()
    want = {(a, b, round(similar(a, b), 9)) for a in needles for b in names if similar(a, b) > least}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_candidates_are_few_where_a_word_is_in_every_name(spark, names):
    """The frequent trigrams bring no pairs together; candidates are pairs that share a rare one."""
    needles, catalog = asked(spark, names[:40]).withColumnRenamed("text", "needle"), cards(spark, names)
    pairs, found = grams.candidate_pairs(needles, catalog, 0.5), grams.similar_pairs(needles, catalog, 0.5)
    assert found.count() <= pairs.count() < 40 * len(names) / 4


def test_stored_index_gives_the_same_pairs(spark, names, tmp_path, monkeypatch):
    monkeypatch.setattr(grams, "BUCKET_TEXTS", 10)
    catalog = cards(spark, names)
    index = grams.stored(catalog, f"file://{tmp_path}")
    assert index.name.buckets == 16
    q = asked(spark, ["card", "KALO", "zu", "x", "nothing", "ön "] + names[:5])
    assert rows(search.name_search(q, catalog, 200, index)) == rows(search.name_search(q, catalog, 200))
    assert rows(search.fuzzy_search(q, catalog, k=200, grams=index)) == rows(search.fuzzy_search(q, catalog, k=200))
    assert rows(search.catalog_search(q, catalog, 200, index)) == rows(search.catalog_search(q, catalog, 200))
    few = index.name.touched(spark.createDataFrame([("car",)], "piece string"), "piece")
    files = few.pieces.inputFiles()
    assert few.pieces.select("bucket").distinct().count() == 1 and "PartitionFilters: [isnotnull(field" in few.pieces._jdf.queryExecution().toString() and files


def test_index_follows_the_catalogue(spark, names, tmp_path):
    """Built once for one content, whatever the order of its rows; another content has another version; a build that broke off is not read."""
    base, built = f"file://{tmp_path}", lambda: len([p for p in (tmp_path / "grams").iterdir() if p.name.startswith("tables-")])
    a = grams.stored(cards(spark, names), base)
    b = grams.stored(cards(spark, names).orderBy(F.desc("card_id")), base)
    assert a.version == b.version and built() == 1
    (tmp_path / "grams" / "tables-broken").mkdir()
    c = grams.stored(cards(spark, [*names, "card new"]), base)
    assert c.version != a.version and built() == 3
    assert rows(search.name_search(asked(spark, ["card new"]), cards(spark, [*names, "card new"]), 10, c)) == [(0, len(names), 1)]


def test_stream_of_ten_batches_builds_the_index_once(spark, sf, monkeypatch):
    built = []
    of = grams.Texts.of
    monkeypatch.setattr(grams.Texts, "of", classmethod(lambda cls, names: built.append(1) or of(names)))
    monkeypatch.setattr(landed, "SCAN_BATCHES", 10)
    monkeypatch.setattr(landed, "stored", lambda catalog: grams.stored(catalog.filter("card_id > -1 OR card_id IS NULL"), None))
    q = view(spark, sf, "v_queries")
    q10 = lambda sp, d: q.repartition(10, "query_id")
    monkeypatch.setattr(landed, "QRY", q10)
    got = rows(landed.identified_stream(spark, sf))
    assert len(built) <= 3
    n = len(built)
    assert rows(landed.identified_stream(spark, sf)) == got and len(built) == n
    assert got == rows(search.name_search(q, view(spark, sf, "v_catalog")))


def bm25(queries, names, k):
    docs = [words(f"{n} set {i % 3}") for i, n in enumerate(names)]
    mean, n, out = np.mean([len(d) for d in docs]), len(docs), []
    df = lambda t: sum(t in d for d in docs)
    for q, text in enumerate(queries):
        t = sorted(set(words(text)))
        if not t or not all(map(df, t)):
            continue
        found = []
        for c, d in enumerate(docs):
            if all(x in d for x in t):
                found.append((-round(sum(np.log((n - df(x) + 0.5) / (df(x) + 0.5) + 1) * d.count(x) * 2.2 / (d.count(x) + 1.2 * (0.25 + 0.75 * len(d) / mean)) for x in t), 6), c))
        out += [(q, c, -s, r + 1) for r, (s, c) in enumerate(sorted(found)[:k])]
    return out


def test_token_search_with_a_word_in_every_card(spark, names):
    """Cards of many lengths, so that blocks are left out; single frequent words, mixed and unknown ones, repeated queries."""
    longer = [n + " card" * (k % 4) + " mi" * (k % 5 == 0) for k, n in enumerate(names)]
    texts = ["card", "card", "card set", "mi card", "mi", names[3], f"{names[3]} card", "card unknown", "", "set 1 card", "set 2"]
    got = [(r.query_id, r.card_id, r.score, r.rank) for r in search.tokens_search(asked(spark, texts), cards(spark, longer), 7).collect()]
    want = bm25(texts, longer, 7)
    assert [r[:2] + r[3:] for r in sorted(got)] == [r[:2] + r[3:] for r in sorted(want)]
    assert np.allclose([r[2] for r in sorted(got)], [r[2] for r in sorted(want)], atol=2e-6)


def clustered(spark, n, d=8):
    """Clusters, one vector that a third of the rows have, and zero vectors."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, d))
    v = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, d)) * 0.05
    v[: n // 3], v[n // 3 : n // 3 + 3] = centres[0], 0
    return spark.createDataFrame([(k, "en" if k % 4 else "ja", [float(x) for x in r]) for k, r in enumerate(v)] + [(n + 1, "en", None), (n + 2, None, [1.0] * d)], "vec_id long, language string, embedding array<double>")


@pytest.mark.parametrize("part", [knn_join.PART, 40])
def test_knn_join_equals_exact_search(spark, part, monkeypatch):
    monkeypatch.setattr(knn_join, "PART", part)
    d = clustered(spark, 900)
    want = rows(vectors.knn_exact(d.filter("language IS NOT NULL"), d, 5))
    ready = vectors.keyed(d)
    assert rows(knn_join.knn_join(ready, ready.withColumn("scale", F.lit(1.0)), 5)) == want
    q8 = vectors.quantize(d.filter("embedding IS NOT NULL AND language IS NOT NULL"))
    got = rows(knn_join.knn_join(ready, q8.select(F.col("vec_id").alias("id"), "language", F.col("q").alias("v"), "scale"), 5, False, 0.3))
    assert got == rows(vectors.knn_int8(d.filter("language IS NOT NULL"), q8, 0.3, 5)) and got
    none = ready.limit(0).withColumn("scale", F.lit(1.0))
    assert knn_join.knn_join(ready, none).count() == knn_join.knn_join(ready.limit(0), ready.withColumn("scale", F.lit(1.0))).count() == 0


def test_bounds_leave_cells_out(spark, monkeypatch):
    """On clusters a query meets few of the cells, and many queries go through the join by themselves."""
    d = clustered(spark, 1200)
    seen = []
    visits = knn_join._visits
    monkeypatch.setattr(knn_join, "_visits", lambda cells, *a: seen.append((cells, a)) or visits(cells, *a))
    ready = vectors.keyed(d).filter("v IS NOT NULL AND language IS NOT NULL")
    want = rows(vectors.knn_exact(d.filter("vec_id > 600"), d, 3))
    monkeypatch.setattr(vectors, "STREAMED", 100)
    assert rows(vectors.knn_exact(d.filter("vec_id > 600"), d, 3)) == want and len(seen) == 2
    cells = seen[0][0]
    v = np.array([r.v for r in ready.filter("id > 620 AND language = 'en'").collect()])
    own = cells["en"]
    reach = own.bounds(v, True) >= 0.99
    assert len(own.n) > 12 and reach.mean() < 0.5


def test_bounds_hold_for_every_row(spark):
    d = vectors.keyed(clustered(spark, 400)).filter("v IS NOT NULL AND language = 'en'").collect()
    v = np.array([r.v for r in d])
    pivots = v[5:25] / np.maximum(np.linalg.norm(v[5:25], axis=1), 1e-30)[:, None]
    a = knn_join._angles(v, pivots)
    cell = a.argmin(axis=1)
    stats = [type("R", (dict,), {"__getattr__": dict.get})(cell=c, near=a[cell == c, c].min(), far=a[cell == c, c].max(), short=np.linalg.norm(v[cell == c], axis=1).min(), long=np.linalg.norm(v[cell == c], axis=1).max(), n=int((cell == c).sum())) for c in sorted(set(cell.tolist()))]
    cells = knn_join.Cells(pivots, stats)
    for cosine in (True, False):
        s = v @ v.T
        if cosine:
            s = s / np.maximum(np.linalg.norm(v, axis=1)[:, None] * np.linalg.norm(v, axis=1), 1e-30)
        b = cells.bounds(v, cosine)
        for k, c in enumerate(cells.number):
            assert (s[:, cell == c] <= b[:, [k]] + 1e-9).all()


def test_queries_are_not_sent_to_every_cell(spark, monkeypatch):
    """Random vectors, for which a bound leaves most cells: shuffled records follow the number of rows, not that of cells, and tasks that hold little at a time find the same."""
    monkeypatch.setattr(knn_join, "HELD", 1500)
    rng, n = np.random.default_rng(3), 1600
    d = spark.createDataFrame([(k, "en", rng.normal(size=12).tolist()) for k in range(n)], "vec_id long, language string, embedding array<double>")
    want = rows(vectors.knn_exact(d, d, 2))
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext.setJobGroup("nearest", "nearest")
    ready = vectors.keyed(d)
    assert rows(knn_join.knn_join(ready, ready.withColumn("scale", F.lit(1.0)), 2)) == want
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = {s for j in tracker.getJobIdsForGroup("nearest") for s in tracker.getJobInfo(j).stageIds}
    none = spark._jvm.java.util.Collections.emptyList(), False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    written = sum(store.stageAttempt(s, 0, False, *none)._1().shuffleWriteRecords() for s in stages)
    assert 0 < written < 30 * n
