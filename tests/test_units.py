import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyglass.functions import exprs as e
from tallyglass.operators import catalog as c
from tallyglass.operators import layout, ocr, prices, rank, vectors


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_trigrams(spark):
    r = one(spark, e.similarity(F.lit("word"), F.lit("two words")), e.word_similarity(F.lit("word"), F.lit("two words")), e.similarity(F.lit(""), F.lit("")))
    assert abs(r[0] - 4 / 11) < 1e-9 and abs(r[1] - 0.8) < 1e-9 and r[2] == 0


def test_small_expressions(spark):
    r = one(spark, e.hamming_hex(F.lit("ffffffffffffffff"), F.lit("0000000000000000")), e.hamming_hex(F.lit(None).cast("string"), F.lit("0" * 16)), e.strip_zeros(F.lit("007")), e.strip_zeros(F.lit("000")), e.slug(F.lit("Pokémon & Friends' 2")))
    assert tuple(r) == (64, 999, "7", "0", "pokemon-friends-2")


def test_pages_and_variants(spark, tmp_path):
    page = {"data": [{"id": "a-1", "name": "X", "set": {"id": "s", "name": "S"}, "number": "1", "images": {"small": "i"}, "subtypes": ["B"]}, {"id": "a-2"}]}
    (tmp_path / "p.json").write_text(json.dumps(page))
    r = {x.external_id: x for x in c.read_catalog_pages(spark, str(tmp_path)).collect()}
    assert r["a-1"].set_code == "s" and r["a-1"].rarity is None and r["a-2"].name == "" and r["a-2"].image_url is None and r["a-2"].subtypes == []
    records = [({"id": None, "cardId": "c1", "name": "N", "nameJa": "J", "colors": ["R", "G"]},), ({"cardId": "c2", "set": "S", "setId": "T", "images": {"small": "u"}, "color": "B"},)]
    df = spark.createDataFrame([(json.dumps(x[0]),) for x in records], "record string")
    a, b = c.map_variant_fields(df).collect()
    assert a.external_id is None and a.name_ja == "J" and a.colors == ["R", "G"] and b.external_id == "c2" and b.set_name == "S" and b.image_url == "u" and b.colors == ["B"]


def test_mojibake(spark):
    df = spark.createDataFrame([("PokÃ©mon",), ("Pokémon",), ("カード",), (None,)], "t string")
    assert [r.t for r in c.repair_mojibake(df, ["t"]).collect()] == ["Pokémon", "Pokémon", "カード", None]


def test_embed_and_manifest(spark, tmp_path):
    def encoder():
        def encode(batch):
            if any(b == b"bad" for b in batch):
                raise ValueError
            return [[float(len(b))] for b in batch]

        return encode

    df = spark.createDataFrame([(1, b"abc"), (2, b"bad")], "image_id long, bytes binary").coalesce(1)
    got = {r.image_id: r for r in c.embed_images(df, encoder, batch=1).collect()}
    assert got[1].embedding == [3.0] and got[1].reason is None and got[2].reason == "ValueError"
    (tmp_path / "f").write_bytes(b"x")
    assert c.manifest(spark, str(tmp_path)).first().size == 1
    c.write_results_jsonl(spark.createDataFrame([(1, [2])], "id long, c array<long>"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == '{"id":1,"c":[2]}'


def test_upsert_twice_is_once(spark):
    t = spark.createDataFrame([(1, "a", "x")], "k long, name string, s string")
    n = spark.createDataFrame([(1, " b ", "", 1), (2, "c", "y", 2), (0, "z", "z", 3), (2, "later", "y", 4), (None, "q", "q", 5)], "k long, name string, s string, o int")
    once = c.upsert(t, n, "k", ["name", "s"], "o").drop("action")
    twice = c.upsert(once, n, "k", ["name", "s"], "o").drop("action")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "b", None), (2, "c", "y")]


def test_names(spark):
    names = spark.createDataFrame([("Staryu",), ("Lotad",), ("Mr. Mime",)], "name string")
    cases = {1: ("BASIC Lotad HP 40\nx", "Lotad"), 2: ("Misty's Staryu\nHP 50", "Misty's Staryu"), 3: ("LOTAD\nHP 10", None), 4: ("Lotad\nFlip a coin", None), 5: ("OASIC\nLotad HP 60", "Lotad"), 6: ("", None)}
    df = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "scan_id long, raw_text string")
    got = {r.scan_id: r.name for r in ocr.find_name(df, names).collect()}
    assert {k: got.get(k) for k in cases} == {k: v[1] for k, v in cases.items()}


def test_near_keyword(spark):
    df = spark.createDataFrame([(1, "Boss's Orders (Ghetsis)\nSupporter"), (2, "ボスの司令（ゲーチス）\nサポート")], "scan_id long, raw_text string")
    assert ocr.find_name_near_keyword(df.filter("scan_id = 1")).first().name == "Boss's Orders"
    assert ocr.find_name_near_keyword(df.filter("scan_id = 2"), "ja").first().name == "ボスの司令"


def test_listing_titles(spark):
    cases = [(1, "Bulbasaur (Expansion Pack No. 001)"), (2, "Bulbasaur (Pokémon-e Starter Deck 001/029)"), (3, "Bulbasaur (Intro Pack (Bulbasaur) 1)"), (4, "Bulbasaur (ADV Promos 051/ADV-P)"), (5, "no brackets"), (6, "Suicune (Start Deck 100 172/198)")]
    got = {r.card_id: (r.set_name, r.card_number, r.set_total) for r in c.parse_listing_titles(spark.createDataFrame(cases, "card_id long, alt_text string")).collect()}
    assert got == {1: ("Expansion Pack", "1", None), 2: ("Pokémon-e Starter Deck", "1", 29), 3: ("Intro Pack (Bulbasaur)", "1", None), 4: ("ADV Promos", "51", None), 6: ("Start Deck 100", "172", 198)}


def test_sales_rows(spark):
    html = '<table class="hoverable-rows sortable"><tr><td>2024-01-01</td><td></td><td>T <a href="https//www.ebay.com/1">x</a></td><td><span class="listed-price-inline">$9</span>$5.00</td></tr><tr><td>1</td></tr><tr><td>a</td><td></td><td><a href="/console/x">c</a></td><td>$1</td></tr></table>'
    a, b = prices.extract_sales(spark.createDataFrame([(1, html)], "page_id long, html string")).orderBy("at").collect()
    assert (a.price, a.url) == (5.0, "https://www.ebay.com/1") and b.url is None


def test_fusion_is_symmetric_to_input_order(spark):
    i = spark.createDataFrame([(1, 10, 1, 0.9), (1, 11, 2, 0.8)], "query_id long, card_id long, rank int, sim double")
    t = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id long, card_id long, rank int")
    a = rank.fuse(i, t).orderBy("rank").collect()
    b = rank.fuse(i.orderBy(F.desc("rank")), t.orderBy(F.desc("rank"))).orderBy("rank").collect()
    assert a == b and [r.card_id for r in a] == [11, 12, 10]


def test_ivf_with_all_cells_is_exact(spark, sf):
    from tallyglass.plans.identify import QV, VEC, image

    cells, centres = vectors.build_ivf(VEC(spark, sf), 5)
    assert vectors.recall(vectors.knn_ivf(QV(spark, sf), cells, centres, 5), image(spark, sf)).first().recall == 1.0


def test_ivf_recall_with_the_registered_probes(spark):
    from tallyglass.plans.identify import ivf_recall

    assert ivf_recall(spark, "/root/testdata/sf0.01").first().recall >= 0.9


def test_knn_with_ties_nulls_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 3)
    monkeypatch.setattr(vectors, "COLUMNS", 4)
    rows = [(k, "en" if k % 3 else "ja", [float(k % 4), 1.0, float(k % 2)]) for k in range(40)] + [(100, "en", None), (101, "xx", [0.0, 0.0, 0.0])]
    d = spark.createDataFrame(rows, "vec_id long, language string, embedding array<double>")
    unit = lambda v: sum(x * x for x in v) ** 0.5
    want = []
    for i, a, v in rows:
        near = [(-round(sum(x * y for x, y in zip(v, w, strict=True)) / (unit(v) * unit(w)), 6), j) for j, b, w in rows if v and w and a == b and i != j]
        want += [(i, j, -s, r + 1) for r, (s, j) in enumerate(sorted(near)[:5])]
    assert sorted(tuple(r) for r in vectors.knn_exact(d, d, 5).collect()) == sorted(want)


def test_nms_survivors(spark):
    b = spark.createDataFrame([(1, 1, 0, 0, 10, 10, 0.9), (1, 2, 1, 1, 11, 11, 0.8), (1, 3, 20, 20, 30, 30, 0.5), (1, 4, 0, 0, 9, 9, 0.1)], "image_id long, id int, x1 int, y1 int, x2 int, y2 int, confidence double")
    assert sorted(r.id for r in layout.nms(b, ["id"]).collect()) == [1, 3]


def test_cluster_blocks(spark):
    rows = [(1, 640, 480, x + dx, 50 + 20 * k, 60, 15, f"{x}-{k}") for x in (50, 420) for k in range(6) for dx in (0, 5)]
    got = layout.cluster_blocks(spark.createDataFrame(rows, "image_id long, image_width int, image_height int, left int, top int, width int, height int, text string")).collect()
    assert len(got) == 2


def brute_regions(width, height, blocks):
    """Blocks (left, top, width, height, text): by closure of the pairs that are near, and halving."""
    blocks = sorted(blocks, key=lambda b: (b[1], b[0], b[4], b[2], b[3]))
    box = lambda own: (min(b[0] for b in own), min(b[1] for b in own), max(b[0] + b[2] for b in own), max(b[1] + b[3] for b in own))
    mid = lambda b: (b[0] + b[2] / 2, b[1] + b[3] / 2)

    def closed(far):
        groups = []
        for b in blocks:
            near = [g for g in groups if any(((mid(b)[0] - mid(x)[0]) ** 2 + (mid(b)[1] - mid(x)[1]) ** 2) ** 0.5 <= far for x in g)]
            groups = [g for g in groups if g not in near] + [[x for g in near for x in g] + [b]]
        return sorted((sorted(g, key=blocks.index) for g in groups), key=lambda g: blocks.index(g[0]))

    def cards(own, left):
        x1, y1, x2, y2 = box(own)
        if len(own) < 2 or (x2 - x1) * (y2 - y1) / (width * height) < 0.008:
            return []
        shape = (x2 - x1) / (y2 - y1)
        if 0.4 <= shape <= 1.1:
            return [own]
        axis, at = (0, x1 + (x2 - x1) / 2) if shape > 1.1 else (1, y1 + (y2 - y1) / 2)
        halves = [b for b in own if mid(b)[axis] <= at], [b for b in own if mid(b)[axis] > at]
        return [c for h in halves for c in cards(h, left - 1)] if left and len(own) >= 4 and min(map(len, halves)) >= 2 else []

    best = []
    for share in (0.08, 0.15, 0.25, 0.4, 0.6):
        found = [c for g in closed(share * min(width, height)) for c in cards(g, 4)]
        best = max(best, found, key=len)
        if len(best) >= 3:
            break
    if not best:
        whole = [g for g in closed(0.6 * min(width, height)) if len(g) >= 2]
        best = [max(whole, key=lambda g: (box(g)[2] - box(g)[0]) * (box(g)[3] - box(g)[1]))] if whole else []
    off = lambda own: ((box(own)[0] + box(own)[2]) / 2 - width / 2) ** 2 + ((box(own)[1] + box(own)[3]) / 2 - height / 2) ** 2
    return [(*box(own), "\n".join(b[4] for b in own)) for own in sorted(best, key=off)]


def test_cluster_blocks_brute(spark, sf):
    from tallyglass.plans.ocr import QUERIES
    from tallyglass.sources.views import view

    images = {}
    for r in view(spark, sf, "v_blocks").collect():
        images.setdefault(r.image_id, []).append((r.left, r.top, r.width, r.height, r.text))
    want = sorted((i, k, *map(float, x[:4]), x[4]) for i, b in images.items() for k, x in enumerate(brute_regions(640, 480, b)))
    got = sorted((r.image_id, r.place, r.left, r.top, r.left + r.width, r.top + r.height, r.text) for r in QUERIES["c7_cluster_blocks"](spark, sf).collect())
    assert got == want and len(got) > 1000


def test_cluster_blocks_of_large_and_empty_images(spark):
    import random

    random.seed(4)
    rows = [(1, 640, 480, random.randrange(600), random.randrange(440), 30, 12, f"t{k}") for k in range(300)]
    rows += [(2, 640, 480, None, 4, 30, 12, "x"), (2, 640, 480, 5, 4, 30, 12, None), (None, 640, 480, 5, 4, 30, 12, "y"), (3, 640, 480, 9, 9, 0, 0, "p"), (3, 640, 480, 9, 9, 0, 0, "p")]
    schema = "image_id long, image_width int, image_height int, left int, top int, width int, height int, text string"
    got = layout.cluster_blocks(spark.createDataFrame(rows, schema)).orderBy("image_id", "place").collect()
    want = brute_regions(640, 480, [r[3:] for r in rows if r[0] == 1])
    assert [(r.left, r.top, r.left + r.width, r.top + r.height, r.text) for r in got if r.image_id == 1] == [(*map(float, x[:4]), x[4]) for x in want]
    assert [r.text for r in got if r.image_id == 3] == ["p\np"] and not [r for r in got if r.image_id == 2]
    assert layout.cluster_blocks(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("width", [2, 3, 1024])
def test_running_aggregates_in_levels(spark, width):
    from itertools import accumulate

    from tallyglass.operators import scan

    rng = np.random.default_rng(width)
    blocks = sorted(set(rng.integers(-40, 60, 50).tolist())) if width < 1024 else list(range(-5, 5000, 7))
    values = rng.integers(-9, 9, len(blocks)).tolist()
    d = spark.createDataFrame(list(zip(blocks, values, strict=True)), "b long, v long")
    for combine, python in ((F.sum, lambda a, x: a + x), (F.max, max), (F.min, min)):
        got = {r.b: r.x for r in scan.before(d, "b", "v", "x", combine, width, 7 if width == 2 else 5 if width == 3 else 3).collect()}
        assert got == dict(zip(blocks, [None, *list(accumulate(values, python))[:-1]], strict=True))
    assert scan.before(d.limit(0), "b", "v", "x").count() == 0


def test_overlaps_by_grid(spark):
    """Random, equal, touching, empty and huge boxes; then one image of 100,000 small boxes."""
    rng = np.random.default_rng(4)
    rows = []
    for image in range(3):
        for z in range(80):
            x, y = rng.integers(-50, 300, 2).tolist()
            rows.append((image, z, x, y, x + int(rng.integers(0, 60)), y + int(rng.integers(0, 60))))
        rows += [(image, 80, -50, -50, 400, 400), (image, 81, 0, 0, 10, 10), (image, 82, 0, 0, 10, 10), (image, 83, 10, 10, 20, 20)]
    d = spark.createDataFrame(rows, "image_id long, z long, x1 long, y1 long, x2 long, y2 long")
    want = set()
    for a in rows:
        for b in rows:
            w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
            if a[0] == b[0] and b[1] > a[1] and w > 0 and h > 0:
                want.add((a[0], a[1], b[1], w * h))
    got = [tuple(r) for r in layout.overlapping(d).collect()]
    assert len(got) == len(want) and set(got) == want
    many = spark.range(100_000).select(F.lit(1).alias("image_id"), F.col("id").alias("z"), (F.col("id") % 400 * 10).alias("x1"), F.floor(F.col("id") / 400 * 10).alias("y1")).withColumn("x2", F.col("x1") + 12).withColumn("y2", F.col("y1") + 12)
    assert layout.visible_boxes(many, 2.0).count() == 100_000


@pytest.mark.parametrize("crowded", [layout.CROWDED, 20])
def test_visible_boxes_without_grid(spark, crowded, monkeypatch):
    """Images on either side of the limit, equal z, no z, no image, empty boxes: shares as by brute force; an image's boxes are dealt out once."""
    monkeypatch.setattr(layout, "CROWDED", crowded)
    rng, rows = np.random.default_rng(8), []
    for image, n in enumerate([1, 2, 19, 20, 21, 60, 3] + [5] * 30):
        for _ in range(n):
            x, y = rng.integers(-5, 30, 2).tolist()
            rows.append((image, int(rng.integers(0, n)), x, y, x + int(rng.integers(0, 20)), y + int(rng.integers(0, 20))))
    rows += [(None, 1, 0, 0, 5, 5), (None, 2, 0, 0, 5, 5), (0, None, 0, 0, 50, 50), (1, 9, None, 0, 5, 5)]
    inter = lambda b, k: max(0, min(b[4], k[4]) - max(b[2], k[2])) * max(0, min(b[5], k[5]) - max(b[3], k[3]))
    whole = [r for r in rows if None not in r]
    want = []
    for b in rows:
        area = 1 if None in b[2:] else max((b[4] - b[2]) * (b[5] - b[3]), 1)
        covered = sum(inter(o, k) for o in whole if o[:2] == b[:2] for k in whole if k[0] == o[0] and k[1] > o[1])
        if covered / area <= 0.55:
            want.append((b[0], b[1], round(covered / area, 4)))
    found = layout.visible_boxes(spark.createDataFrame(rows, "image_id long, z long, x1 int, y1 int, x2 int, y2 int").repartition(3))
    assert sorted(map(str, want)) == sorted(str((r.image_id, r.z, round(r.covered_share, 4))) for r in found.collect())
    assert found.columns == ["image_id", "z", "x1", "y1", "x2", "y2", "covered_share"]


def test_boxes_of_small_images_are_dealt_once(spark, sf):
    """Where tables are too large to be broadcast, no more than the rows and the counts of images are shuffled for images of few boxes."""
    from tallyglass.plans.ocr import QUERIES

    size = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(size)
    spark.conf.set(size, "-1")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("boxes", "boxes")
    found = QUERIES["c8_visible_boxes"](spark, sf)
    assert found.count() > 0
    stages = [s for j in tracker.getJobIdsForGroup("boxes") for s in tracker.getJobInfo(j).stageIds]
    store = spark.sparkContext._jsc.sc().statusStore()
    written = sum(store.stageAttempt(s, 0, False, spark._jvm.java.util.Collections.emptyList(), False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0))._1().shuffleWriteRecords() for s in set(stages))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    spark.conf.set(size, before)
    assert 0 < written < 3 * spark.read.parquet(f"{sf}/lineitem.parquet").count()
