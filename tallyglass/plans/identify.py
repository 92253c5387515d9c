"""Queries of the vector search, the fusion and the whole identification, with their DuckDB texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cells
from ..operators import identify as i
from ..operators import knn_join as j
from ..operators import rank as r
from ..operators import search as s
from ..operators import vectors as v
from ..operators.grams import stored
from ..sources.views import table, view, with_views
from .ocr import DICT, FOUND, NAMES, NEAR, NUM, OCR, entries
from .search import CAT, J2, J2_PARTS, J3, QRY, j1, other_catalog  # noqa: F401

#: Thresholds for the given vectors, whose similarities are low.
FLOOR, CONFIDENT, WITH_TEXT = 0.35, 0.45, 0.40
VEC = lambda sp, d: view(sp, d, "v_vectors")
QV = lambda sp, d: VEC(sp, d).filter("vec_id % 10 = 0")


def totals(sp, d):
    return CAT(sp, d).groupBy("set_code").agg((F.lit(40) + F.pmod(F.length(F.min("set_code")), F.lit(3)) * 5).alias("total"))


def image(sp, d):
    return v.knn_exact(QV(sp, d), VEC(sp, d))


def text(sp, d):
    return s.search(QRY(sp, d), CAT(sp, d)).drop("source")


def versioned(sp, d):
    return VEC(sp, d).select("vec_id", F.when(F.col("vec_id") % 13 == 0, F.slice("embedding", 1, 60)).otherwise(F.col("embedding")).alias("embedding"), F.when(F.col("vec_id") % 7 == 0, "v1").otherwise("v2").alias("version"))


def hashes(sp, d):
    return VEC(sp, d).select("vec_id", F.when(F.col("vec_id") % 17 != 0, v.hash_of(F.col("embedding"))).alias("hash"))


def reranked(sp, d):
    return v.hamming_rerank(image(sp, d), hashes(sp, d), 24)


def both_languages(sp, d):
    q = QV(sp, d)
    two = q.unionByName(q.withColumn("language", F.when(F.col("language") == "en", "ja").otherwise("en")))
    hits = v.knn_exact(two, VEC(sp, d), 10)
    # the query's own language is the one it is stored with
    return hits.join(VEC(sp, d).select(F.col("vec_id").alias("card_id"), F.col("language").alias("card_language")), "card_id").join(q.select(F.col("vec_id").alias("query_id"), "language"), "query_id")


def round_trip8(sp, d):
    return v.quantize(VEC(sp, d)).select("vec_id", "language", F.transform("q", lambda x: x.cast("double") * F.col("scale")).alias("embedding"))


def other_language_hits(sp, d):
    a = VEC(sp, d)
    swapped = QV(sp, d).withColumn("language", F.when(F.col("language") == "en", "ja").otherwise("en"))
    lang = lambda h, x: h.join(QV(sp, d).select(F.col("vec_id").alias("query_id"), "language"), "query_id").withColumn("card_language", x)
    own = lang(v.knn_exact(QV(sp, d), a), F.col("language"))
    return own.unionByName(lang(v.knn_exact(swapped, a), F.when(F.col("language") == "en", "ja").otherwise("en")))


def ivf_recall(sp, d):
    cells, centres = v.build_ivf(VEC(sp, d), 20)
    return v.recall(v.knn_ivf(QV(sp, d), cells, centres, 10), image(sp, d))


def int8_join(sp, d):
    """Every vector against all 8-bit ones."""
    index = v.quantize(VEC(sp, d)).select(F.col("vec_id").alias("id"), "language", F.col("q").alias("v"), "scale")
    return j.knn_join(v.keyed(VEC(sp, d)), index, cosine=False, floor=FLOOR).withColumn("sim", F.round("sim", 5))


def stored_recall(sp, d):
    """The share of the exact neighbours that the stored cells give. The given vectors are nearly random, so six in seven cells are read for each query."""
    index = cells.build(v.keyed(VEC(sp, d)))
    probes = max(1, 6 * max(map(len, index.centres.values()), default=1) // 7)
    found = cells.search(v.keyed(QV(sp, d)), index, probes)
    return v.recall(found, image(sp, d))


def crops(sp, d):
    return QRY(sp, d).select("query_id", F.col("text").alias("label"), (F.col("query_id") % 70 == 0).alias("image_failed"), (F.col("query_id") % 110 == 0).alias("ocr_failed"))


def fused(sp, d):
    return r.fuse(image(sp, d), text(sp, d), least_sim=WITH_TEXT)


def assembled(sp, d):
    return r.assemble(crops(sp, d), fused(sp, d), image(sp, d).groupBy("query_id").agg(F.max("sim").alias("best")), text(sp, d), WITH_TEXT)


def flagship(sp, d):
    """Names are searched in the stored index of the catalogue, which the first query over it builds."""
    out = i.identify(QRY(sp, d), QV(sp, d), CAT(sp, d), VEC(sp, d), totals(sp, d), least_sim=WITH_TEXT, floor=FLOOR, grams=stored(CAT(sp, d)))
    return out.withColumn("candidates", F.array_join("candidates", ","))


def raw_scans(sp, d):
    """Every tenth scan, a stated set."""
    return OCR(sp, d).filter("scan_id % 10 = 0").withColumn("image_failed", F.col("scan_id") % 70 == 0).withColumn("ocr_failed", F.col("scan_id") % 110 == 0)


def scanned(sp, d, raw, mode, grams=None, other=None):
    """Hints from a scan's raw text, its vector; names are searched in the stored index, and in a second catalogue where one is given."""
    own = QV(sp, d).join(raw.select(F.col("scan_id").alias("vec_id")), "vec_id", "left_semi")
    out = i.identify_scans(raw, own, NAMES(sp, d), entries(sp, d), CAT(sp, d), VEC(sp, d), totals(sp, d), mode, least_sim=WITH_TEXT, floor=FLOOR, confident=CONFIDENT, grams=grams or stored(CAT(sp, d)), other=other)
    return out.withColumn("candidates", F.array_join("candidates", ","))


def first_hits(sp, d):
    a = assembled(sp, d)
    return r.first_per_top_hit(a.select((F.col("query_id") % 200).alias("scan_id"), F.col("query_id").alias("crop"), "candidates", "source"))


QUERIES = {
    "e1_prepare_vectors": lambda sp, d: v.prepare(versioned(sp, d), 64, "v2").select("vec_id", "status", F.round(F.aggregate("unit", F.lit(0.0), lambda a, x: a + x), 5).alias("sum_unit")),
    "e2_knn_exact": image,
    "e3_knn_ivf_recall": ivf_recall,
    "e3_stored_cells_recall": stored_recall,
    "e4_knn_int8": lambda sp, d: v.knn_int8(QV(sp, d), v.quantize(VEC(sp, d)), FLOOR).withColumn("sim", F.round("sim", 5)),
    "e2_knn_join": lambda sp, d: j.knn_join(v.keyed(VEC(sp, d)), v.keyed(VEC(sp, d)).withColumn("scale", F.lit(1.0))),
    "e4_knn_int8_join": int8_join,
    "e5_hamming_rerank": reranked,
    "e6_classify_hits": lambda sp, d: v.classify_hits(reranked(sp, d), FLOOR, CONFIDENT),
    "e7_choose_language": lambda sp, d: v.choose_language(other_language_hits(sp, d), 0.05, CONFIDENT),
    "e8_embedding_parity": lambda sp, d: v.parity(VEC(sp, d), round_trip8(sp, d)),
    "a19_quantize_index": lambda sp, d: v.quantize(VEC(sp, d)).select("vec_id", "language", F.round("scale", 9).alias("scale"), F.array_join(F.transform("q", lambda x: x.cast("string")), ",").alias("q")),
    "r2_dedupe_and_rank": lambda sp, d: r.dedupe_and_rank(text(sp, d), QRY(sp, d), CAT(sp, d), totals(sp, d)),
    "r3_rrf_fuse": fused,
    "r4_promote_number": lambda sp, d: r.promote_number(image(sp, d), CAT(sp, d), QRY(sp, d)),
    "r4_demote_promos": lambda sp, d: r.demote_promos(image(sp, d), CAT(sp, d)),
    "r5_intersect_boost": lambda sp, d: r.intersect_boost(image(sp, d), text(sp, d), CAT(sp, d)),
    "r6_assemble_results": lambda sp, d: assembled(sp, d).withColumn("candidates", F.array_join("candidates", ",")),
    "r7_first_per_top_hit": first_hits,
    "r7_scan_counts": lambda sp, d: r.scan_counts(first_hits(sp, d)),
    "r8_identify": flagship,
    "r8_identify_scans": lambda sp, d: scanned(sp, d, raw_scans(sp, d), "combined"),
    "r8_identify_ocr": lambda sp, d: scanned(sp, d, raw_scans(sp, d), "ocr"),
    "r8_identify_two_catalogues": lambda sp, d: scanned(sp, d, raw_scans(sp, d), "combined", other=other_catalog(sp, d)),
    "r8_identify_image": lambda sp, d: scanned(sp, d, raw_scans(sp, d), "image"),
    "j_search_cascade": lambda sp, d: s.search(QRY(sp, d), CAT(sp, d), grams=stored(CAT(sp, d))),
}


def knn(name="kn", q="qv", index="v_vectors", k=10):
    return f"""{name} AS (SELECT * FROM (SELECT query_id, card_id, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, card_id)::INT AS rank FROM (
      SELECT q.vec_id AS query_id, i.vec_id AS card_id, round(list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), 6) AS sim FROM {q} q JOIN {index} i ON q.language = i.language AND q.vec_id <> i.vec_id)) WHERE rank <= {k})"""


QV_SQL = "qv AS (SELECT * FROM v_vectors WHERE vec_id % 10 = 0)"
IMG = [QV_SQL, knn()]
CASCADE = [
    *J2_PARTS,
    f"h2 AS ({J2})",
    "l3 AS (SELECT * FROM v_queries WHERE query_id NOT IN (SELECT query_id FROM h1) AND query_id NOT IN (SELECT query_id FROM h2))",
    f"h3 AS ({J3.replace('v_queries', 'l3')})",
    "tx AS (SELECT query_id, card_id, rank, 'name' AS source FROM h1 UNION ALL SELECT query_id, card_id, rank, 'fuzzy' FROM h2 UNION ALL SELECT query_id, card_id, rank, 'name_ja' FROM h3)",
]
BITS = "list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN 1 ELSE 0 END)"
RERANK = [
    *IMG,
    f"bt AS (SELECT vec_id, CASE WHEN vec_id % 17 <> 0 THEN {BITS} END AS b FROM v_vectors)",
    "rd AS (SELECT kn.*, coalesce(CASE WHEN a.b IS NOT NULL AND b.b IS NOT NULL THEN list_sum(list_transform(list_zip(a.b, b.b), lambda p: abs(p[1] - p[2]))) END, 999)::INT AS distance FROM kn LEFT JOIN bt a ON a.vec_id = query_id LEFT JOIN bt b ON b.vec_id = card_id)",
    "rr AS (SELECT query_id, card_id, sim, distance, distance <= 24 AS strong, row_number() OVER (PARTITION BY query_id ORDER BY (distance <= 24) DESC, sim DESC, card_id)::INT AS rank FROM rd)",
]
QUANT = "qz AS (SELECT vec_id, language, greatest(m / 127, 1e-8) AS scale, list_transform(embedding, lambda x: greatest(least(round_even(x::DOUBLE / greatest(m, 1e-8) * 127, 0), 127), -127)) AS q FROM (SELECT *, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS m FROM v_vectors))"
INT8 = f"""SELECT query_id, card_id, round(sim, 5) AS sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, card_id)::INT AS rank FROM (
      SELECT q.vec_id AS query_id, i.vec_id AS card_id, round(list_inner_product(q.embedding::DOUBLE[], i.q::DOUBLE[]) * i.scale, 6) AS sim FROM qv q JOIN qz i ON q.language = i.language AND q.vec_id <> i.vec_id) WHERE sim >= {FLOOR}) WHERE rank <= 10"""
TOT = "tot AS (SELECT set_code, 40 + (length(set_code) % 3) * 5 AS total FROM v_catalog GROUP BY set_code)"
DEDUPE = """(SELECT query_id, card_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN qt IS NOT NULL AND CASE WHEN language = 'ja' THEN set_total ELSE total END = qt THEN 0 ELSE 1 END,
   CASE WHEN coalesce(qn, '') = '' THEN 0 WHEN ltrim(card_number, '0') = ltrim(qn, '0') THEN 0 WHEN starts_with(ltrim(card_number, '0'), ltrim(qn, '0')) THEN 1 ELSE 2 END, CASE WHEN starts_with(set_code, 'mcd') THEN 1 ELSE 0 END, rank, card_id)::INT AS rank
   FROM (SELECT tx.*, c.language, c.name, c.set_code, c.card_number, c.set_total, tot.total, q.card_number AS qn, q.set_total AS qt, row_number() OVER (PARTITION BY tx.query_id, c.name, c.set_code, c.card_number ORDER BY tx.rank, tx.card_id) AS nth
   FROM tx JOIN v_catalog c USING (card_id) JOIN v_queries q USING (query_id) LEFT JOIN tot ON tot.set_code = c.set_code) WHERE nth = 1)"""


def fuse_parts(img: str, txt: str, name: str = "fu", least=WITH_TEXT):
    return [
        f"{name}u AS (SELECT query_id FROM {img} GROUP BY query_id HAVING max(sim) >= {least} OR query_id NOT IN (SELECT query_id FROM {txt}))",
        f"{name}s AS (SELECT query_id, card_id, round(sum(p), 9) AS score, min(seen) AS seen FROM (SELECT query_id, card_id, 1.0::DOUBLE / (rank - 1 + 60) AS p, rank AS seen FROM {img} WHERE query_id IN (SELECT query_id FROM {name}u) UNION ALL SELECT query_id, card_id, 2.0::DOUBLE / (rank - 1 + 60), 1000 + rank FROM {txt}) GROUP BY query_id, card_id)",
        f"{name} AS (SELECT query_id, card_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, card_id)::INT AS rank FROM {name}s)",
    ]


def assemble_sql(crops_: str, fu: str, img: str, txt: str) -> str:
    return f"""SELECT query_id, coalesce(c, '') AS candidates, CASE WHEN ht THEN label WHEN best IS NULL THEN 'image:no_match' ELSE printf('image:%.2f', best) END AS query_used, CASE WHEN ht AND hi THEN 'both' WHEN hi THEN 'image' WHEN ht THEN 'ocr' ELSE 'none' END AS source, image_failed OR ocr_failed AS partial,
      CASE WHEN image_failed AND ocr_failed THEN 'image_failed,ocr_failed' WHEN image_failed THEN 'image_failed' WHEN ocr_failed THEN 'ocr_failed' END AS partial_reason FROM (
      SELECT cr.*, l.c, b.best, t.query_id IS NOT NULL AS ht, b.best IS NOT NULL AND (t.query_id IS NULL OR b.best >= {WITH_TEXT}) AS hi FROM {crops_} cr LEFT JOIN (SELECT query_id, string_agg(card_id::VARCHAR, ',' ORDER BY rank) AS c FROM {fu} GROUP BY query_id) l USING (query_id)
      LEFT JOIN (SELECT query_id, max(sim) AS best FROM {img} GROUP BY query_id) b USING (query_id) LEFT JOIN (SELECT DISTINCT query_id FROM {txt}) t USING (query_id))"""


CROPS = "cr0 AS (SELECT query_id, text AS label, query_id % 70 = 0 AS image_failed, query_id % 110 = 0 AS ocr_failed FROM v_queries)"
ASM = [*IMG, *CASCADE, *fuse_parts("kn", "tx"), CROPS]
FIRST = f"fi AS (SELECT scan_id, crop, best, source FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, best ORDER BY crop) AS n FROM (SELECT query_id % 200 AS scan_id, query_id AS crop, nullif(string_split(candidates, ',')[1], '')::BIGINT AS best, source FROM ({assemble_sql('cr0', 'fu', 'kn', 'tx')}))) WHERE n = 1 OR best IS NULL)"
USE = "u0 AS (SELECT 1 FROM v_catalog, v_queries LIMIT 0)"
OTHER = [QV_SQL, "sw AS (SELECT * REPLACE (CASE WHEN language = 'en' THEN 'ja' ELSE 'en' END AS language) FROM qv)", knn("ka"), knn("kb", "sw")]
#: Scans as they are and, for second-language ones, again as first-language ones under another id, which counts where the own has no hit.
AGAIN = 1_000_000_000
HINTS = [
    f"o1 AS (SELECT scan_id, language, raw_text, CASE WHEN scan_id % 13 = 0 THEN 'onepiece' ELSE 'pokemon' END AS game FROM v_ocr WHERE scan_id % 10 = 0 AND scan_id % 110 <> 0)",
    f"oc AS (SELECT scan_id, language, raw_text, game FROM o1 UNION ALL SELECT scan_id + {AGAIN}, 'en', raw_text, game FROM o1 WHERE language = 'ja')",
    NUM, *FOUND, *NEAR, *DICT,
    """hq AS (SELECT query_id, game, language, name AS text, card_number, TRY_CAST(set_total AS INT) AS set_total, CASE WHEN name IS NULL THEN '(unknown)' WHEN card_number IS NULL THEN name ELSE name || ' #' || card_number END AS label, CASE WHEN n <> '' THEN CASE WHEN ltrim(n, '0') = '' THEN '0' ELSE ltrim(n, '0') END END AS image_number
      FROM (SELECT oc.scan_id AS query_id, oc.game, oc.language, CASE WHEN oc.game = 'onepiece' THEN ln.l[1] WHEN oc.language = 'ja' THEN dk.translation ELSE coalesce(fn.name, nk.name) END AS name, CASE WHEN oc.game = 'onepiece' THEN code ELSE number END AS card_number, CASE WHEN oc.game = 'pokemon' THEN total END AS set_total, regexp_extract(raw_text, '([0-9]+)/[0-9]+', 1) AS n
      FROM oc JOIN nu USING (scan_id) JOIN ln USING (scan_id) LEFT JOIN fn USING (scan_id) LEFT JOIN nk USING (scan_id) LEFT JOIN dk USING (scan_id)))""",
    f"h1 AS ({j1('hq')})",
    J2_PARTS[1].replace("v_queries", "hq").replace("WHERE", "WHERE game = 'pokemon' AND text IS NOT NULL AND"),
    J2_PARTS[2],
    f"h2 AS ({J2})",
    "ta AS (SELECT query_id, card_id, rank FROM h1 UNION ALL SELECT query_id, card_id, rank FROM h2)",
    f"vi AS (SELECT query_id, CASE WHEN language = 'ja' AND query_id NOT IN (SELECT query_id FROM ta) THEN query_id + {AGAIN} ELSE query_id END AS vid FROM hq WHERE query_id < {AGAIN})",
    "fq AS (SELECT vi.query_id, hq.* EXCLUDE (query_id) FROM vi JOIN hq ON hq.query_id = vid)",
    "tx AS (SELECT vi.query_id, card_id, rank FROM vi JOIN ta ON ta.query_id = vid)",
    TOT,
    f"t2 AS (SELECT * FROM {DEDUPE.replace('v_queries', 'fq')} WHERE rank <= 10)",
    "as0 AS (SELECT scan_id AS query_id, scan_id % 70 = 0 AS image_failed, scan_id % 110 = 0 AS ocr_failed FROM v_ocr WHERE scan_id % 10 = 0)",
    "aq AS (SELECT as0.*, fq.label, fq.image_number, CASE WHEN contains(fq.label, '#') THEN fq.card_number END AS card_number FROM as0 LEFT JOIN fq USING (query_id))",
]
SCAN_IMAGE = [
    QV_SQL.replace("vec_id % 10 = 0", "vec_id % 10 = 0 AND (vec_id % 70 <> 0 OR vec_id NOT IN (SELECT p_partkey FROM part))"),
    knn(),
    f"ki AS (SELECT kn.query_id, kn.card_id, kn.sim, row_number() OVER (PARTITION BY kn.query_id ORDER BY coalesce(ltrim(c.card_number, '0') = q.image_number, false) DESC, kn.rank, card_id)::INT AS rank FROM kn LEFT JOIN v_catalog c USING (card_id) LEFT JOIN aq q USING (query_id) WHERE kn.query_id IN (SELECT query_id FROM kn GROUP BY query_id HAVING max(sim) >= {FLOOR}))",
]
ORDERED = [
    *fuse_parts("ki", "t2"),
    "f2 AS (SELECT query_id, card_id, c.set_code, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(ltrim(c.card_number, '0') = ltrim(q.card_number, '0'), false) DESC, fu.rank, card_id)::INT AS rank FROM fu LEFT JOIN v_catalog c USING (card_id) LEFT JOIN aq q USING (query_id))",
    "f3 AS (SELECT query_id, card_id, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(starts_with(set_code, 'mcd'), false), rank, card_id)::INT AS rank FROM f2)",
]
OTHER_TEXT = [
    "tb AS (SELECT query_id, card_id, rank FROM h1 UNION ALL SELECT query_id, card_id, rank FROM h2)",
    "oth AS (SELECT * REPLACE (card_id + 1000000 AS card_id) FROM v_catalog WHERE card_id % 3 = 0)",
    "allc AS (SELECT * FROM v_catalog UNION ALL SELECT * FROM oth)",
    "hv AS (SELECT tb.query_id, count(*) AS n, coalesce(bool_or(contains(c.card_number, q.card_number)), false) AS numbered, max(tb.rank) AS last FROM tb JOIN v_catalog c USING (card_id) JOIN hq q USING (query_id) GROUP BY tb.query_id)",
    """need AS (SELECT q.* FROM hq q LEFT JOIN hv USING (query_id) WHERE q.text IS NOT NULL AND q.language = 'en'
      AND (coalesce(n, 0) < 3 OR (q.card_number IS NOT NULL AND NOT coalesce(numbered, false))))""",
    f"""ta AS (SELECT query_id, card_id, rank FROM tb UNION ALL SELECT e.query_id, e.card_id, (coalesce(hv.last, 0) + e.rank)::INT FROM ({j1("need", "oth")}) e LEFT JOIN hv USING (query_id))""",
]
TWO = [x for part in HINTS for x in (OTHER_TEXT if part.startswith("ta AS") else [part.replace("JOIN v_catalog c", "JOIN allc c") if part.startswith("t2 AS") else part])]
ORACLES = {
    "r8_identify_two_catalogues": with_views(assemble_sql("aq", "f3", "ki", "t2"), *TWO, *SCAN_IMAGE, *[x.replace("JOIN v_catalog c", "JOIN allc c") for x in ORDERED], USE),
    "e1_prepare_vectors": with_views("""SELECT vec_id, CASE WHEN vec_id % 13 = 0 THEN 'wrong length' WHEN vec_id % 7 = 0 THEN 'other version' ELSE 'ok' END AS status,
      CASE WHEN vec_id % 13 <> 0 AND vec_id % 7 <> 0 THEN round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) END AS sum_unit FROM v_vectors"""),
    "e2_knn_join": with_views("SELECT query_id, card_id, sim, rank FROM ka", knn("ka", "v_vectors")),
    "e4_knn_int8_join": with_views(INT8.replace("qv q", "v_vectors q"), QUANT),
    "e2_knn_exact": with_views("SELECT query_id, card_id, sim, rank FROM kn", *IMG),
    "e4_knn_int8": with_views(INT8, QV_SQL, QUANT),
    "e5_hamming_rerank": with_views("SELECT query_id, card_id, sim, distance, strong, rank FROM rr", *RERANK),
    "e6_classify_hits": with_views(f"""SELECT query_id, best, CASE WHEN best >= {FLOOR} THEN n ELSE 0 END AS candidates, CASE WHEN strong THEN printf('image:%.2f', best) || '+phash' WHEN best >= {FLOOR} THEN printf('image:%.2f', best) ELSE 'image:no_match' END AS label,
      CASE WHEN best >= {CONFIDENT} THEN 'image' WHEN best >= {FLOOR} THEN 'image:low' ELSE 'none' END AS source FROM (SELECT query_id, max(sim) AS best, count(*) AS n, bool_or(strong AND rank = 1) AS strong FROM rr GROUP BY query_id)""", *RERANK),
    "e7_choose_language": with_views(f"""SELECT query_id, p AS primary_best, o AS other_best, CASE WHEN coalesce(coalesce(p, 0) < {CONFIDENT} AND o > coalesce(p, 0) + 0.05, false) THEN CASE WHEN language = 'ja' THEN 'en' ELSE 'ja' END ELSE language END AS chosen
      FROM (SELECT q.vec_id AS query_id, q.language, (SELECT max(sim) FROM ka WHERE ka.query_id = q.vec_id) AS p, (SELECT max(sim) FROM kb WHERE kb.query_id = q.vec_id) AS o FROM qv q)""", *OTHER),
    "e8_embedding_parity": with_views(
        """SELECT n, mean_sim, min_sim, p1_sim, mean_drift, p99_drift, max_drift, agreement, mean_drift <= 0.02 AND p99_drift <= 0.05 AND agreement >= 0.99 AS passed FROM (
      SELECT count(*) AS n, round(avg(s), 6) AS mean_sim, min(s) AS min_sim, round(quantile_cont(s, 0.01), 6) AS p1_sim, round(avg(1 - s), 6) AS mean_drift, round(quantile_cont(1 - s, 0.99), 6) AS p99_drift, round(max(1 - s), 6) AS max_drift FROM
      (SELECT round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding), 6) AS s FROM v_vectors a JOIN rt b USING (vec_id))), (SELECT round(avg((ka.card_id = kb.card_id)::INT), 6) AS agreement FROM ka JOIN kb USING (query_id))""",
        QUANT, "rt AS (SELECT vec_id, language, list_transform(q, lambda x: x::DOUBLE * scale) AS embedding FROM qz)", knn("ka", "v_vectors", "v_vectors", 1), knn("kb", "rt", "rt", 1)),
    "a19_quantize_index": with_views("SELECT vec_id, language, round(scale, 9) AS scale, array_to_string(list_transform(q, lambda x: x::INT), ',') AS q FROM qz", QUANT),
    "r2_dedupe_and_rank": with_views(f"SELECT query_id, card_id, rank FROM {DEDUPE}", *CASCADE, TOT),
    "r3_rrf_fuse": with_views("SELECT query_id, card_id, score, rank FROM fu", *IMG, *CASCADE, *fuse_parts("kn", "tx")),
    "r4_promote_number": with_views("""SELECT query_id, card_id, sim, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(ltrim(c.card_number, '0') = ltrim(q.card_number, '0'), false) DESC, kn.rank, card_id)::INT AS rank
      FROM kn LEFT JOIN v_catalog c USING (card_id) LEFT JOIN v_queries q USING (query_id)""", *IMG),
    "r4_demote_promos": with_views("SELECT query_id, card_id, sim, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(starts_with(set_code, 'mcd'), false), kn.rank, card_id)::INT AS rank FROM kn LEFT JOIN v_catalog c USING (card_id)", *IMG),
    "r5_intersect_boost": with_views("""SELECT * FROM (SELECT query_id, card_id, kind::INT AS kind, row_number() OVER (PARTITION BY query_id ORDER BY kind, CASE WHEN kind = 2 AND starts_with(set_code, 'mcd') THEN 1 ELSE 0 END, coalesce(ri, rt), card_id)::INT AS rank FROM (
      SELECT *, CASE WHEN ri IS NOT NULL AND rt IS NOT NULL THEN 0 WHEN ri IS NOT NULL THEN 1 ELSE 2 END AS kind FROM (SELECT query_id, card_id, kn.rank AS ri, tx.rank AS rt FROM kn FULL JOIN tx USING (query_id, card_id)) LEFT JOIN v_catalog USING (card_id))) WHERE rank <= 10""", *IMG, *CASCADE),
    "r6_assemble_results": with_views(assemble_sql("cr0", "fu", "kn", "tx"), *ASM),
    "r7_first_per_top_hit": with_views("SELECT scan_id, crop, best, source FROM fi", *ASM, FIRST, USE),
    "r7_scan_counts": with_views("SELECT scan_id, count(best) AS found, count(*) FILTER (source IN ('both', 'image')) AS confident FROM fi GROUP BY scan_id", *ASM, FIRST, USE),
    "r8_identify": with_views(
        assemble_sql("cr1", "f3", "ki", "t2"),
        *IMG, *CASCADE, TOT, f"t2 AS (SELECT * FROM {DEDUPE})", f"ki AS (SELECT kn.query_id, kn.card_id, kn.sim, row_number() OVER (PARTITION BY kn.query_id ORDER BY coalesce(ltrim(c.card_number, '0') = ltrim(q.card_number, '0'), false) DESC, kn.rank, card_id)::INT AS rank FROM kn LEFT JOIN v_catalog c USING (card_id) LEFT JOIN v_queries q USING (query_id) WHERE kn.query_id IN (SELECT query_id FROM kn GROUP BY query_id HAVING max(sim) >= {FLOOR}))", *fuse_parts("ki", "t2"),
        "f2 AS (SELECT query_id, card_id, c.set_code, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(ltrim(c.card_number, '0') = ltrim(q.card_number, '0'), false) DESC, fu.rank, card_id)::INT AS rank FROM fu LEFT JOIN v_catalog c USING (card_id) LEFT JOIN v_queries q USING (query_id))",
        "f3 AS (SELECT query_id, card_id, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(starts_with(set_code, 'mcd'), false), rank, card_id)::INT AS rank FROM f2)",
        "cr1 AS (SELECT query_id, text AS label, false AS image_failed, false AS ocr_failed FROM v_queries)"),
    "r8_identify_scans": with_views(assemble_sql("aq", "f3", "ki", "t2"), *HINTS, *SCAN_IMAGE, *ORDERED, USE),
    "r8_identify_ocr": with_views("""SELECT query_id, coalesce(c, '') AS candidates, coalesce(label, 'unknown') AS query_used, CASE WHEN c IS NULL THEN 'none' ELSE 'ocr' END AS source, ocr_failed AS partial, CASE WHEN ocr_failed THEN 'ocr_failed' END AS partial_reason
      FROM aq LEFT JOIN (SELECT query_id, string_agg(card_id::VARCHAR, ',' ORDER BY rank) AS c FROM t2 GROUP BY query_id) USING (query_id)""", *HINTS, USE),
    "r8_identify_image": with_views(f"""SELECT query_id, coalesce(c, '') AS candidates, CASE WHEN best IS NULL THEN 'image:no_match' ELSE printf('image:%.2f', best) END AS query_used, CASE WHEN best >= {CONFIDENT} THEN 'image' WHEN best IS NOT NULL THEN 'image:low' ELSE 'none' END AS source, image_failed AS partial, CASE WHEN image_failed THEN 'image_failed' END AS partial_reason
      FROM aq LEFT JOIN (SELECT query_id, max(sim) AS best, string_agg(card_id::VARCHAR, ',' ORDER BY coalesce(starts_with(set_code, 'mcd'), false), ki.rank, card_id) AS c FROM ki LEFT JOIN v_catalog USING (card_id) GROUP BY query_id) USING (query_id)""", *HINTS, *SCAN_IMAGE, USE),
    "j_search_cascade": with_views("SELECT query_id, card_id, rank, source FROM tx", *CASCADE),
}
