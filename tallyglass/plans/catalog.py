"""Queries of the catalogue operators, with their DuckDB texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as c
from ..sources.views import VIEWS, table, view, with_views

VIEWS["v_landed"] = """SELECT p_partkey AS id, p_partkey % 700 AS external_id, p_name AS name, p_type AS set_name, CAST(p_size AS STRING) AS card_number FROM part WHERE p_partkey % 3 <> 1"""
VIEWS["v_stored"] = """SELECT p_partkey AS external_id, p_name AS name, p_type AS set_name, CAST(p_size AS STRING) AS card_number FROM part WHERE p_partkey % 4 = 0"""
VIEWS["v_incoming"] = """SELECT p_partkey AS ord, CASE WHEN p_partkey % 50 = 0 THEN 0 ELSE p_partkey % 900 END AS external_id, CASE WHEN p_partkey % 31 = 0 THEN '  ' ELSE concat(' ', p_name, ' ') END AS name, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_type END AS set_name, CAST(p_size AS STRING) AS card_number FROM part"""
VIEWS["v_crawl"] = """SELECT CAST(o_orderkey % 60 AS INT) AS page, CASE WHEN o_orderkey % 60 = 59 THEN NULL ELSE o_custkey * 7 + o_orderkey % 5 END AS id FROM orders"""
VIEWS["v_ids"] = """SELECT o_orderkey * 3 + CASE WHEN o_orderkey % 100 < 50 THEN 0 ELSE 1000000 END AS id FROM orders WHERE o_orderkey % 100 < 30 OR o_orderkey % 100 > 85"""
VIEWS["v_images"] = """SELECT p_partkey AS id, lower(replace(p_brand, '#', '')) AS set_code, CASE WHEN p_partkey % 19 = 0 THEN ' ' ELSE p_name END AS name, CASE WHEN p_partkey % 23 = 0 THEN '' ELSE concat('u', p_partkey) END AS url FROM part"""
VIEWS["v_ja_cards"] = """SELECT p_partkey AS card_id, CASE p_partkey % 16 WHEN 1 THEN concat('Alolan ', p_name, ' GX') WHEN 2 THEN concat('M ', p_name, '-EX') WHEN 3 THEN concat('Radiant ', p_name) WHEN 4 THEN concat('Origin Forme ', CASE WHEN p_partkey % 32 = 4 THEN 'Dialga' ELSE 'Palkia' END, CASE p_partkey % 3 WHEN 0 THEN ' V' WHEN 1 THEN ' VSTAR' ELSE ' VMAX' END)
   WHEN 5 THEN concat(p_name, '-GX') WHEN 6 THEN concat(p_name, ' V-UNION') WHEN 7 THEN concat(p_name, ' & More') WHEN 8 THEN concat(p_name, ' Coach') WHEN 9 THEN concat('GALARIAN ', p_name, ' vmax') WHEN 10 THEN concat(p_name, ' star') WHEN 11 THEN concat(p_name, ' ex') WHEN 12 THEN concat('Paldean ', p_name, '-EX') WHEN 13 THEN concat('m ', p_name, '-EX') ELSE p_name END AS name, CASE WHEN p_partkey % 13 = 0 THEN 'あり' END AS name_ja FROM part"""
VIEWS["v_set_pages"] = """SELECT lower(replace(p_brand, '#', '')) AS set_code, p_size AS page, CAST(100 + p_size * 3 AS BIGINT) AS hits, count(*) AS images FROM part WHERE p_size > 3 GROUP BY lower(replace(p_brand, '#', '')), p_size"""
VIEWS["v_year_cards"] = """SELECT p_partkey AS card_id, concat('Promo ', 2011 + p_size % 10) AS set_name, CAST(p_partkey % 40 AS STRING) AS card_number, CASE WHEN p_partkey % 5 = 0 THEN 'same' ELSE 'old' END AS image_url FROM part"""
VIEWS["v_scraped"] = """SELECT s_suppkey AS scraped_id, CASE WHEN s_suppkey % 7 = 0 THEN 'no year' ELSE concat('Set of ', 2011 + s_suppkey % 12, ' promos') END AS text, CAST(s_suppkey % 40 AS STRING) AS number, CASE WHEN s_suppkey % 9 = 0 THEN '' WHEN s_suppkey % 2 = 0 THEN 'same' ELSE concat('new', s_suppkey) END AS url FROM supplier"""
VIEWS["v_files"] = """SELECT concat('root/', lower(regexp_replace(p_type, '[^A-Za-z0-9]+', '-', 'g')), '/card_', CASE WHEN p_partkey % 2 = 0 THEN lpad(CAST(p_size AS STRING), 3, '0') ELSE CAST(p_size AS STRING) END, '_', p_partkey * 1000, '.png') AS path FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0"""
VIEWS["v_results"] = """SELECT event_id AS card_id, CASE event_type WHEN 'error' THEN 'timeout' WHEN 'click' THEN 'no image' END AS reason FROM events"""
VIEWS["v_srcset"] = """SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN concat('data:image/png;', p_partkey) ELSE concat('s', p_partkey) END AS src, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE concat('a', p_partkey, ' ', p_size, 'w, b', p_partkey, ' 25w') END AS srcset FROM part"""
VIEWS["v_manifest_a"] = """SELECT concat('f', p_partkey) AS filename, md5(p_name) AS sha256, p_size AS size FROM part WHERE p_partkey % 5 <> 0"""
VIEWS["v_manifest_b"] = """SELECT concat('f', p_partkey) AS filename, CASE WHEN p_partkey % 3 = 0 THEN md5(p_brand) ELSE md5(p_name) END AS sha256, p_size AS size FROM part"""
VIEWS["v_ann"] = """SELECT l_orderkey AS image_id, CAST(l_suppkey % 4 AS INT) AS category_id, CAST(l_partkey % 400 AS DOUBLE) AS x, CAST((l_suppkey * 7) % 300 AS DOUBLE) AS y, CAST(40 + l_quantity * 3 AS DOUBLE) AS w, CAST(56 + l_quantity * 4 AS DOUBLE) AS h FROM lineitem WHERE l_orderkey % 3 <> 0"""
VIEWS["v_label_sets"] = """SELECT p_partkey % 3 AS source, concat('img', p_partkey % 500) AS stem, min(p_size) AS k FROM part GROUP BY p_partkey % 3, p_partkey % 500"""

LOCAL, REMOTE = r'href="/(\w)(\w+)"', r'href="/([^"]{2})([^"]*)"'


def names(sp, d):
    own = table(sp, d, "part").filter("p_partkey % 4 <> 3").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("place"), F.concat(F.lit("カ"), F.min("p_partkey")).alias("kana"))
    return own.select("place", "name", "kana").union(table(sp, d, "region").filter("r_regionkey < 2").select(F.col("r_regionkey") - 2, F.when(F.col("r_regionkey") == 0, "Dialga").otherwise("Palkia"), F.concat(F.lit("ル"), "r_regionkey")))


def trainers(sp, d):
    return table(sp, d, "part").filter("p_partkey % 3 <> 1").groupBy(F.concat("p_name", F.lit(" Coach")).alias("name")).agg(F.min("p_partkey").alias("place"), F.concat(F.lit("ト"), F.min("p_partkey")).alias("kana")).select("place", "name", "kana")


def images(sp, d):
    return table(sp, d, "orders").select(F.col("o_orderkey").alias("image_id"), F.lit(640).alias("width"), F.lit(480).alias("height"))


def classes(sp, d):
    return table(sp, d, "region").select(F.col("r_regionkey").alias("category_id"), F.when(F.col("r_regionkey") % 2 == 0, F.concat("r_name", F.lit(" Card"))).otherwise(F.col("r_name")).alias("name"))


def annotations(sp, d):
    return view(sp, d, "v_ann").select("image_id", "category_id", F.array("x", "y", "w", "h").alias("bbox"))


def label_sets(sp, d):
    k = F.col("k").cast("string")
    lines = F.array(F.concat_ws(" ", F.lit("0 0.5 0.25 0.2"), F.concat(F.lit("0."), k)), F.concat_ws(" ", F.lit("1 0.1 0.1 0.3 0.1 0.3 0.4 0.1"), F.concat(F.lit("0."), k)), F.lit("2 0.5 0.5 0.5 0.5 0.5 0.5"), F.lit("3 0.5 0.5 0.2"), F.lit("1 1.2 0.5 0.3 0.2 0.1"), F.lit("0 0.9 -0.1 1.4 0.5"))
    v = view(sp, d, "v_label_sets").select("source", "stem", lines.alias("lines"))
    return [v.filter(F.col("source") == i) for i in range(3)]


QUERIES = {
    "a3_insert_if_absent": lambda sp, d: c.insert_if_absent(view(sp, d, "v_stored"), view(sp, d, "v_landed"), "external_id", "id"),
    "a4_upsert": lambda sp, d: c.upsert(view(sp, d, "v_stored"), view(sp, d, "v_incoming"), "external_id", ["name", "set_name", "card_number"], "ord"),
    "a5_parse_listing_titles": lambda sp, d: c.parse_listing_titles(view(sp, d, "v_listing_titles")),
    "a7_best_resolution": lambda sp, d: c.best_resolution(view(sp, d, "v_srcset")),
    "a8_delta_cutoff": lambda sp, d: c.delta_cutoff(view(sp, d, "v_crawl"), table(sp, d, "customer").filter("c_custkey % 9 = 0").select((F.col("c_custkey") * 7).alias("id"))),
    "a9_find_gaps": lambda sp, d: c.find_gaps(view(sp, d, "v_ids"), 150, 1000),
    "a10_extract_detail_pages": lambda sp, d: c.extract_detail_pages(table(sp, d, "pages"), r'track\((\d+)\)', r'<a href="/([^"]*)">', "[éü]"),
    "a11_explode_set_index": lambda sp, d: c.explode_set_index(table(sp, d, "pages"), r'<li><a href="/([^"]*)">', "<li><a [^>]*>([^<]*)</a>"),
    "a12_group_images_by_name": lambda sp, d: c.group_images_by_name(view(sp, d, "v_images")),
    "a12_set_totals": lambda sp, d: c.set_totals(view(sp, d, "v_set_pages")),
    "a13_enrich_names": lambda sp, d: c.enrich_names(view(sp, d, "v_ja_cards"), names(sp, d), trainers(sp, d)),
    "a13_enriched_counts": lambda sp, d: c.enriched_counts(c.enrich_names(view(sp, d, "v_ja_cards"), names(sp, d), trainers(sp, d))),
    "a14_refresh_images": lambda sp, d: c.refresh_images(view(sp, d, "v_year_cards"), view(sp, d, "v_scraped"), "Promo"),
    "a15_pending_embeddings": lambda sp, d: c.pending_embeddings(view(sp, d, "v_catalog").withColumn("image_url", F.when(F.col("card_id") % 6 != 0, F.lit("u"))), table(sp, d, "embeddings")).select("card_id", "language"),
    "a17_failure_report": lambda sp, d: c.failure_report(view(sp, d, "v_results")),
    "a17_retry_list": lambda sp, d: c.retry_list(view(sp, d, "v_catalog"), view(sp, d, "v_results").filter("reason = 'timeout'"), view(sp, d, "v_results").filter("reason = 'no image' AND card_id % 2 = 0"), view(sp, d, "v_results").filter("card_id % 10 = 0")).select("card_id", "name"),
    "a18_match_files_to_cards": lambda sp, d: c.match_files_to_cards(files(sp, d), view(sp, d, "v_catalog")),
    "a20_manifest_diff": lambda sp, d: c.manifest_diff(view(sp, d, "v_manifest_a"), view(sp, d, "v_manifest_b"), "https://assets.example/"),
    "a21_normalize_annotations": lambda sp, d: c.normalize_annotations(annotations(sp, d), images(sp, d), classes(sp, d)),
    "a21_annotation_counts": lambda sp, d: c.annotation_counts(annotations(sp, d), images(sp, d), classes(sp, d)),
    "a22_merge_label_sets": lambda sp, d: c.merge_label_sets(label_sets(sp, d)),
    "a23_train_valid_split": lambda sp, d: c.train_valid_split(table(sp, d, "orders").select("o_orderkey"), "o_orderkey"),
    "a24_stratified_sample": lambda sp, d: c.stratified_sample(view(sp, d, "v_catalog").select("card_id", "language"), "language", "card_id", 100),
}


def files(sp, d):
    t = table(sp, d, "part").filter("p_partkey % 2 = 0 OR p_partkey % 3 = 0")
    number = F.when(F.col("p_partkey") % 2 == 0, F.lpad(F.col("p_size").cast("string"), 3, "0")).otherwise(F.col("p_size").cast("string"))
    return t.select(F.concat(F.lit("root/"), F.regexp_replace(F.lower("p_type"), "[^a-z0-9]+", "-"), F.lit("/card_"), number, F.lit("_"), F.col("p_partkey") * 1000, F.lit(".png")).alias("path"))


ZERO = "CASE WHEN ltrim({0}, '0') = '' THEN '0' ELSE ltrim({0}, '0') END"
#: Rules as (pass, place, name with its suffix in lower case or as it is, filled), from base names with each suffix put on.
REG = ", ".join(f"({k}, '{e.lower()} ', '{j}')" for k, (e, j) in enumerate(c.REGIONS))
SUF = ", ".join(f"('{x}')" for x in ("", " vmax", " vstar", " v-union", " ex", " v", " break", "-gx", "-ex"))
RULES = [
    "bn AS (SELECT p_name AS name, min(p_partkey) AS place, 'カ' || min(p_partkey) AS kana FROM part WHERE p_partkey % 4 <> 3 GROUP BY p_name UNION ALL SELECT CASE r_regionkey WHEN 0 THEN 'Dialga' ELSE 'Palkia' END, r_regionkey - 2, 'ル' || r_regionkey FROM region WHERE r_regionkey < 2)",
    "tr AS (SELECT p_name || ' Coach' AS name, min(p_partkey) AS place, 'ト' || min(p_partkey) AS kana FROM part WHERE p_partkey % 3 <> 1 GROUP BY p_name)",
    f"lo AS (SELECT 1 AS pass, 0 AS outer_, place, lower(name) || s AS key, kana AS filled FROM bn, (VALUES {SUF}) AS v(s) UNION ALL SELECT 2, k, place, e || lower(name) || s, j || kana FROM bn, (VALUES {SUF}) AS v(s), (VALUES {REG}) AS r(k, e, j))",
    f"ex AS (SELECT 3 AS pass, 0 AS outer_, place, 'M ' || name || '-EX' AS key, '{c.MEGA}' || kana AS filled FROM bn UNION ALL SELECT 4, 0, place, 'Radiant ' || name, '{c.RADIANT}' || kana FROM bn UNION ALL SELECT 5, 0, place, 'Origin Forme ' || name || s, '{c.ORIGIN}' || kana FROM bn, (VALUES (' V'), (' VSTAR')) AS v(s) WHERE name IN ('Dialga', 'Palkia') UNION ALL SELECT 6, 0, place, name, kana FROM tr)",
    "hit AS (SELECT card_id, pass, outer_, place, filled FROM v_ja_cards JOIN lo ON lo.key = lower(name) WHERE NOT contains(name, ' & ') UNION ALL SELECT card_id, pass, outer_, place, filled FROM v_ja_cards JOIN ex ON ex.key = name)",
    "en AS (SELECT card_id, name, coalesce(name_ja, filled) AS name_ja, CASE WHEN name_ja IS NULL THEN pass END AS pass FROM v_ja_cards LEFT JOIN (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY card_id ORDER BY pass, outer_, place) = 1) USING (card_id))",
]
ORACLES = {
    "a3_insert_if_absent": with_views("SELECT * FROM v_stored UNION ALL SELECT external_id, name, set_name, card_number FROM (SELECT * FROM v_landed WHERE external_id NOT IN (SELECT external_id FROM v_stored) QUALIFY row_number() OVER (PARTITION BY external_id ORDER BY id) = 1)"),
    "a4_upsert": with_views("""SELECT coalesce(t.external_id, n.external_id) AS external_id, CASE WHEN n.external_id IS NOT NULL THEN n.name ELSE t.name END AS name, CASE WHEN n.external_id IS NOT NULL THEN n.set_name ELSE t.set_name END AS set_name, CASE WHEN n.external_id IS NOT NULL THEN n.card_number ELSE t.card_number END AS card_number,
      CASE WHEN n.external_id IS NOT NULL AND t.external_id IS NOT NULL THEN 'updated' WHEN n.external_id IS NOT NULL THEN 'inserted' ELSE 'kept' END AS action FROM v_stored t FULL JOIN n ON n.external_id = t.external_id""",
      "n AS (SELECT external_id, trim(name) AS name, nullif(trim(set_name), '') AS set_name, card_number FROM (SELECT * FROM v_incoming WHERE external_id <> 0 QUALIFY row_number() OVER (PARTITION BY external_id ORDER BY ord) = 1) WHERE trim(name) <> '')"),
    "a5_parse_listing_titles": "SELECT p_partkey AS card_id, p_name AS name, p_type AS set_name, p_size::VARCHAR AS card_number, CASE WHEN p_partkey % 4 = 1 THEN 50::BIGINT END AS set_total FROM part WHERE p_partkey % 4 <> 3",
    "a7_best_resolution": "SELECT p_partkey AS id, CASE WHEN p_partkey % 4 <> 0 THEN CASE WHEN p_size >= 25 THEN 'a' || p_partkey ELSE 'b' || p_partkey END WHEN p_partkey % 5 <> 0 THEN 's' || p_partkey END AS url FROM part",
    "a8_delta_cutoff": with_views("SELECT DISTINCT page, id FROM cs WHERE id IS NOT NULL AND NOT seen AND page <= coalesce((SELECT min(page) FROM (SELECT page FROM cs GROUP BY page HAVING avg(seen::INT) > 0.5 OR count(id) = 0)), 1000000)",
      "cs AS (SELECT page, id, coalesce(id IN (SELECT c_custkey * 7 FROM customer WHERE c_custkey % 9 = 0) OR page > min(page) OVER (PARTITION BY id) AND id IS NOT NULL, false) AS seen FROM v_crawl)"),
    "a9_find_gaps": with_views("SELECT prev + 1 AS first, id - 1 AS last, id - prev - 1 AS n FROM (SELECT id, lag(id) OVER (ORDER BY id) AS prev FROM (SELECT DISTINCT id FROM v_ids)) WHERE id - prev - 1 >= 150"),
    "a10_extract_detail_pages": r"""SELECT page_id, CASE WHEN t <> '' THEN t ELSE h END AS image, CASE WHEN t <> '' THEN regexp_extract(html, 'track\((\d+)\)', 1) ELSE regexp_extract(html, '<a href="/([^"]*)">', 1) END AS set_code, CASE WHEN regexp_matches(html, '(\d{1,3})\s*/\s*(\d{1,3})') THEN """ + ZERO.format(r"regexp_extract(html, '(\d{1,3})\s*/\s*(\d{1,3})', 1)") + r""" END AS card_number,
      CASE WHEN regexp_matches(html, '(\d{1,3})\s*/\s*(\d{1,3})') THEN """ + ZERO.format(r"regexp_extract(html, '(\d{1,3})\s*/\s*(\d{1,3})', 2)") + r""" END AS set_total, coalesce(list_filter(list_transform(regexp_extract_all(html, '(?is)<h1\b[^>]*>(.*?)</h1\s*>', 1), lambda x: array_to_string(list_transform(string_split_regex(x, '<[^>]*>'), lambda y: trim(y)), '')), lambda x: regexp_matches(x, '[éü]') AND length(x) > 1 AND length(x) < 40)[1],
      list_filter(list_transform(regexp_extract_all(html, '(?s)(?:^|>)([^<>]+)', 1), lambda x: trim(x)), lambda x: regexp_matches(x, '[éü]') AND length(x) > 1 AND length(x) < 30 AND NOT contains(x, chr(10)) AND NOT contains(x, '©'))[1]) AS title
      FROM (SELECT *, regexp_extract(html, 'track\(\d+\)') AS t, regexp_extract(html, '<a href="/[^"]*">') AS h FROM pages) WHERE t <> '' OR h <> ''""",
    "a11_explode_set_index": """SELECT page_id, (i - 1)::INT AS "at", c[i] AS code, l[i] AS label FROM (SELECT page_id, c, l, unnest(range(1, least(len(c), len(l)) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<li><a href="/([^"]*)">', 1) AS c, regexp_extract_all(html, '<li><a [^>]*>([^<]*)</a>', 1) AS l FROM pages))""",
    "a12_group_images_by_name": with_views("SELECT name, count(*) AS n, string_agg(set_code || ':' || place || ':' || url, '|' ORDER BY set_code, place) AS images FROM (SELECT *, row_number() OVER (PARTITION BY set_code ORDER BY id) AS place FROM v_images WHERE trim(url) <> '') WHERE trim(name) <> '' GROUP BY name"),
    "a12_set_totals": with_views("SELECT set_code, arg_min(hits, page) AS total, sum(images)::BIGINT AS images FROM v_set_pages GROUP BY set_code"),
    "a13_enrich_names": with_views("SELECT card_id, name, name_ja, pass FROM en", *RULES),
    "a13_enriched_counts": with_views("SELECT " + ", ".join(f"count(*) FILTER (pass = {n}) AS pass_{n}" for n in range(1, 7)) + ", count(name_ja) AS populated, count(*) FILTER (name_ja IS NULL) AS still_null FROM en", *RULES),
    "a14_refresh_images": with_views(r"""SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN y = '' THEN 'no year' WHEN card_id IS NULL THEN 'no match' WHEN url = '' THEN 'no image' WHEN image_url = url THEN 'same' ELSE 'updated' END AS outcome FROM (SELECT *, regexp_extract(text, '\b(20\d{2})\b', 1) AS y FROM v_scraped) s LEFT JOIN v_year_cards c ON c.set_name = 'Promo ' || s.y AND c.card_number = s.number) GROUP BY outcome"""),
    "a15_pending_embeddings": with_views("SELECT card_id, language FROM v_catalog WHERE card_id % 6 <> 0 AND card_id NOT IN (SELECT vec_id FROM embeddings)"),
    "a17_failure_report": with_views("SELECT reason, count(*) AS n FROM v_results WHERE reason IS NOT NULL GROUP BY reason"),
    "a17_retry_list": with_views("SELECT card_id, name FROM v_catalog WHERE card_id IN (SELECT card_id FROM v_results WHERE reason = 'timeout' OR (reason = 'no image' AND card_id % 2 = 0) OR card_id % 10 = 0)"),
    "a18_match_files_to_cards": with_views("SELECT card_id, path FROM (SELECT c.card_id, f.path, row_number() OVER (PARTITION BY c.card_id ORDER BY f.tier, f.path) AS r FROM (SELECT card_id, trim(regexp_replace(lower(set_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, ltrim(regexp_replace(card_number, '^[A-Za-z]+', ''), '0') AS number FROM v_catalog) c JOIN fl f ON f.slug = c.slug AND f.number = c.number) WHERE r = 1",
      "ft AS (SELECT 'root/' || slug || '/card_' || tk || '_' || (p_partkey * 1000) || '.png' AS path, slug, tk, p_partkey FROM (SELECT p_partkey, regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g') AS slug, CASE WHEN p_partkey % 2 = 0 THEN lpad(p_size::VARCHAR, 3, '0') ELSE p_size::VARCHAR END AS tk FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0))",
      "fl AS (SELECT path, slug, CASE WHEN length(t) >= 3 THEN 0 ELSE 1 END AS tier, ltrim(t, '0') AS number FROM (SELECT path, slug, unnest([tk, (p_partkey * 1000)::VARCHAR]) AS t FROM ft))"),
    "a20_manifest_diff": with_views("SELECT b.filename, b.size, CASE WHEN a.filename IS NULL THEN 'missing' ELSE 'changed' END AS state, 'https://assets.example/' || b.filename AS url FROM v_manifest_b b LEFT JOIN v_manifest_a a USING (filename) WHERE a.sha256 IS NULL OR a.sha256 <> b.sha256"),
    "a21_normalize_annotations": with_views("SELECT o_orderkey AS image_id, coalesce(n, 0) AS n, coalesce(labels, '') AS labels FROM orders LEFT JOIN lb ON image_id = o_orderkey",
      "la AS (SELECT image_id, '0 ' || printf('%.6f', floor(greatest(least((x + w / 2) / 640, 1), 0) * 1000000 + 0.5) / 1000000) || ' ' || printf('%.6f', floor(greatest(least((y + h / 2) / 480, 1), 0) * 1000000 + 0.5) / 1000000) || ' ' || printf('%.6f', floor(greatest(least(w / 640, 1), 0) * 1000000 + 0.5) / 1000000) || ' ' || printf('%.6f', floor(greatest(least(h / 480, 1), 0) * 1000000 + 0.5) / 1000000) AS l FROM v_ann WHERE category_id IN (0, 2) AND image_id IN (SELECT o_orderkey FROM orders))",
      "lb AS (SELECT image_id, count(*) AS n, string_agg(l, '|' ORDER BY l) AS labels FROM la GROUP BY image_id)"),
    "a21_annotation_counts": with_views("SELECT count(*) FILTER (category_id IN (0, 2)) AS boxes, count(*) FILTER (category_id NOT IN (0, 2)) AS skipped_class, (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT image_id FROM v_ann WHERE category_id IN (0, 2))) AS images_without FROM v_ann"),
    "a22_merge_label_sets": with_views("""SELECT CASE WHEN r = 1 THEN stem ELSE stem || '_' || r END AS stem, len(b)::INT AS n_boxes, array_to_string(b, '|') AS boxes FROM (SELECT stem, r, list_filter([CASE WHEN t > 0 THEN printf('0 0.500000 0.250000 0.200000 %.6f', t) END,
      printf('0 0.200000 %.6f 0.200000 %.6f', round((least(0.1, t) + greatest(0.4, t)) / 2, 6), round(greatest(0.4, t) - least(0.1, t), 6)), '0 0.650000 0.350000 1.000000 0.300000', '0 0.900000 0.000000 1.000000 0.500000'], lambda x: x IS NOT NULL) AS b
      FROM (SELECT *, ('0.' || k)::DOUBLE AS t, row_number() OVER (PARTITION BY stem ORDER BY source) AS r FROM v_label_sets))"""),
    "a23_train_valid_split": "SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY md5('s' || o_orderkey), o_orderkey) <= floor((SELECT count(*) FROM orders) * 0.8) THEN 'train' ELSE 'valid' END AS part FROM orders",
    "a24_stratified_sample": with_views("SELECT card_id, language FROM v_catalog QUALIFY row_number() OVER (PARTITION BY language ORDER BY md5('s' || card_id), card_id) <= 100"),
}
