"""Queries of OCR text and layout, with their DuckDB texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout as y
from ..operators import ocr as o
from ..sources.views import VIEWS, table, view, with_views

VIEWS["v_card_text"] = """SELECT p_partkey AS scan_id, concat(upper(substr(p_name, 1, 1)), substr(p_name, 2), chr(10), CASE WHEN p_partkey % 3 = 0 THEN 'weakness retreat' WHEN p_partkey % 3 = 1 THEN 'ピカチュウ 弱点 にげる' ELSE 'plain words' END, chr(10), CASE WHEN p_partkey % 4 = 0 THEN concat(p_size, '/', 165) WHEN p_partkey % 4 = 1 THEN concat('HP ', p_size) ELSE 'x' END, chr(10),
   CASE WHEN p_partkey % 17 = 0 THEN 'Supporter' WHEN p_partkey % 5 = 0 THEN 'Nintendo' ELSE '' END) AS text, CAST(p_size AS INT) AS blocks, 'pokemon' AS game, CASE WHEN p_partkey % 3 = 1 THEN 'ja' ELSE 'en' END AS language FROM part"""
VIEWS["v_fetched"] = """SELECT page_id, CASE page_id % 13 WHEN 0 THEN 403 WHEN 1 THEN 429 WHEN 2 THEN 503 ELSE 200 END AS status, CASE page_id % 11 WHEN 3 THEN concat('Just a moment', html) WHEN 4 THEN concat(html, 'Enable JavaScript') ELSE html END AS html FROM pages"""
VIEWS["v_runs"] = """SELECT o_custkey AS item, CAST(1 + o_orderkey % 3 AS INT) AS run, min(CASE WHEN o_orderpriority LIKE '1%' THEN 'blocked' WHEN o_orderpriority LIKE '2%' THEN 'no price' WHEN o_orderpriority LIKE '3%' THEN 'parse error' ELSE 'priced' END) AS outcome FROM orders GROUP BY o_custkey, 1 + o_orderkey % 3"""
VIEWS["v_rects"] = """SELECT l_orderkey AS image_id, l_linenumber, l_partkey, l_suppkey, CAST(l_partkey % 400 AS INT) AS x1, CAST((l_suppkey * 7) % 300 AS INT) AS y1, CAST(l_partkey % 400 AS INT) + 40 + CAST(l_quantity AS INT) * 3 AS x2, CAST((l_suppkey * 7) % 300 AS INT) + 56 + CAST(l_quantity AS INT) * 4 AS y2,
   round(l_discount * 5 + l_tax, 4) AS confidence, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 10000 + l_suppkey AS z FROM lineitem"""
VIEWS["v_blocks"] = """SELECT l_orderkey AS image_id, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 10000 + l_suppkey AS block_id, CAST(l_partkey % 400 AS INT) + CAST(l_suppkey % 90 AS INT) AS left, CAST((l_suppkey * 7) % 300 AS INT) + CAST(l_partkey % 120 AS INT) AS top, 30 AS width, 12 AS height, CASE WHEN l_partkey % 4 = 0 THEN concat(l_linenumber, '/', 50) ELSE concat('t', l_partkey) END AS text FROM lineitem"""
TIE = ["l_linenumber", "l_partkey", "l_suppkey"]
OCR = lambda sp, d: view(sp, d, "v_ocr").withColumn("game", F.when(F.col("scan_id") % 13 == 0, "onepiece").otherwise("pokemon"))
NAMES = lambda sp, d: table(sp, d, "part").filter("p_partkey % 3 <> 0").select(F.col("p_name").alias("name")).distinct()


def entries(sp, d):
    """A dictionary: capitalised names in the order of their first id."""
    return table(sp, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("dict_pos")).filter("dict_pos % 2 = 0").select(F.concat(F.upper(F.substring("p_name", 1, 1)), F.expr("substr(p_name, 2)")).alias("entry"), F.col("p_name").alias("translation"), "dict_pos")


def boxes(sp, d):
    return view(sp, d, "v_boxes").withColumn("box_id", F.expr("(CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 10000 + l_suppkey) * 1000 + box_width"))


def merged(sp, d):
    r = y.blocks_in_regions(view(sp, d, "v_blocks"), boxes(sp, d).filter("confidence >= 0.25").select("image_id", "box_id", "box_left", "box_top", "box_width", "box_height").distinct())
    return y.merge_region_text(r.withColumn("accepted", F.col("blocks") > 1).withColumn("detected", F.col("box_id") % 3 != 0).withColumn("late_number", F.when(F.col("box_id") % 5 == 0, "7/50"))).select("image_id", "box_id", "raw_text")


QUERIES = {
    "b1_extract_numbers": lambda sp, d: o.extract_numbers(OCR(sp, d)),
    "b2_dictionary_gate": lambda sp, d: o.dictionary_gate(OCR(sp, d).select("scan_id", F.lit(0).alias("pos"), F.col("raw_text").alias("text")), NAMES(sp, d)).groupBy("known").agg(F.count("*").alias("n"), F.sum("scan_id").alias("ids")),
    "b3_find_name": lambda sp, d: o.find_name(OCR(sp, d), NAMES(sp, d)),
    "b4_find_name_near_keyword": lambda sp, d: o.find_name_near_keyword(OCR(sp, d)),
    "b5_lookup_dictionary": lambda sp, d: o.lookup_dictionary(OCR(sp, d), entries(sp, d)),
    "b6_build_hints": lambda sp, d: o.build_hints(OCR(sp, d), NAMES(sp, d), entries(sp, d)),
    "b7_detect_language": lambda sp, d: o.detect_language(view(sp, d, "v_card_text")),
    "b8_score_card_text": lambda sp, d: o.score_card_text(view(sp, d, "v_card_text")),
    "b11_detect_blocked_pages": lambda sp, d: o.detect_blocked_pages(view(sp, d, "v_fetched")),
    "b12_assess_fetch_runs": lambda sp, d: o.assess_fetch_runs(view(sp, d, "v_runs"), table(sp, d, "customer").filter("c_custkey % 10 = 0").select(F.col("c_custkey").alias("item"))),
    "b12_fetch_totals": lambda sp, d: o.fetch_totals(view(sp, d, "v_runs"), table(sp, d, "customer").filter("c_custkey % 10 = 0").select(F.col("c_custkey").alias("item"))),
    "c1_blocks_in_regions": lambda sp, d: y.blocks_in_regions(view(sp, d, "v_blocks"), boxes(sp, d).select("image_id", "box_id", "box_left", "box_top", "box_width", "box_height").distinct()),
    "c2_merge_region_text": merged,
    "c3_pad_and_clamp": lambda sp, d: y.pad_and_clamp(view(sp, d, "v_boxes"), 350, 280).select("image_id", *TIE, "x", "y", "w", "h"),
    "c4_nms": lambda sp, d: y.nms(view(sp, d, "v_rects"), TIE).select("image_id", *TIE, "confidence"),
    "c5_filter_and_order": lambda sp, d: y.filter_and_order(view(sp, d, "v_boxes"), 640, 640, TIE, 0.05, 4).select("image_id", *TIE, "place"),
    "c6_best_box": lambda sp, d: y.best_box(view(sp, d, "v_boxes"), TIE).select("image_id", *TIE, "box_width", "box_height"),
    "c7_cluster_blocks": lambda sp, d: y.cluster_blocks(view(sp, d, "v_blocks").withColumn("image_width", F.lit(640)).withColumn("image_height", F.lit(480))),
    "c8_visible_boxes": lambda sp, d: y.visible_boxes(view(sp, d, "v_rects").select("image_id", "z", "x1", "y1", "x2", "y2")).select("image_id", "z", "covered_share"),
}

GAME = "oc AS (SELECT *, CASE WHEN scan_id % 13 = 0 THEN 'onepiece' ELSE 'pokemon' END AS game FROM v_ocr)"
NUM = r"""nu AS (SELECT scan_id, CASE WHEN a = '' THEN NULL WHEN ltrim(a, '0') = '' THEN '0' ELSE ltrim(a, '0') END AS number, CASE WHEN b = '' THEN NULL WHEN ltrim(b, '0') = '' THEN '0' ELSE ltrim(b, '0') END AS total, nullif(regexp_extract(raw_text, '(?i)\bHP\s*(\d+)\b', 1), '') AS hp, upper(nullif(regexp_extract(raw_text, '(?i)(OP\d{2}-\d{3}|ST\d{2}-\d{3}|P-\d{3})', 1), '')) AS code
  FROM (SELECT scan_id, raw_text, regexp_extract(t, '(\d{1,3})\s*/\s*(\d{1,3})', 1) AS a, regexp_extract(t, '(\d{1,3})\s*/\s*(\d{1,3})', 2) AS b FROM (SELECT *, regexp_replace(regexp_replace(raw_text, '(^|[^\p{L}\p{N}_])[oO](\d)', '\10\2', 'g'), '(^|[^\p{L}\p{N}_])[lI](\d)', '\11\2', 'g') AS t FROM oc)))"""
NAME = "nm AS (SELECT DISTINCT trim(regexp_replace(lower(p_name), '[^a-z0-9 ]', '', 'g')) AS name FROM part WHERE p_partkey % 3 <> 0)"
LINES = "ln AS (SELECT scan_id, language, game, list_filter(list_transform(string_split(raw_text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM oc)"
#: In these texts a name stands on the line with HP, below at most a stage or basic line; the rules leave the words between those.
GRAM = "list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))"
WORD = "string_split(trim(regexp_replace(lower({}), '[^a-z0-9 ]', '', 'g')), ' ')"
OKAY = r"NOT regexp_matches({0}, '\d') AND NOT regexp_matches(regexp_replace({0}, '(\w)''s\b', '\1', 'g'), '[.,!?;:()/\\'']') AND regexp_matches({0}, '^\p{{Lu}}') AND NOT (upper({0}) = {0} AND regexp_matches({0}, '\p{{L}}') AND length({0}) > 3)"
FOUND = [
    LINES, NAME,
    r"hp AS (SELECT scan_id, l[1:4] AS l, coalesce(list_position(list_transform(l[1:4], lambda x: regexp_matches(x, '(?i)\bHP\s*\d+\b')), true), 0) AS h FROM ln)",
    "cl AS (SELECT scan_id, l, h, unnest(range(1, len(l) + 1)) AS i FROM hp)",
    rf"ct AS (SELECT scan_id, i, h, l[i + 1] AS nx, trim(regexp_replace(regexp_replace(trim(regexp_replace(l[i], '(?i)\bHP\s*\d+\b', '', 'g')), '(?i)^(?:(?:{o.NON_NAME})(?:\s+|$))+', ''), '\s+', ' ', 'g')) AS t FROM cl WHERE h = 0 OR i <= least(h, 6))",
    rf"ck AS (SELECT scan_id, i, t, {WORD.format('t')} AS w FROM ct WHERE length(t) >= 3 AND len(string_split(t, ' ')) <= 3 AND {OKAY.format('t')} AND len(list_filter(string_split(t, ' '), lambda x: regexp_full_match(x, '(?i)(?:{o.NON_NAME})'))) = 0 AND NOT (h = 0 AND coalesce(regexp_matches(nx, '(?i)^(?:{o.ATTACK})'), false)))",
    f"fn AS (SELECT scan_id, arg_min(t, i) AS name FROM ck WHERE len(list_intersect({GRAM}, (SELECT list(name) FROM nm))) > 0 GROUP BY scan_id)",
]
NEAR = [
    r"ky AS (SELECT scan_id, l, i FROM (SELECT scan_id, l, unnest(range(1, len(l) + 1)) AS i FROM ln) WHERE regexp_full_match(l[i], '(?i)(Trainer|Supporter|Item|Tool|Technical\s+Machine)'))",
    r"kc AS (SELECT scan_id, i, a, trim(regexp_replace(l[a], '\s*\([^)]*\)\s*$', '')) AS t FROM (SELECT scan_id, l, i, unnest([i - 2, i - 1]) AS a FROM ky) WHERE a >= 1)",
    rf"nk AS (SELECT scan_id, arg_min(t, i * 1000 + a) AS name FROM kc WHERE length(t) >= 3 AND len(string_split_regex(t, '\s+')) <= 5 AND {OKAY.format('t')} GROUP BY scan_id)",
]
DICT = [
    "en AS (SELECT upper(left(p_name, 1)) || p_name[2:] AS entry, p_name AS translation, min(p_partkey) AS pos FROM part GROUP BY p_name HAVING min(p_partkey) % 2 = 0)",
    "dl AS (SELECT scan_id, language, game, i, l[i] AS line FROM (SELECT scan_id, language, game, l, unnest(range(1, len(l) + 1)) AS i FROM ln))",
    "dk AS (SELECT scan_id, language, game, entry, translation FROM dl JOIN en ON contains(line, entry) QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY CASE WHEN line = entry THEN 0 ELSE 1 END, i, pos) = 1)",
]
USE = "u0 AS (SELECT 1 FROM v_ocr LIMIT 0)"


def region(name: str, sep: str) -> str:
    x0, x1, y0, y1 = y.REGIONS[name]
    cond = f"cx BETWEEN box_left + box_width * {x0}::DOUBLE AND box_left + box_width * {x1}::DOUBLE AND cy BETWEEN box_top + box_height * {y0}::DOUBLE AND box_top + box_height * {y1}::DOUBLE"
    return f"coalesce(string_agg(text, {sep} ORDER BY top, block_id, text) FILTER ({cond}), '')"


BX = "bx AS (SELECT DISTINCT image_id, (CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 10000 + l_suppkey) * 1000 + box_width AS box_id, box_left, box_top, box_width, box_height FROM v_boxes{})"
RG = f"""rg AS (SELECT image_id, box_id, {region('name', 'chr(10)')} AS name_text, {region('whole', 'chr(10)')} AS whole_text, {region('left', "' '")} AS lt, {region('right', "' '")} AS rt, count(*) FILTER (cx BETWEEN box_left AND box_left + box_width AND cy BETWEEN box_top AND box_top + box_height) AS blocks
  FROM (SELECT *, "left" + width / 2 AS cx, top + height / 2 AS cy FROM bx JOIN v_blocks USING (image_id)) GROUP BY image_id, box_id)"""
R2 = r"r2 AS (SELECT image_id, box_id, name_text, whole_text, CASE WHEN regexp_matches(lt, '\d+/\d+') THEN lt WHEN regexp_matches(rt, '\d+/\d+') THEN rt WHEN lt <> '' THEN lt ELSE rt END AS number_text, blocks FROM rg)"
AREA = "(x2 - x1) * (y2 - y1)"
INTER = "greatest(least(k.x2, b.x2) - greatest(k.x1, b.x1), 0) * greatest(least(k.y2, b.y2) - greatest(k.y1, b.y1), 0)"
ORACLES = {
    "b1_extract_numbers": with_views("SELECT scan_id, number, total, hp, code FROM nu", GAME, NUM),
    "b2_dictionary_gate": with_views(f"SELECT known, count(*) AS n, sum(scan_id)::BIGINT AS ids FROM (SELECT scan_id, len(list_intersect({GRAM}, (SELECT list(name) FROM nm))) > 0 AS known FROM (SELECT scan_id, list_filter({WORD.format('raw_text')}, lambda x: x <> '') AS w FROM oc)) GROUP BY known", GAME, NAME),
    "b3_find_name": with_views("SELECT scan_id, name FROM fn", GAME, *FOUND),
    "b4_find_name_near_keyword": with_views("SELECT scan_id, name FROM nk", GAME, LINES, *NEAR),
    "b5_lookup_dictionary": with_views("SELECT scan_id, entry, translation FROM dk", GAME, LINES, *DICT),
    "b6_build_hints": with_views(
        """SELECT scan_id, name, kana_name, NULL::VARCHAR AS ja_trainer_name, number AS card_number, CASE WHEN game = 'pokemon' THEN total END AS set_total, CASE WHEN game = 'pokemon' THEN hp END AS hp, CASE WHEN name IS NULL THEN '(unknown)' WHEN number IS NULL THEN name ELSE name || ' #' || number END AS label FROM (
      SELECT oc.scan_id, oc.game, CASE WHEN oc.game = 'onepiece' THEN ln.l[1] WHEN oc.language = 'ja' THEN dk.translation ELSE coalesce(fn.name, nk.name) END AS name, CASE WHEN oc.game = 'pokemon' AND oc.language = 'ja' THEN dk.entry END AS kana_name, CASE WHEN oc.game = 'onepiece' THEN code ELSE number END AS number, total, hp
      FROM oc JOIN nu USING (scan_id) JOIN ln USING (scan_id) LEFT JOIN fn USING (scan_id) LEFT JOIN nk USING (scan_id) LEFT JOIN dk USING (scan_id))""",
        GAME, NUM, *FOUND, *NEAR, *DICT),
    "b7_detect_language": with_views(r"""SELECT scan_id, CASE WHEN j THEN 'ja' ELSE 'en' END AS language, CASE WHEN j THEN list_sort(list_transform(regexp_extract_all(text, '[゠-ヿー]+'), lambda x: [length(x)::VARCHAR, x]), 'DESC')[1][2] END AS kana, CASE WHEN j THEN nullif(regexp_extract(text, '(\d+)/(\d+)', 1), '') END AS number, CASE WHEN j THEN TRY_CAST(nullif(regexp_extract(text, '(\d+)/(\d+)', 2), '') AS BIGINT) END AS total
      FROM (SELECT *, regexp_matches(text, '[゠-ヿぁ-ゖ]{2,}') AS j FROM v_card_text)"""),
    "b8_score_card_text": with_views(r"""SELECT scan_id, score::INT AS score, score >= 3 AS is_card, CASE WHEN score >= 3 THEN NULL WHEN len(l) < 3 THEN 'too little text' WHEN blocks > 20 THEN 'too many regions' ELSE 'no card' END AS reason FROM (SELECT scan_id, blocks, l, CASE WHEN len(list_filter(l, lambda x: x = 'Supporter')) > 0 THEN 10 ELSE greatest(
      CASE WHEN regexp_matches(text, '\b\d{1,3}\s*/\s*\d{2,3}\b') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(text, '(?i)\bHP\s*\d+|\d+\s*HP\b') THEN 2 ELSE 0 END + CASE WHEN language = 'ja' THEN least(len(regexp_extract_all(text, '弱点|抵抗力|にげる|逃げる|特性|ワザ|グッズ|サポート|スタジアム|たね|進化')), 2) + CASE WHEN len(list_filter(l[1:6], lambda x: regexp_matches(x, '[゠-ヿ]{3,}'))) > 0 THEN 2 ELSE 0 END
      ELSE least(len(regexp_extract_all(text, '(?i)\b(weakness|resistance|retreat|basic|stage\s*[12]|trainer|supporter|stadium|item|energy)\b')), 2) + CASE WHEN len(list_filter(l[1:5], lambda x: regexp_full_match(x, '[A-Z][a-zA-Z\s\-''.]{1,30}'))) > 0 THEN 1 ELSE 0 END END
      + CASE WHEN regexp_matches(text, '(?i)nintendo') THEN 1 ELSE 0 END - CASE WHEN blocks > 20 THEN 1 ELSE 0 END, 0) END AS score FROM (SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM v_card_text))"""),
    "b11_detect_blocked_pages": with_views("SELECT page_id, CASE WHEN status = 403 THEN 'forbidden' WHEN status = 429 THEN 'rate limited' WHEN status >= 500 THEN 'server error' WHEN contains(html, 'Just a moment') OR contains(html, 'cf-browser-verification') THEN 'challenge' WHEN contains(html, 'Enable JavaScript') OR contains(html, 'Please enable cookies') THEN 'cookie gate' WHEN length(html) < 2000 THEN 'short' ELSE 'ok' END AS outcome FROM v_fetched"),
    "b12_assess_fetch_runs": with_views("""SELECT item, max(outcome) FILTER (run = 1) AS run_1, max(outcome) FILTER (run = 2) AS run_2, max(outcome) FILTER (run = 3) AS run_3, count(*) FILTER (outcome = 'priced') AS priced, count(*) FILTER (outcome = 'no price') AS no_price, count(*) FILTER (outcome = 'blocked') AS blocked, count(*) FILTER ((outcome IN ('blocked', 'parse error') OR outcome = 'no price' AND item % 10 <> 0)) AS failures, count(*) FILTER ((outcome IN ('blocked', 'parse error') OR outcome = 'no price' AND item % 10 <> 0)) > 0 AS unexpected FROM v_runs GROUP BY item"""),
    "b12_fetch_totals": with_views("SELECT count(*) FILTER (outcome = 'priced') AS priced, count(*) FILTER (item % 10 <> 0) AS expected_priced, count(DISTINCT item) FILTER ((outcome IN ('blocked', 'parse error') OR outcome = 'no price' AND item % 10 <> 0)) AS failed_items FROM v_runs"),
    "c1_blocks_in_regions": with_views("SELECT image_id, box_id, name_text, whole_text, number_text, blocks FROM r2", BX.format(""), RG, R2, "u0 AS (SELECT 1 FROM v_boxes, v_blocks LIMIT 0)"),
    "c2_merge_region_text": with_views(r"""SELECT image_id, box_id, CASE WHEN late IS NULL THEN t WHEN t IS NULL THEN late WHEN NOT regexp_matches(t, '\d+/\d+') THEN t || chr(10) || late ELSE t END AS raw_text FROM (SELECT image_id, box_id, CASE WHEN box_id % 5 = 0 THEN '7/50' END AS late, CASE WHEN box_id % 3 <> 0 THEN own WHEN blocks > 1 THEN coalesce(own, whole_text) END AS t
      FROM (SELECT *, CASE WHEN regexp_matches(number_text, '\d') THEN name_text || chr(10) || number_text ELSE nullif(name_text, '') END AS own FROM r2))""", BX.format(" WHERE confidence >= 0.25"), RG, R2),
    "c3_pad_and_clamp": with_views("""SELECT * FROM (SELECT image_id, l_linenumber, l_partkey, l_suppkey, x, y, least(350 - x, box_width + 2 * m) AS w, least(280 - y, box_height + 2 * m) AS h FROM (SELECT *, greatest(box_left - m, 0) AS x, greatest(box_top - m, 0) AS y FROM (SELECT *, floor(least(box_width, box_height) * 0.1::DOUBLE + 0.5)::INT AS m FROM v_boxes))) WHERE w > 0 AND h > 0"""),
    "c4_nms": with_views(
        "SELECT image_id, b.l_linenumber, b.l_partkey, b.l_suppkey, b.confidence FROM (SELECT image_id, unnest(kept) AS b FROM rc QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY n DESC) = 1)".replace("QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY n DESC) = 1", "WHERE n = total"),
        "s AS (SELECT image_id, {'l_linenumber': l_linenumber, 'l_partkey': l_partkey, 'l_suppkey': l_suppkey, 'confidence': confidence, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2} AS b, row_number() OVER w AS n, count(*) OVER (PARTITION BY image_id) AS total FROM v_rects WHERE confidence >= 0.25 WINDOW w AS (PARTITION BY image_id ORDER BY confidence DESC, l_linenumber, l_partkey, l_suppkey, x1, y1, x2, y2))",
        f"""rc AS (SELECT image_id, n, total, [b] AS kept FROM s WHERE n = 1 UNION ALL SELECT s.image_id, s.n, s.total, CASE WHEN len(list_filter(rc.kept, lambda k: {INTER.replace('b.', 's.b.')} > 0.45 * ((k.x2 - k.x1) * (k.y2 - k.y1) + (s.b.x2 - s.b.x1) * (s.b.y2 - s.b.y1) - {INTER.replace('b.', 's.b.')}))) = 0 THEN list_append(rc.kept, s.b) ELSE rc.kept END FROM rc JOIN s ON s.image_id = rc.image_id AND s.n = rc.n + 1)""",
        "u0 AS (SELECT 1 FROM v_rects LIMIT 0)").replace("WITH ", "WITH RECURSIVE ", 1),
    "c5_filter_and_order": with_views("SELECT image_id, l_linenumber, l_partkey, l_suppkey, place FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY box_top // 160, box_left, l_linenumber, l_partkey, l_suppkey)::INT AS place FROM v_boxes WHERE box_width * box_height >= 0.05 * 640 * 640) WHERE place <= 4"),
    "c6_best_box": with_views("SELECT image_id, l_linenumber, l_partkey, l_suppkey, box_width, box_height FROM v_boxes QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY round(box_width * box_height * confidence, 6) DESC, l_linenumber, l_partkey, l_suppkey) = 1"),
    "c8_visible_boxes": with_views(f"""SELECT image_id, z, covered_share FROM (SELECT b.image_id, b.z, round(coalesce(c.covered, 0) / greatest((b.x2 - b.x1) * (b.y2 - b.y1), 1), 6) AS covered_share FROM v_rects b LEFT JOIN (SELECT b.image_id, b.z, sum({INTER}) AS covered FROM v_rects b JOIN v_rects k ON k.image_id = b.image_id AND k.z > b.z GROUP BY 1, 2) c ON c.image_id = b.image_id AND c.z = b.z) WHERE covered_share <= 0.55"""),
}
