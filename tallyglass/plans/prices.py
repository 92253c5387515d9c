"""Queries of the price operators, with their DuckDB texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prices as p
from ..sources.views import VIEWS, table, view, with_views

VIEWS["v_sale_pages"] = """SELECT l_orderkey * 1000 + l_linenumber * 100 + l_suppkey % 100 AS page_id, concat('<table class="js hoverable-rows sortable"><tr><th>h</th></tr><tr><td>', CAST(l_shipdate AS DATE), '</td><td>x</td><td>card ', l_partkey,
   CASE WHEN l_linenumber % 3 = 0 THEN concat('<a class="t" href="https//www.ebay.example/itm/', l_orderkey, '">see</a>') WHEN l_linenumber % 3 = 1 THEN '<a href="/console/set">list</a>' ELSE concat('<a href="/offer/', l_partkey, '">offer</a>') END,
   '</td><td>', CASE WHEN l_linenumber % 2 = 0 THEN '<span class="listed-price-inline">$9,999.00</span>' ELSE '' END, CASE WHEN l_linenumber % 5 = 0 THEN concat('<span title="best offer accepted price">$', CAST(l_quantity AS INT), '.25</span> $1') ELSE concat('$', CAST(l_quantity AS INT), '.50') END,
   '</td></tr><tr><td>short</td></tr></table>') AS html FROM lineitem"""
VIEWS["v_hit_pages"] = """SELECT p_partkey AS page_id, concat('<table id="games_table"><tr><th>head</th></tr><tr><td class="title"><a href="/game/', p_brand, '/', p_partkey, '">', p_name, '</a></td><td class="console">', p_type, '</td><td class="price1">$', p_size, '.10</td><td class="price2">N/A</td><td class="price3">$', p_size + 1, '.20</td></tr></table>') AS html FROM part"""
VIEWS["v_cert_pages"] = """SELECT c_custkey AS page_id, concat('<h1>Cert ', c_name, '</h1><dl>', CASE WHEN c_custkey % 4 = 0 THEN '' ELSE concat('<dt>Subject</dt><dd>', c_mktsegment, '</dd>') END, '<dt>Item Grade</dt><dd>GEM MT ', c_nationkey % 10, '</dd><dt>Year</dt><dd>1999</dd><dt>Brand / Set</dt><dd><b>', c_mktsegment, '</b> set</dd><dt>Population</dt><dd>1,', 100 + c_nationkey, '</dd><dt>Pop Higher</dt><dd>none</dd></dl>') AS html FROM customer"""
VIEWS["v_requests"] = """SELECT o_custkey AS request_id, o_orderkey AS pos, o_orderkey % 3000 AS card_id FROM orders"""

V = lambda n: (lambda sp, d: view(sp, d, n))
PART = lambda sp, d: table(sp, d, "part").select(F.col("p_partkey").alias("card_id"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_retailprice")).alias("ungraded"), F.when(F.col("p_size") > 25, F.col("p_retailprice") * 10).alias("grade_10"))
NOW = lambda: F.lit("2024-02-01 00:00:00").cast("timestamp")


def key_cards(sp, d):
    return view(sp, d, "v_catalog").withColumn("stored_page", F.when(F.col("card_id") % 9 == 0, F.concat(F.lit("game/stored/"), "card_id"))).withColumn("scanned_number", F.when(F.col("card_id") % 4 == 0, F.lit("077")))


def alias(sp, d):
    return view(sp, d, "v_catalog").groupBy("set_name").agg(F.count("*")).filter(F.col("set_name").startswith("S")).select("set_name", F.explode(F.array(F.lit("en"), F.lit("ja"))).alias("language"), F.lit("aliased").alias("alias"))


def points(sp, d):
    """Price points by customer, from orders."""
    return table(sp, d, "orders").select(F.col("o_custkey").alias("card_id"), F.col("o_orderkey").alias("at"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("month"), F.round(F.col("o_totalprice") / 10000, 2).alias("price"))


def sold(sp, d):
    return view(sp, d, "v_collection_events").filter("op = 'add'").select("collection_id", "card_id", F.when(F.col("seq") % 2 == 0, "graded").otherwise("raw").alias("kind"))


def rates(sp, d):
    return table(sp, d, "events").select(F.struct("ts", "event_id").alias("day"), (F.lit(140) + F.round("value", 1)).alias("rate"))


def slim(sp, d):
    sales = p.recent_sales(view(sp, d, "v_sales"), PART(sp, d)).select("card_id", "rank", "date_text", "title", F.col("href").alias("url"))
    r = p.batch_prices_slim(view(sp, d, "v_requests").withColumnRenamed("pos", "at"), view(sp, d, "v_catalog"), PART(sp, d), sales)
    sold = F.transform("price.recent_sales", lambda x: F.concat_ws(" ", x["date_text"], x["title"], x["url"]))
    return r.select("request_id", "at", "card_id", "status", "price.ungraded", "price.grade_10", F.size(sold).alias("n_sales"), F.array_join(sold, "|").alias("sales"))


QUERIES = {
    "p1_page_keys": lambda sp, d: p.page_keys(key_cards(sp, d), alias(sp, d)),
    "p1_page_keys_ja": lambda sp, d: p.page_keys(key_cards(sp, d), alias(sp, d), "ja", "master_ball"),
    "p2_extract_prices": lambda sp, d: p.extract_prices(view(sp, d, "v_price_pages")),
    "p3_extract_history": lambda sp, d: p.extract_history(view(sp, d, "v_price_pages")),
    "p4_extract_sales": lambda sp, d: p.extract_sales(view(sp, d, "v_sale_pages")),
    "p5_recent_sales": lambda sp, d: p.recent_sales(view(sp, d, "v_sales"), PART(sp, d)),
    "p6_extract_search_hits": lambda sp, d: p.extract_search_hits(view(sp, d, "v_hit_pages")),
    "p7_extract_certificates": lambda sp, d: p.extract_certificates(view(sp, d, "v_cert_pages")),
    "p8_price_freshness": lambda sp, d: p.freshness(view(sp, d, "v_catalog"), view(sp, d, "v_history").select("id", "card_id", F.col("scanned_at").alias("cached_at"), F.when(F.col("scan_type") != "click", F.col("price_loose")).alias("price")), NOW()),
    "p9_batch_prices": lambda sp, d: p.batch_prices(view(sp, d, "v_requests").withColumnRenamed("pos", "at"), view(sp, d, "v_catalog"), PART(sp, d).select("card_id", F.col("ungraded").alias("price"))),
    "p9_batch_prices_slim": slim,
    "p10_classify_sales": lambda sp, d: p.classify_sales(view(sp, d, "v_sales")),
    "p11_convert_currency": lambda sp, d: p.convert_currency(PART(sp, d).select("card_id", F.col("ungraded").alias("price")), rates(sp, d)),
    "p11_convert_history": lambda sp, d: p.convert_history(p.extract_history(view(sp, d, "v_price_pages")), rates(sp, d)),
    "p12_chart_series": lambda sp, d: p.chart_series(points(sp, d)),
    "p13_portfolio_value": lambda sp, d: p.portfolio_value(sold(sp, d), PART(sp, d)),
    "p14_link_labels": lambda sp, d: view(sp, d, "v_sales").groupBy(p.link_label(F.col("href")).alias("label")).agg(F.count("*").alias("n")),
}

SLUG = "trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9 -]', '', 'g'), '[ -]+', '-', 'g'), '-')"
ALIAS = "al AS (SELECT DISTINCT set_name FROM v_catalog WHERE set_name LIKE 'S%')"
KEYS = "kc AS (SELECT *, CASE WHEN card_id % 9 = 0 THEN 'game/stored/' || card_id END AS stored_page, CASE WHEN card_id % 4 = 0 THEN '077' END AS scanned_number FROM v_catalog)"


def key_sql(page: str, lang: str) -> str:
    return f"SELECT card_id, page, string_split(page, '/')[-2] || '_' || string_split(page, '/')[-1] || ':card:' || {lang} AS cache_key FROM (SELECT card_id, language, {page} AS page FROM kc LEFT JOIN al USING (set_name))"


SET = f"CASE WHEN al.set_name IS NOT NULL THEN 'aliased' ELSE {SLUG.format('kc.set_name')} END"
SQ = "sq AS (SELECT *, CASE l_linenumber % 4 WHEN 1 THEN date_text[7:10] || '-' || date_text[1:2] || '-' || date_text[4:5] WHEN 2 THEN strftime(strptime(date_text, '%b %d, %Y'), '%Y-%m-%d') ELSE date_text END AS key FROM v_sales)"
PARTS = "pr AS (SELECT p_partkey AS card_id, CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice END AS ungraded, CASE WHEN p_size > 25 THEN p_retailprice * 10 END AS grade_10 FROM part)"
RECENT = """rs AS (SELECT card_id, rank, date_text, title, href FROM (SELECT *, count(href) OVER (PARTITION BY card_id) AS links FROM (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY key DESC, l_orderkey, l_linenumber, l_suppkey)::INT AS rank FROM sq) WHERE rank <= 10) LEFT JOIN pr USING (card_id) WHERE ungraded IS NOT NULL OR links > 0)"""
HISTORY = r"""SELECT page_id, series, (i - 1)::INT AS at, strftime(to_timestamp(CAST(pt[1] AS BIGINT) / 1000) AT TIME ZONE 'UTC', '%Y-%m') AS month, round(CAST(pt[2] AS BIGINT) / 100, 2) AS price FROM (
      SELECT page_id, series, i, from_json(json_extract(j, '$[' || (i - 1) || ']'), '["BIGINT"]') AS pt FROM (SELECT page_id, series, json_extract(c, '$.' || series) AS j, unnest(range(1, 1 + json_array_length(json_extract(c, '$.' || series))::INT)) AS i FROM (
      SELECT page_id, regexp_extract(html, 'chart_data = (\{.*\});', 1)::JSON AS c FROM v_price_pages), (VALUES ('used'), ('graded')) AS s(series))) WHERE pt[2] <> 0"""
ORACLES = {
    "p1_page_keys": with_views(key_sql(f"coalesce(stored_page, 'game/' || CASE language WHEN 'ja' THEN 'pokemon-japanese-' ELSE 'pokemon-' END || {SET} || '/' || {SLUG.format('name')} || '-' || CASE WHEN ltrim(card_number, '0') = '' THEN '0' ELSE ltrim(card_number, '0') END)", "language"), KEYS, ALIAS),
    "p1_page_keys_ja": with_views(key_sql(f"'game/pokemon-japanese-' || {SET} || '/' || {SLUG.format('name')} || '-master-ball-' || ltrim(CASE WHEN language = 'ja' THEN card_number ELSE coalesce(scanned_number, card_number) END, '0')", "'ja'"), KEYS, ALIAS),
    "p2_extract_prices": with_views(r"""SELECT page_id, CAST(regexp_extract(html, 'Ungraded</td><td>\$([0-9.]+)', 1) AS DOUBLE) AS ungraded, NULL::DOUBLE AS grade_7, NULL::DOUBLE AS grade_8, NULL::DOUBLE AS grade_9, TRY_CAST(nullif(regexp_extract(html, 'PSA 10</td><td>\$([0-9.]+)', 1), '') AS DOUBLE) AS grade_10 FROM v_price_pages"""),
    "p3_extract_history": with_views(HISTORY),
    "p4_extract_sales": with_views("""SELECT l_orderkey * 1000 + l_linenumber * 100 + l_suppkey % 100 AS page_id, 1 AS at, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS date_text, 'card ' || l_partkey || CASE l_linenumber % 3 WHEN 0 THEN 'see' WHEN 1 THEN 'list' ELSE 'offer' END AS title,
      CAST(l_quantity AS INT) + CASE WHEN l_linenumber % 5 = 0 THEN 0.25 ELSE 0.5 END::DOUBLE AS price, CASE l_linenumber % 3 WHEN 0 THEN 'https://www.ebay.example/itm/' || l_orderkey WHEN 2 THEN 'https://prices.example/offer/' || l_partkey END AS url FROM lineitem"""),
    "p5_recent_sales": with_views("""SELECT card_id, l_orderkey, l_linenumber, l_suppkey, rank, date_text, title, href FROM (SELECT *, count(href) OVER (PARTITION BY card_id) AS links FROM (
      SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY key DESC, l_orderkey, l_linenumber, l_suppkey)::INT AS rank FROM sq) WHERE rank <= 10) LEFT JOIN pr USING (card_id) WHERE ungraded IS NOT NULL OR links > 0""", SQ, PARTS, "u0 AS (SELECT 1 FROM v_sales LIMIT 0)"),
    "p6_extract_search_hits": "SELECT p_partkey AS page_id, 0 AS at, p_name AS title, 'https://prices.example/game/' || p_brand || '/' || p_partkey AS url, p_partkey::VARCHAR AS hit_id, p_size + 0.1::DOUBLE AS price1, NULL::DOUBLE AS price2, p_size + 1.2::DOUBLE AS price3, p_type AS console FROM part",
    "p7_extract_certificates": "SELECT c_custkey AS page_id, CASE WHEN c_custkey % 4 = 0 THEN 'Cert ' || c_name ELSE c_mktsegment END AS name, 'GEM MT ' || (c_nationkey % 10) AS grade, c_mktsegment || ' set' AS set_name, '1999' AS year, NULL::VARCHAR AS variety, 1100 + c_nationkey AS population, NULL::INT AS higher FROM customer",
    "p8_price_freshness": with_views("""SELECT card_id, state, state IN ('never', 'expired') AS fetch FROM (SELECT card_id, CASE WHEN cached IS NULL THEN 'never' WHEN price IS NULL AND age < 3600 THEN 'missing' WHEN price IS NOT NULL AND age < 86400 THEN 'fresh' ELSE 'expired' END AS state FROM (
      SELECT c.card_id, l.cached, l.price, epoch(TIMESTAMP '2024-02-01 00:00:00') - floor(epoch(l.cached)) AS age FROM v_catalog c LEFT JOIN (SELECT card_id, scanned_at AS cached, CASE WHEN scan_type <> 'click' THEN price_loose END AS price FROM v_history WHERE card_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY card_id ORDER BY scanned_at DESC, id DESC) = 1) l USING (card_id)))"""),
    "p9_batch_prices": with_views("""SELECT request_id, q."at", q.card_id, CASE WHEN c.card_id IS NULL THEN 'not_found' ELSE 'ok' END AS status, CASE WHEN c.card_id IS NOT NULL THEN ungraded END AS price FROM (SELECT request_id, card_id, row_number() OVER (PARTITION BY request_id ORDER BY f, card_id)::INT AS "at" FROM (SELECT request_id, card_id, min(pos) AS f FROM v_requests GROUP BY 1, 2)) q
      LEFT JOIN v_catalog c USING (card_id) LEFT JOIN pr ON pr.card_id = q.card_id WHERE q."at" <= 25""", PARTS),
    "p9_batch_prices_slim": with_views("""SELECT request_id, q."at", q.card_id, CASE WHEN c.card_id IS NULL THEN 'not_found' ELSE 'ok' END AS status, CASE WHEN c.card_id IS NOT NULL THEN ungraded END AS ungraded, CASE WHEN c.card_id IS NOT NULL THEN grade_10 END AS grade_10, CASE WHEN c.card_id IS NULL THEN NULL ELSE coalesce(n, 0) END AS n_sales, CASE WHEN c.card_id IS NULL THEN NULL ELSE coalesce(sales, '') END AS sales
      FROM (SELECT request_id, card_id, row_number() OVER (PARTITION BY request_id ORDER BY f, card_id)::INT AS "at" FROM (SELECT request_id, card_id, min(pos) AS f FROM v_requests GROUP BY 1, 2)) q LEFT JOIN v_catalog c USING (card_id) LEFT JOIN pr ON pr.card_id = q.card_id LEFT JOIN s3 ON s3.card_id = q.card_id WHERE q."at" <= 25""",
      SQ, PARTS, RECENT, "s3 AS (SELECT card_id, count(*)::INT AS n, string_agg(concat_ws(' ', date_text, title, href), '|' ORDER BY rank) AS sales FROM rs WHERE rank <= 3 GROUP BY card_id)", "u0 AS (SELECT 1 FROM v_sales LIMIT 0)"),
    "p10_classify_sales": with_views("""SELECT card_id, sale_class, rank, l_orderkey, l_linenumber, l_suppkey, title FROM (SELECT *, row_number() OVER (PARTITION BY card_id, sale_class ORDER BY l_orderkey, l_linenumber, l_suppkey)::INT AS rank FROM (SELECT *, CASE WHEN title LIKE '%PSA 10%' THEN '10' WHEN title LIKE '%BGS-9%' THEN '9' ELSE 'raw' END AS sale_class FROM v_sales WHERE title NOT LIKE '%Poke Ball%')) WHERE rank <= 10"""),
    "p11_convert_currency": "SELECT p_partkey AS card_id, jpy, CASE WHEN jpy IS NULL THEN 'N/A' ELSE '¥' || format('{:,}', jpy) END AS shown FROM (SELECT p_partkey, floor(CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice END * rate + 0.5)::BIGINT AS jpy FROM part, (SELECT 140 + round(value, 1) AS rate FROM events ORDER BY ts DESC, event_id DESC LIMIT 1))",
    "p11_convert_history": with_views("SELECT page_id, series, h.\"at\", month, floor(price * rate + 0.5)::DOUBLE AS price FROM (" + HISTORY + ") h, (SELECT 140 + round(value, 1) AS rate FROM events ORDER BY ts DESC, event_id DESC LIMIT 1)"),
    "p12_chart_series": """SELECT card_id, (points - r)::INT AS place, price, CASE WHEN (points - r) % ceil(points / 6)::INT = 0 THEN left(month, 7) ELSE '' END AS label, CASE WHEN most < 1 THEN 2 WHEN most < 10 THEN 1 ELSE 0 END AS decimals FROM (
      SELECT *, count(*) OVER (PARTITION BY card_id) AS points, max(price) OVER (PARTITION BY card_id) AS most FROM (SELECT o_custkey AS card_id, strftime(o_orderdate, '%Y-%m-%d') AS month, round(o_totalprice / 10000, 2) AS price, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r <= 24) WHERE points >= 2""",
    "p13_portfolio_value": with_views("SELECT collection_id, round(coalesce(sum(CASE WHEN seq % 2 = 0 THEN grade_10 ELSE ungraded END), 0), 2) AS value, count(*) AS items FROM v_collection_events JOIN pr USING (card_id) WHERE op = 'add' GROUP BY collection_id", PARTS),
    "p14_link_labels": with_views("SELECT CASE WHEN href LIKE '%tcgplayer%' THEN 'TCGPlayer' WHEN href LIKE '%ebay%' THEN 'eBay' WHEN href IS NOT NULL THEN 'View' END AS label, count(*) AS n FROM v_sales GROUP BY 1"),
}
