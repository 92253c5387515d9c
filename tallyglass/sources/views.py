"""Input views derived from the given tables. Each text is valid in Spark SQL and in DuckDB, so queries and checks share it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "v_catalog": """SELECT p_partkey AS card_id, 'pokemon' AS game, CASE WHEN p_partkey % 2 = 0 THEN 'en' ELSE 'ja' END AS language,
       p_name AS name, CASE WHEN p_partkey % 2 = 1 THEN concat('カード', p_name) END AS name_ja, p_type AS set_name,
       CASE WHEN p_brand = 'Brand#7' THEN 'mcd7' ELSE lower(replace(p_brand, '#', '')) END AS set_code,
       lpad(CAST(p_size AS STRING), 3, '0') AS card_number, 40 + (p_partkey % 3) * 5 AS set_total FROM part""",
    "v_queries": """SELECT p_partkey AS query_id, 'pokemon' AS game, CASE WHEN p_partkey % 20 = 0 THEN 'en' ELSE 'ja' END AS language,
       CASE WHEN p_partkey % 30 = 0 THEN p_name WHEN p_partkey % 30 = 10 THEN substr(p_name, 1, length(p_name) - 1)
            ELSE replace(replace(p_name, 'l', 'i'), 'o', 'c') END AS text,
       CASE WHEN p_partkey % 40 = 0 THEN CAST(p_size AS STRING) END AS card_number,
       CASE WHEN p_partkey % 60 = 0 THEN 40 + (p_partkey % 3) * 5 END AS set_total FROM part WHERE p_partkey % 10 = 0""",
    "v_ocr": """SELECT p_partkey AS scan_id, CASE WHEN p_partkey % 5 = 0 THEN 'ja' ELSE 'en' END AS language, concat(CASE WHEN p_partkey % 7 = 0 THEN 'BASIC' || chr(10) ELSE 'Stage 1' || chr(10) END, upper(substr(p_name, 1, 1)), substr(p_name, 2), ' HP ', CAST(p_size * 10 AS STRING), chr(10),
       CASE WHEN p_partkey % 11 = 0 THEN 'Great Plan (Old)' || chr(10) || 'Supporter' || chr(10) ELSE '' END, 'weakness', chr(10), 'o', CAST(p_size AS STRING), '/', CAST(40 + (p_partkey % 3) * 5 AS STRING)) AS raw_text FROM part""",
    "v_frames": """SELECT user_id AS session_id, event_id AS frame_id, ts, CASE WHEN value < 2 THEN NULL ELSE event_type END AS top_card, least(value / 100, 1.0) AS sim FROM events""",
    "v_boxes": """SELECT l_orderkey AS image_id, l_linenumber, l_partkey, l_suppkey, CAST(l_partkey % 400 AS INT) AS box_left, CAST((l_suppkey * 7) % 300 AS INT) AS box_top,
       40 + CAST(l_quantity AS INT) * 3 AS box_width, 56 + CAST(l_quantity AS INT) * 4 AS box_height, round(l_discount * 5 + l_tax, 4) AS confidence FROM lineitem""",
    "v_sales": """SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey AS card_id,
       CASE l_linenumber % 4 WHEN 0 THEN CAST(year(l_shipdate) AS STRING) || '-' || lpad(CAST(month(l_shipdate) AS STRING), 2, '0') || '-' || lpad(CAST(day(l_shipdate) AS STRING), 2, '0')
         WHEN 1 THEN lpad(CAST(month(l_shipdate) AS STRING), 2, '0') || '/' || lpad(CAST(day(l_shipdate) AS STRING), 2, '0') || '/' || CAST(year(l_shipdate) AS STRING)
         WHEN 2 THEN substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(month(l_shipdate) AS INT) * 3 - 2, 3) || ' ' || lpad(CAST(day(l_shipdate) AS STRING), 2, '0') || ', ' || CAST(year(l_shipdate) AS STRING)
         ELSE 'unknown' END AS date_text,
       'card ' || CAST(l_partkey AS STRING) || CASE l_returnflag WHEN 'A' THEN ' PSA 10' WHEN 'R' THEN ' BGS-9' ELSE ' near mint' END || CASE WHEN l_suppkey % 11 = 0 THEN ' Poke Ball' ELSE '' END AS title,
       '$' || CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS STRING) AS price_text,
       CASE WHEN l_linestatus = 'O' THEN '//www.ebay.example/itm/' || CAST(l_orderkey AS STRING) END AS href FROM lineitem""",
    "v_history": """SELECT event_id AS id, CASE WHEN event_type = 'error' THEN NULL ELSE user_id % 40 END AS card_id, event_type AS scan_type, round(value, 2) AS price_loose, ts AS scanned_at FROM events""",
    "v_collection_events": """SELECT o_orderkey AS seq, o_custkey % 50 AS collection_id, o_orderkey % 40 AS card_id, CASE o_orderstatus WHEN 'P' THEN 'remove' ELSE 'add' END AS op FROM orders""",
    "v_listing_titles": """SELECT p_partkey AS card_id, p_name || ' (' || p_type || CASE p_partkey % 4 WHEN 0 THEN ' No. ' || lpad(CAST(p_size AS STRING), 3, '0')
         WHEN 1 THEN ' ' || lpad(CAST(p_size AS STRING), 3, '0') || '/050' WHEN 2 THEN ' ' || lpad(CAST(p_size AS STRING), 3, '0') || '/PR-P' ELSE '' END || ')' AS alt_text FROM part""",
    "v_price_pages": """SELECT p_partkey AS page_id, '<table id="full-prices"><tr><td>Ungraded</td><td>$' || CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS STRING) || '</td></tr>'
       || CASE WHEN p_size > 25 THEN '<tr><td>PSA 10</td><td>$' || CAST(p_size * 100 AS STRING) || '.50</td></tr>' ELSE '' END || '</table>'
       || '<script>VGPC.chart_data = {"used":[[1704067200000,' || CAST(p_size * 100 AS STRING) || '],[1706745600000,0]],"graded":[]};</script>' AS html FROM part""",
    "v_vectors": """SELECT vec_id, embedding, label, CASE WHEN vec_id % 2 = 0 THEN 'en' ELSE 'ja' END AS language FROM embeddings""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame; its source is passed by reference, so no session-wide name is made."""
    text = VIEWS[name]
    source = text.rsplit("FROM ", 1)[1].split()[0]
    head, tail = (t.replace("{", "{{").replace("}", "}}") for t in text.rsplit(f"FROM {source}", 1))
    return spark.sql(f"{head}FROM {{{source}}}{tail}", **{source: table(spark, sf_dir, source)})


def with_views(sql: str, *more: str) -> str:
    """A DuckDB text with the views it names, and further (name AS (..)) parts, put before it."""
    names = [n for n in VIEWS if n in sql or any(n in m for m in more)]
    parts = [*(f"{n} AS ({VIEWS[n]})" for n in names), *more]
    return ("WITH " + ", ".join(parts) + "\n" if parts else "") + sql
