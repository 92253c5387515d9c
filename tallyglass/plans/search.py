"""Queries of the text search, with their DuckDB texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import share_sql, trigrams_sql
from ..operators import search as s
from ..sources.views import view, with_views

CAT = lambda spark, d: view(spark, d, "v_catalog")
QRY = lambda spark, d: view(spark, d, "v_queries")


def other_catalog(spark, d):
    return CAT(spark, d).filter("card_id % 3 = 0").withColumn("card_id", F.col("card_id") + 1_000_000)


def own_names(spark, d):
    return CAT(spark, d).filter("card_id % 4 <> 0")


def second_source(spark, d):
    return CAT(spark, d).filter("card_id % 3 <> 1").select((F.col("card_id") + 2_000_000).alias("card_id"), "game", "language", "name", "set_total", (F.col("card_id") % 17).alias("place"))


def certificates(spark, d):
    return QRY(spark, d).filter("query_id % 20 = 0").select(F.col("query_id").alias("cert_id"), F.col("text").alias("name"))


def prices(spark, d):
    from ..sources.views import table

    return table(spark, d, "part").select(F.col("p_partkey").alias("card_id"), F.col("p_retailprice").alias("price"))


def free_queries(spark, d):
    """Search texts with tokens, exclusions and numbers."""
    return QRY(spark, d).select("query_id", "game", "language", F.concat("text", F.when(F.col("query_id") % 3 == 0, " -brass").when(F.col("query_id") % 7 == 0, " tin").otherwise(""), F.when(F.col("query_id") % 50 == 0, F.concat(F.lit(" 0"), F.col("query_id") % 10, F.lit("5"))).otherwise("")).alias("text"))


FREE = "v_free AS (SELECT query_id, game, language, text || CASE WHEN query_id % 3 = 0 THEN ' -brass' WHEN query_id % 7 = 0 THEN ' tin' ELSE '' END || CASE WHEN query_id % 50 = 0 THEN ' 0' || (query_id % 10) || '5' ELSE '' END AS text FROM v_queries)"

QUERIES = {
    "j1_name_search": lambda sp, d: s.name_search(QRY(sp, d), CAT(sp, d)),
    "j2_fuzzy_search": lambda sp, d: s.fuzzy_search(s.unmatched(QRY(sp, d), s.name_search(QRY(sp, d), CAT(sp, d))), CAT(sp, d)),
    "j3_ja_name_search": lambda sp, d: s.ja_name_search(QRY(sp, d), CAT(sp, d)),
    "j4_fallback_source": lambda sp, d: s.fallback_source(QRY(sp, d), s.name_search(QRY(sp, d), CAT(sp, d)), CAT(sp, d), other_catalog(sp, d)),
    "j5_language_fallback": lambda sp, d: s.language_fallback(QRY(sp, d), CAT(sp, d)),
    "j6_tokens_search": lambda sp, d: s.tokens_search(QRY(sp, d), CAT(sp, d)),
    "j7_tiered_lookup": lambda sp, d: s.tiered_lookup(QRY(sp, d), CAT(sp, d)),
    "j7_lookup_second_source": lambda sp, d: s.tiered_lookup(QRY(sp, d), own_names(sp, d), False, second_source(sp, d)),
    "j7_all_of_name": lambda sp, d: s.all_of_name(QRY(sp, d), own_names(sp, d), second_source(sp, d)),
    "j8_attach_metadata": lambda sp, d: s.attach_metadata(s.name_search(QRY(sp, d), CAT(sp, d)), CAT(sp, d)),
    "j9_match_certificates": lambda sp, d: s.match_certificates(certificates(sp, d), CAT(sp, d), prices(sp, d)),
    "j10_share_searches": lambda sp, d: s.share_searches(QRY(sp, d), CAT(sp, d)),
    "r1_catalog_search": lambda sp, d: s.catalog_search(free_queries(sp, d), CAT(sp, d)),
    "b9_parse_search_query": lambda sp, d: free_queries(sp, d).select("query_id", s.parse_query(F.col("text")).alias("p")).select("query_id", F.array_join("p.tokens", "|").alias("tokens"), F.array_join("p.excluded", "|").alias("excluded"), "p.number", "p.set_hint"),
    "b10_clean_first_line": lambda sp, d: view(sp, d, "v_ocr").select("scan_id", s.clean_first_line(F.concat("raw_text", F.lit("\n"))).alias("line"), s.clean_first_line(F.expr("substring_index(raw_text, chr(10), -1)")).alias("last")),
}

J1 = """SELECT query_id, card_id, rank FROM (SELECT q.query_id, c.card_id, row_number() OVER (PARTITION BY q.query_id ORDER BY CASE WHEN lower(c.name) = lower(q.text) THEN 0 ELSE 1 END,
  CASE WHEN q.card_number IS NOT NULL THEN CASE WHEN contains(c.card_number, q.card_number) THEN 0 ELSE 1 END WHEN c.set_total = q.set_total THEN 0 ELSE 1 END, c.card_id DESC)::INT AS rank
  FROM {q} q JOIN {c} c ON q.game = c.game AND q.language = c.language AND contains(lower(c.name), lower(q.text))) WHERE rank <= {k}"""


def j1(q="v_queries", c="v_catalog", k=10):
    return J1.format(q=q, c=c, k=k)


SIM = share_sql("n.g", "c.g")
J2 = f"""SELECT query_id, card_id, round(sim, 6) AS sim, rank FROM (SELECT query_id, card_id, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, card_id)::INT AS rank FROM
  (SELECT n.query_id, c.card_id, {SIM} AS sim FROM n JOIN c ON n.language = c.language) WHERE sim > 0.35) WHERE rank <= 10"""
J2_PARTS = [f"h1 AS ({j1()})", f"n AS (SELECT query_id, language, {trigrams_sql('text')} AS g FROM v_queries WHERE query_id NOT IN (SELECT query_id FROM h1))", f"c AS (SELECT card_id, language, {trigrams_sql('name')} AS g FROM v_catalog)"]
J3 = """SELECT query_id, card_id, rank FROM (SELECT q.query_id, c.card_id, row_number() OVER (PARTITION BY q.query_id ORDER BY CASE WHEN contains(c.card_number, q.card_number) THEN 0 ELSE 1 END, c.card_id DESC)::INT AS rank
  FROM v_queries q JOIN v_catalog c ON q.language = 'ja' AND c.language = 'ja' AND contains(lower(c.name_ja), lower(q.text))) WHERE rank <= 10"""
WORD_SIM = """CASE WHEN len(ta) = 0 OR len(tb) = 0 THEN 0 ELSE list_max(flatten(list_transform(range(1, len(tb) + 1), lambda i: list_transform(range(i, len(tb) + 1), lambda j:
  len(list_intersect(ta, tb[i:j])) / (len(ta) + len(list_distinct(tb[i:j])) - len(list_intersect(ta, tb[i:j]))))))) END"""
ORDERED = r"flatten(list_transform(regexp_extract_all(lower(set_name), '[\p{L}\p{N}]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))"
PARSED = [
    FREE,
    r"w0 AS (SELECT query_id, game, language, text, list_filter(string_split_regex(lower(trim(text)), '\s+'), lambda x: x <> '') AS w FROM v_free)",
    "w1 AS (SELECT *, list_transform(list_filter(w, lambda x: x[1] = '-' AND length(x) > 1), lambda x: x[2:]) AS excluded, list_filter(w, lambda x: x[1] <> '-') AS plain FROM w0)",
    "w2 AS (SELECT *, CASE WHEN regexp_full_match(plain[-1], '[0-9]+') THEN plain[-1] END AS number FROM w1)",
    "w3 AS (SELECT *, CASE WHEN number IS NOT NULL THEN plain[1:len(plain) - 1] ELSE plain END AS tokens FROM w2)",
    "p AS (SELECT query_id, game, language, CASE WHEN len(tokens) > 0 OR number IS NOT NULL THEN tokens END AS tokens, excluded, number, CASE WHEN len(tokens) > 0 THEN array_to_string(tokens, ' ') ELSE lower(trim(text)) END AS name_text, CASE WHEN len(tokens) >= 2 THEN array_to_string(tokens[2:], ' ') END AS set_hint FROM w3)",
]
R1 = f"""SELECT query_id, card_id, score, rank FROM (SELECT query_id, card_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, card_id)::INT AS rank FROM (
  SELECT query_id, card_id, round(greatest(CASE WHEN n >= 2 THEN by_name * f + 0.5 * {WORD_SIM} ELSE by_name END, 0.6 * by_set), 6) AS score FROM x WHERE (by_name > 0.1 OR by_set > 0.2)
  AND (number IS NULL OR card_number = number OR starts_with(card_number, number || '/')) AND len(list_filter(excluded, lambda e: contains(lower(name), e) OR contains(lower(set_name), e))) = 0)) WHERE rank <= 20"""
R1_PARTS = [
    *PARSED,
    f"pt AS (SELECT *, {trigrams_sql('name_text')} AS gq, {trigrams_sql('tokens[1]')} AS gf, {trigrams_sql('set_hint')} AS ta, len(tokens) AS n FROM p WHERE tokens IS NOT NULL)",
    f"ct AS (SELECT *, {trigrams_sql('name')} AS gn, {trigrams_sql('name_ja')} AS gj, {trigrams_sql('set_name')} AS gs, {trigrams_sql(chr(115) + 'plit_part(lower(name), chr(32), 1)')} AS g1, {ORDERED} AS tb FROM v_catalog)",
    f"x AS (SELECT pt.*, ct.card_id, ct.name, ct.set_name, ct.card_number, ct.tb, greatest({share_sql('gn', 'gq')}, CASE WHEN pt.language = 'ja' THEN coalesce({share_sql('gj', 'gq')}, 0) ELSE 0 END) AS by_name, {share_sql('gs', 'gq')} AS by_set, {share_sql('gf', 'g1')} AS f FROM pt JOIN ct ON pt.game = ct.game AND pt.language = ct.language)",
]
TOKENS = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
J6_PARTS = [
    f"d AS (SELECT card_id, language, {TOKENS.format(chr(32).join(['concat_ws(chr(32), name, name_ja, set_name)']))} AS w FROM v_catalog)",
    "st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d)",
    "po AS (SELECT token, language, card_id, dl, count(*) AS tf FROM (SELECT card_id, language, len(w) AS dl, unnest(w) AS token FROM d) GROUP BY ALL)",
    "df AS (SELECT token, count(*) AS df FROM po GROUP BY token)",
    f"qt AS (SELECT query_id, language, len(t) AS need, unnest(t) AS token FROM (SELECT query_id, language, list_distinct({TOKENS.format('text')}) AS t FROM v_queries))",
    "sc AS (SELECT query_id, card_id, need, count(*) AS c, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM qt JOIN po USING (token, language) JOIN df USING (token), st GROUP BY ALL)",
]
SECOND = ["rf AS (SELECT * FROM v_catalog WHERE card_id % 4 <> 0)", "sc2 AS (SELECT card_id + 2000000 AS card_id, game, language, name, set_total, card_id % 17 AS place FROM v_catalog WHERE card_id % 3 <> 1)"]
ORACLES = {
    "j1_name_search": with_views(j1()),
    "j2_fuzzy_search": with_views(J2, *J2_PARTS),
    "j3_ja_name_search": with_views(J3),
    "j4_fallback_source": with_views(
        "SELECT query_id, card_id, rank, 'own' AS origin FROM h1 UNION ALL SELECT e.query_id, e.card_id, (coalesce(hv.last, 0) + e.rank)::INT, 'other' FROM e LEFT JOIN hv USING (query_id)",
        f"h1 AS ({j1()})",
        "hv AS (SELECT h1.query_id, count(*) AS n, coalesce(bool_or(contains(c.card_number, q.card_number)), false) AS numbered, max(h1.rank) AS last FROM h1 JOIN v_catalog c USING (card_id) JOIN v_queries q USING (query_id) GROUP BY h1.query_id)",
        "need AS (SELECT q.* FROM v_queries q LEFT JOIN hv USING (query_id) WHERE q.language = 'en' AND (coalesce(n, 0) < 3 OR (q.card_number IS NOT NULL AND NOT coalesce(numbered, false))))",
        "oc AS (SELECT * REPLACE (card_id + 1000000 AS card_id) FROM v_catalog WHERE card_id % 3 = 0)",
        f"e AS (SELECT * FROM ({j1('need', 'oc')}) WHERE (query_id, card_id) NOT IN (SELECT (query_id, card_id) FROM h1))",
    ),
    "j5_language_fallback": with_views(f"SELECT *, 'own' AS searched FROM h1 UNION ALL SELECT *, 'en' FROM ({j1('ag')})", f"h1 AS ({j1()})", "ag AS (SELECT * REPLACE ('en' AS language) FROM v_queries WHERE language = 'ja' AND query_id NOT IN (SELECT query_id FROM h1))"),
    "j6_tokens_search": with_views("SELECT query_id, card_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, card_id)::INT AS rank FROM sc WHERE c = need) WHERE rank <= 10", *J6_PARTS, "unused AS (SELECT 1 FROM v_queries, v_catalog LIMIT 0)"),
    "j7_tiered_lookup": with_views(
        """SELECT query_id, card_id, tier::INT AS tier FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, card_id DESC) AS r FROM (
      SELECT q.query_id, c.card_id, q.card_number AS qn, q.set_total AS qt, CASE WHEN c.set_total = q.set_total AND ltrim(c.card_number, '0') = ltrim(q.card_number, '0') THEN 0 WHEN c.set_total = q.set_total THEN 1 WHEN ltrim(c.card_number, '0') = ltrim(q.card_number, '0') THEN 2 ELSE 3 END AS tier
      FROM v_queries q JOIN v_catalog c ON q.language = c.language AND q.text = c.name)) WHERE r = 1 AND (tier < 3 OR (qn IS NULL AND qt IS NULL))"""
    ),
    "j7_lookup_second_source": with_views("""SELECT query_id, card_id, tier::INT AS tier FROM (SELECT q.query_id, c.card_id, CASE WHEN c.set_total = q.set_total AND ltrim(c.card_number, '0') = ltrim(q.card_number, '0') THEN 0 WHEN c.set_total = q.set_total THEN 1 WHEN ltrim(c.card_number, '0') = ltrim(q.card_number, '0') THEN 2 ELSE 3 END AS tier
      FROM v_queries q JOIN rf c ON q.language = c.language AND q.text = c.name QUALIFY row_number() OVER (PARTITION BY q.query_id ORDER BY tier, c.card_id DESC) = 1) UNION ALL SELECT query_id, card_id, tier::INT FROM (SELECT q.query_id, c.card_id, CASE WHEN c.set_total = q.set_total THEN 4 ELSE 5 END AS tier
      FROM v_queries q JOIN sc2 c ON q.language = c.language AND q.text = c.name WHERE NOT EXISTS (SELECT 1 FROM rf WHERE rf.language = q.language AND rf.name = q.text) QUALIFY row_number() OVER (PARTITION BY q.query_id ORDER BY tier, CASE WHEN tier = 4 THEN c.place ELSE 0 END, c.card_id DESC) = 1)""", *SECOND),
    "j7_all_of_name": with_views("""SELECT query_id, card_id, row_number() OVER (PARTITION BY query_id ORDER BY card_id DESC)::INT AS rank FROM (SELECT q.query_id, c.card_id FROM v_queries q JOIN rf c ON q.language = c.language AND q.text = c.name
      UNION ALL SELECT q.query_id, c.card_id FROM v_queries q JOIN sc2 c ON q.language = c.language AND q.text = c.name WHERE NOT EXISTS (SELECT 1 FROM rf WHERE rf.language = q.language AND rf.name = q.text))""", *SECOND),
    "j8_attach_metadata": with_views("SELECT query_id, rank, card_id, name, set_code, card_number FROM h1 JOIN v_catalog USING (card_id)", f"h1 AS ({j1()})"),
    "j9_match_certificates": with_views(
        "SELECT q.query_id AS cert_id, q.text AS name, f.card_id, p_retailprice AS price FROM ce q LEFT JOIN f USING (query_id) LEFT JOIN part ON p_partkey = f.card_id",
        "ce AS (SELECT * REPLACE ('en' AS language, NULL::VARCHAR AS card_number, NULL::INT AS set_total) FROM v_queries WHERE query_id % 20 = 0)",
        f"h1 AS ({j1('ce', k=1)})",
        f"n AS (SELECT query_id, language, {trigrams_sql('text')} AS g FROM ce WHERE query_id NOT IN (SELECT query_id FROM h1))",
        f"c AS (SELECT card_id, language, {trigrams_sql('name')} AS g FROM v_catalog)",
        f"f AS (SELECT query_id, card_id FROM h1 UNION ALL SELECT query_id, card_id FROM ({J2}) WHERE rank = 1)",
    ),
    "j10_share_searches": with_views(j1()),
    "r1_catalog_search": with_views(R1, *R1_PARTS, "unused AS (SELECT 1 FROM v_queries, v_catalog LIMIT 0)"),
    "b9_parse_search_query": with_views("SELECT query_id, array_to_string(tokens, '|') AS tokens, array_to_string(excluded, '|') AS excluded, number, set_hint FROM p", *PARSED, "unused AS (SELECT 1 FROM v_queries LIMIT 0)"),
    "b10_clean_first_line": with_views(
        r"""SELECT scan_id, CASE WHEN length(a) >= 2 THEN a END AS line, CASE WHEN length(b) >= 2 THEN b END AS last FROM (SELECT scan_id, trim(regexp_replace(regexp_replace(string_split(raw_text, chr(10))[1], '\d+\s*/\s*\d+', '', 'g'), '\d+\s*$', '')) AS a,
      trim(regexp_replace(regexp_replace(string_split(raw_text, chr(10))[-1], '\d+\s*/\s*\d+', '', 'g'), '\d+\s*$', '')) AS b FROM v_ocr)"""
    ),
}
