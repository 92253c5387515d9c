"""Queries of history, collections and the batch twins of the streams, with their DuckDB texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as h
from ..sources.shared import landing
from ..sources.views import VIEWS, table, view, with_views
from ..streaming import frames as f

VIEWS["v_views"] = """SELECT event_id AS id, user_id AS card_id, event_type AS kind, event_id % 11 = 0 AS refresh, CASE WHEN event_id % 7 = 0 THEN 'shadowless' ELSE 'normal' END AS variant, CASE WHEN value < 1 THEN NULL ELSE value END AS price, event_id % 13 = 0 AS test FROM events"""
VIEWS["v_timings"] = """SELECT l_orderkey * 100000 + l_partkey AS id, l_linenumber * 10 AS start, l_linenumber * 10 + CAST(l_quantity AS INT) AS detected, l_linenumber * 10 + CAST(l_quantity AS INT) * 3 AS read, CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_linenumber * 10 + CAST(l_quantity AS INT) * 4 END AS first, l_linenumber * 10 + CAST(l_quantity AS INT) * 5 AS done FROM lineitem"""
VIEWS["v_collection_all"] = """SELECT o_orderkey AS seq, o_custkey % 50 AS collection_id, o_orderkey % 40 AS card_id, CASE WHEN o_orderkey % 997 = 0 THEN 'delete' WHEN o_orderkey % 1501 = 0 THEN 'remove_all' WHEN o_orderstatus = 'P' THEN 'remove' ELSE 'add' END AS op FROM orders"""
VIEWS["v_collection_names"] = """SELECT o_orderkey AS seq, o_custkey % 50 AS collection_id, CASE WHEN o_orderkey % 97 = 0 THEN 'delete' WHEN o_orderkey % 5 = 0 THEN 'create' ELSE 'rename' END AS op, concat(' List ', o_orderkey, ' ') AS name FROM orders"""
VIEWS["v_collections"] = """SELECT DISTINCT o_custkey % 50 AS collection_id, CASE WHEN o_custkey % 50 % 3 = 0 THEN 'onepiece' ELSE 'pokemon' END AS game FROM orders"""
VIEWS["v_items"] = """SELECT l_orderkey AS request_id, l_linenumber AS idx, l_partkey AS item, CAST(l_suppkey * 37 % 1009 AS INT) AS arrived FROM lineitem"""
NOW = "2024-02-01 00:00:00"
HIST = lambda sp, d: view(sp, d, "v_history")
FRAMES = lambda sp, d: view(sp, d, "v_frames")
KEYED = lambda sp, d: table(sp, d, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"))
text_ts = lambda df: df.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def members(sp, d):
    return h.fold_collection_events(view(sp, d, "v_collection_all"))


def appended(sp, d):
    """The history that three batches of views make, the second of them written twice."""
    path, views = landing(sp, "history"), view(sp, d, "v_views")
    for batch in (0, 1, 1, 2):
        h.append_history(views.filter(F.col("id") % 3 == batch), path, batch)
    return sp.read.schema("id long, card_id long, kind string, price double").parquet(path).select("id", "card_id", "kind", "price")


def folded_in_deltas(sp, d):
    """The collections after two deltas, of which the second comes with the events of the first again, and once more as a whole."""
    events, state = view(sp, d, "v_collection_all"), h.CollectionState(sp, landing(sp, "collections"))
    half = events.agg(F.expr("max(seq) div 2")).first()[0]
    for delta in (events.filter(F.col("seq") <= half), events, events):
        state.advance(delta)
    return state.members()


def cut_id(df):
    """A cursor in the middle of the ids."""
    return df.agg(F.expr("max(id) div 2")).first()[0]


QUERIES = {
    "h1_append_history": lambda sp, d: h.to_append(view(sp, d, "v_views")).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("total")),
    "h1_append_sink": appended,
    "h2_page_before": lambda sp, d: h.page_before(HIST(sp, d), cut_id(HIST(sp, d)), 150).select("id", "card_id", "scan_type"),
    "h2_page_offset": lambda sp, d: h.page_at(HIST(sp, d), 100, 500).select("id", "card_id", "scan_type"),
    "h3_latest_per_card": lambda sp, d: h.latest_per_card(HIST(sp, d)).select("id", "card_id", "scan_type", "price_loose"),
    "h4_next_page_unseen": lambda sp, d: h.next_page_unseen(h.page_before(HIST(sp, d), cut_id(HIST(sp, d)), 200), h.page_at(HIST(sp, d), 0, 40)).select("id", "card_id"),
    "h5_age_bucket": lambda sp, d: HIST(sp, d).select("id", h.age_text(F.col("scanned_at"), F.lit(NOW).cast("timestamp")).alias("age")),
    "h6_fold_collection_events": members,
    "h6_fold_in_deltas": folded_in_deltas,
    "h6_fold_collection_names": lambda sp, d: h.fold_collection_names(view(sp, d, "v_collection_names")),
    "h7_collections_of_cards": lambda sp, d: h.collections_of_cards(members(sp, d), view(sp, d, "v_collections")),
    "h7_collections_view": lambda sp, d: h.collections_view(members(sp, d), view(sp, d, "v_catalog")),
    "h8_session_dedupe": lambda sp, d: h.session_dedupe(FRAMES(sp, d).withColumnRenamed("top_card", "card")),
    "h8_session_newest": lambda sp, d: h.session_newest(FRAMES(sp, d).withColumnRenamed("top_card", "card")),
    "h9_stage_durations": lambda sp, d: h.stage_durations(view(sp, d, "v_timings")),
    "h9_duration_summary": lambda sp, d: h.duration_summary(h.stage_durations(view(sp, d, "v_timings"))),
    "s1_confirm_gate": lambda sp, d: f.confirm_gate(FRAMES(sp, d)).select("session_id", "frame_id", "top_card", "sim"),
    "s2_cooldown": lambda sp, d: f.cooldown(FRAMES(sp, d), 86_400).select("session_id", "top_card", "frame_id"),
    "s4_ordered_emit": lambda sp, d: f.ordered_emit(view(sp, d, "v_items").groupBy("request_id", "idx").agg(F.min("arrived").alias("arrived"))),
    "s5_fixed_window_limit": lambda sp, d: f.fixed_window_limit(KEYED(sp, d), 2, 86_400).select("key", "id", "allowed"),
    "s6_debounce": lambda sp, d: f.debounce(KEYED(sp, d), 3_600_000).select("key", "id"),
    "s7_running_total": lambda sp, d: f.running_total(FRAMES(sp, d).select("session_id", F.when(F.col("top_card").isNotNull(), F.round("sim", 4)).alias("price"))),
    "s8_price_state": lambda sp, d: f.price_state(KEYED(sp, d).withColumn("price", F.when(F.col("id") % 3 != 0, F.col("id") * 0.5)), F.lit("2024-01-31 00:00:00").cast("timestamp"), 240, 100),
}

CUT = "(SELECT max(id) // 2 FROM v_history)"
FOLD = """mb AS (SELECT collection_id, card_id, row_number() OVER (PARTITION BY collection_id ORDER BY s DESC, card_id)::INT AS position FROM (SELECT collection_id, card_id, min(seq) AS s FROM v_collection_all a WHERE op = 'add' AND NOT EXISTS (
  SELECT 1 FROM v_collection_all b WHERE b.seq > a.seq AND ((b.op = 'remove' AND b.collection_id = a.collection_id AND b.card_id = a.card_id) OR (b.op = 'remove_all' AND b.card_id = a.card_id) OR (b.op = 'delete' AND b.collection_id = a.collection_id AND b.collection_id <> 0))) GROUP BY 1, 2))"""
RN = "fr AS (SELECT session_id, top_card, frame_id, ts, row_number() OVER (PARTITION BY session_id, top_card ORDER BY ts, frame_id) AS r FROM v_frames WHERE top_card IS NOT NULL)"
ORACLES = {
    "h1_append_history": with_views("SELECT kind, count(*) AS n, round(sum(price), 2) AS total FROM v_views WHERE NOT refresh AND variant = 'normal' AND price IS NOT NULL AND NOT test GROUP BY kind"),
    "h2_page_before": with_views(f"SELECT id, card_id, scan_type FROM v_history WHERE id < {CUT} ORDER BY id DESC LIMIT 150"),
    "h2_page_offset": with_views("SELECT id, card_id, scan_type FROM v_history ORDER BY scanned_at DESC, id DESC LIMIT 200 OFFSET 100"),
    "h3_latest_per_card": with_views("SELECT id, card_id, scan_type, price_loose FROM v_history WHERE card_id IS NULL UNION ALL SELECT id, card_id, scan_type, price_loose FROM (SELECT * FROM v_history WHERE card_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY card_id ORDER BY scanned_at DESC, id DESC) = 1)"),
    "h4_next_page_unseen": with_views(f"SELECT id, card_id FROM (SELECT * FROM v_history WHERE id < {CUT} ORDER BY id DESC LIMIT 200) p WHERE NOT EXISTS (SELECT 1 FROM (SELECT * FROM v_history ORDER BY scanned_at DESC, id DESC LIMIT 40) s WHERE s.card_id = p.card_id)"),
    "h5_age_bucket": with_views(f"SELECT id, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || 'm ago' WHEN m < 1440 THEN (m // 60) || 'h ago' ELSE (m // 1440) || 'd ago' END AS age FROM (SELECT id, floor((epoch(TIMESTAMP '{NOW}') - floor(epoch(scanned_at))) / 60)::BIGINT AS m FROM v_history)"),
    "h6_fold_collection_events": with_views("SELECT collection_id, card_id, position FROM mb", "u0 AS (SELECT 1 FROM v_collection_all LIMIT 0)", FOLD),
    "h6_fold_in_deltas": with_views("SELECT collection_id, card_id, position FROM mb", "u0 AS (SELECT 1 FROM v_collection_all LIMIT 0)", FOLD),
    "h1_append_sink": with_views("SELECT id, card_id, kind, price FROM v_views WHERE NOT refresh AND variant = 'normal' AND price IS NOT NULL AND NOT test"),
    "h6_fold_collection_names": with_views("""SELECT collection_id, coalesce((SELECT arg_max(trim(r.name), r.seq) FROM v_collection_names r WHERE r.collection_id = m.collection_id AND r.op = 'rename' AND r.seq > m.seq AND m.collection_id <> 0), m.name) AS name FROM (SELECT collection_id, min(seq) AS seq, arg_min(name, seq) AS name FROM v_collection_names c
      WHERE op = 'create' AND NOT EXISTS (SELECT 1 FROM v_collection_names x WHERE x.collection_id = c.collection_id AND x.op = 'delete' AND x.seq > c.seq AND x.collection_id <> 0) GROUP BY collection_id) m"""),
    "h7_collections_of_cards": with_views("SELECT card_id, game, string_agg(collection_id::VARCHAR, ',' ORDER BY collection_id) AS collections FROM mb JOIN v_collections USING (collection_id) GROUP BY card_id, game", "u0 AS (SELECT 1 FROM v_collection_all LIMIT 0)", FOLD),
    "h7_collections_view": with_views("SELECT collection_id, count(*) AS cards, array_to_string(list(name ORDER BY position)[1:4], '|') AS previews FROM mb JOIN v_catalog USING (card_id) GROUP BY collection_id", FOLD),
    "h8_session_dedupe": with_views("SELECT session_id, count(DISTINCT top_card) AS kept, count(top_card) - count(DISTINCT top_card) AS removed FROM v_frames GROUP BY session_id"),
    "h8_session_newest": with_views("SELECT session_id, top_card AS card, frame_id FROM v_frames WHERE top_card IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id, top_card ORDER BY ts DESC, frame_id DESC) = 1"),
    "h9_stage_durations": with_views("SELECT id, detected - start AS detect_ms, read - detected AS read_ms, coalesce(first, done) - start AS first_ms, done - start AS total_ms FROM v_timings"),
    "h9_duration_summary": with_views("SELECT count(*) AS scans, round(avg(detected - start), 3) AS mean_detect_ms, round(avg(read - detected), 3) AS mean_read_ms, round(avg(coalesce(first, done) - start), 3) AS mean_first_ms, round(avg(done - start), 3) AS mean_total_ms, quantile_cont(done - start, 0.5)::DOUBLE AS median_total FROM v_timings"),
    "s1_confirm_gate": with_views("""SELECT session_id, frame_id, top_card, sim FROM (SELECT *, arg_max(CASE WHEN top_card IS NULL THEN '' ELSE top_card END, n) FILTER (top_card IS NULL OR sim < 0.7) OVER (PARTITION BY session_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pending
      FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, frame_id) AS n FROM v_frames)) WHERE top_card IS NOT NULL AND (sim >= 0.7 OR pending = top_card)"""),
    "s2_cooldown": with_views("SELECT session_id, top_card, frame_id FROM rc WHERE kept", RN, """rc AS (SELECT session_id, top_card, frame_id, r, ts AS last, true AS kept FROM fr WHERE r = 1 UNION ALL SELECT fr.session_id, fr.top_card, fr.frame_id, fr.r, CASE WHEN epoch_us(fr.ts) - epoch_us(rc.last) >= 86400000000 THEN fr.ts ELSE rc.last END,
      epoch_us(fr.ts) - epoch_us(rc.last) >= 86400000000 FROM rc JOIN fr ON fr.session_id = rc.session_id AND fr.top_card = rc.top_card AND fr.r = rc.r + 1)""", "u0 AS (SELECT 1 FROM v_frames LIMIT 0)").replace("WITH ", "WITH RECURSIVE ", 1),
    "s4_ordered_emit": with_views("SELECT request_id, idx, arrived, max(arrived) OVER (PARTITION BY request_id ORDER BY idx) AS emitted FROM (SELECT request_id, idx, min(arrived) AS arrived FROM v_items GROUP BY 1, 2)"),
    "s5_fixed_window_limit": """WITH RECURSIVE ev AS (SELECT user_id AS key, event_id AS id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
      rc AS (SELECT key, id, r, ts AS open, 1 AS n FROM ev WHERE r = 1 UNION ALL SELECT ev.key, ev.id, ev.r, CASE WHEN epoch_us(ev.ts) - epoch_us(rc.open) >= 86400000000 THEN ev.ts ELSE rc.open END, CASE WHEN epoch_us(ev.ts) - epoch_us(rc.open) >= 86400000000 THEN 1 ELSE rc.n + 1 END FROM rc JOIN ev ON ev.key = rc.key AND ev.r = rc.r + 1)
      SELECT key, id, n <= 2 AS allowed FROM rc""",
    "s6_debounce": "SELECT key, id FROM (SELECT user_id AS key, event_id AS id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events) WHERE nx IS NULL OR epoch_us(nx) - epoch_us(ts) > 3600000000",
    "s7_running_total": with_views("SELECT session_id, round(sum(CASE WHEN top_card IS NOT NULL THEN round(sim, 4) END), 2) AS value, count(top_card) AS priced FROM v_frames GROUP BY session_id"),
    "s8_price_state": "SELECT key, price, CASE WHEN price IS NULL THEN 'missing' ELSE 'fresh' END AS state FROM (SELECT user_id AS key, CASE WHEN event_id % 3 <> 0 THEN event_id * 0.5::DOUBLE END AS price, epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(ts)) AS age FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) WHERE age < CASE WHEN price IS NULL THEN 360000 ELSE 864000 END",
}
