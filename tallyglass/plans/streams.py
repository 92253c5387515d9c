"""The stream operators over replayed tables, checked by the DuckDB texts of their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import replay as r
from ..sources.views import view, with_views
from ..streaming import frames as f
from .history import FRAMES, KEYED
from .history import ORACLES as TWINS

#: Micro-batches of a replay; state is kept and rows are awaited for longer than the tables last.
SLICES, LONG, LONG_MS = 3, "400 days", 400 * 86_400_000


def timed(df):
    return r.by_time(df.withColumn("ts", F.col("ts").cast("timestamp")), "ts", SLICES)


def gate(sp, d):
    out, _ = r.replay(timed(FRAMES(sp, d)), SLICES, lambda s: f.stream_confirm_gate(s, delay=LONG, idle_ms=LONG_MS))
    return out.select("session_id", "frame_id", "top_card", "sim")


def cooldown(sp, d):
    out, _ = r.replay(timed(FRAMES(sp, d)), SLICES, lambda s: f.stream_cooldown(s, 86_400, LONG, LONG_MS))
    return out.select("session_id", "top_card", "frame_id")


def limit(sp, d):
    out, _ = r.replay(timed(KEYED(sp, d)), SLICES, lambda s: f.stream_limit(s, 2, 86_400, LONG, LONG_MS))
    return out.select("key", "id", "allowed")


def totals(sp, d):
    items = FRAMES(sp, d).select("session_id", "ts", F.when(F.col("top_card").isNotNull(), F.round("sim", 4)).alias("price"))
    out, _ = r.replay(timed(items), SLICES, lambda s: f.stream_running_total(s, LONG, LONG_MS), "update")
    return r.latest(out, "session_id").select("session_id", "value", "priced")


def debounced(sp, d):
    """The last event before each quiet hour; an event of another key, long after, moves the watermark past all of them."""
    events = KEYED(sp, d).withColumn("ts", F.col("ts").cast("timestamp"))
    end = events.agg(F.lit(None).cast("long").alias("key"), (F.max("ts") + F.expr("interval 2 days")).alias("ts"), F.lit(None).cast("long").alias("id"))
    rows = r.by_time(events, "ts", SLICES - 1).unionByName(end.withColumn("slice", F.lit(SLICES - 1)))
    out, _ = r.replay(rows, SLICES, lambda s: f.stream_debounce(s, 3_600_000))
    return out.filter("key IS NOT NULL").select("key", "id")


def prices(sp, d):
    """Each key's last price and whether it is a miss; none expires while the table lasts."""
    updates = KEYED(sp, d).withColumn("price", F.when(F.col("id") % 3 != 0, F.col("id") * 0.5))
    out, _ = r.replay(timed(updates), SLICES, lambda s: f.stream_price_state(s, 24 * 400, 24 * 400, LONG), "update")
    return r.latest(out, "key").select("key", "price", "state")


def ordered(sp, d):
    """Items of a request in three waves by their arrival; an item is out in the wave in which all before it have come."""
    i = view(sp, d, "v_items").groupBy("request_id", "idx").agg(F.min("arrived").alias("arrived"))
    wave = F.least(F.floor(F.col("arrived") / 337), F.lit(SLICES - 1)).cast("int")
    rows = i.select("request_id", (F.col("idx") - 1).cast("long").alias("idx"), F.col("idx").cast("string").alias("item"), F.timestamp_seconds(F.col("arrived") + 86_400).alias("ts"), wave.alias("slice"))
    out, _ = r.replay(rows, SLICES, lambda s: f.stream_ordered_emit(s, LONG, LONG_MS))
    return out.select("request_id", "idx", "item", F.col("batch").cast("int").alias("batch"))


def late_frames(sp, d):
    """Every tenth frame comes a slice too late; how many of these each session's gate dropped."""
    t = timed(FRAMES(sp, d))
    late = t.withColumn("slice", F.when(F.col("frame_id") % 10 == 0, F.least(F.col("slice") + 1, F.lit(SLICES - 1))).otherwise(F.col("slice")))
    _, state = r.replay(late, SLICES, lambda s: f.stream_confirm_gate(s, delay=LONG, idle_ms=LONG_MS))
    return r.counted_late(sp, state, "session_id").filter("late > 0")


QUERIES = {
    "s1_confirm_gate_stream": gate,
    "s1_late_frames": late_frames,
    "s2_cooldown_stream": cooldown,
    "s4_ordered_emit_stream": ordered,
    "s5_fixed_window_limit_stream": limit,
    "s6_debounce_stream": debounced,
    "s7_running_total_stream": totals,
    "s8_price_state_stream": prices,
}

ORACLES = {
    "s1_confirm_gate_stream": TWINS["s1_confirm_gate"],
    "s2_cooldown_stream": TWINS["s2_cooldown"],
    "s5_fixed_window_limit_stream": TWINS["s5_fixed_window_limit"],
    "s6_debounce_stream": TWINS["s6_debounce"],
    "s7_running_total_stream": TWINS["s7_running_total"],
    "s8_price_state_stream": """SELECT user_id AS key, CASE WHEN event_id % 3 <> 0 THEN event_id * 0.5::DOUBLE END AS price, CASE WHEN event_id % 3 <> 0 THEN 'fresh' ELSE 'missing' END AS state
      FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "s4_ordered_emit_stream": with_views(f"""SELECT request_id, (idx - 1)::BIGINT AS idx, idx::VARCHAR AS item, max(least(arrived // 337, {SLICES - 1})) OVER (PARTITION BY request_id ORDER BY idx)::INT AS batch
      FROM (SELECT request_id, idx, min(arrived) AS arrived FROM v_items GROUP BY 1, 2) QUALIFY idx = row_number() OVER (PARTITION BY request_id ORDER BY idx)"""),
    "s1_late_frames": with_views(f"""SELECT session_id, count(*) AS late FROM (SELECT session_id, ts, came, max(ts) FILTER (came = 0) OVER w AS m0, max(ts) FILTER (came <= 1) OVER w AS m1 FROM (
      SELECT *, CASE WHEN frame_id % 10 = 0 THEN least(own + 1, {SLICES - 1}) ELSE own END AS came FROM (SELECT *, (epoch_us(ts) - min(epoch_us(ts)) OVER ()) * {SLICES} // (max(epoch_us(ts)) OVER () - min(epoch_us(ts)) OVER () + 1) AS own FROM v_frames)) WINDOW w AS (PARTITION BY session_id))
      WHERE (came = 1 AND ts < m0) OR (came = 2 AND ts < m1) GROUP BY session_id"""),
}
