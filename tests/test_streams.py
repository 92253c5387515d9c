import tempfile

import pytest
from pyspark.sql import functions as F

from tallyglass.plans.history import FRAMES, KEYED
from tallyglass.streaming import frames as f


def run(spark, table, parts, build, order="ts", mode="append", keep=None):
    """Write the table as files in time order and read them back as a stream, one file a batch."""
    folder, schema = tempfile.mkdtemp(prefix="spark-stream-"), table.schema
    rows = table.orderBy(order).collect()
    step = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * step : (k + 1) * step], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    name = f"t{abs(hash(folder))}"
    q = build(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    if keep is not None:
        keep.append(f"{folder}/cp")
    return spark.table(name)


def states(spark, checkpoint, name="state"):
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load().count()


@pytest.mark.parametrize("parts", [1, 3])
def test_gate(spark, sf, parts):
    t = FRAMES(spark, sf).filter("session_id < 8").withColumn("ts", F.col("ts").cast("timestamp"))
    want = {r.frame_id for r in f.confirm_gate(t).collect()}
    got = run(spark, t, parts, lambda s: f.stream_confirm_gate(s, idle_ms=400 * 86_400_000))
    assert {r.frame_id for r in got.collect()} == want and want


def test_cooldown_and_limit(spark, sf):
    t = FRAMES(spark, sf).filter("session_id < 8").withColumn("ts", F.col("ts").cast("timestamp"))
    want = {r.frame_id for r in f.cooldown(t, 86_400).collect()}
    assert {r.frame_id for r in run(spark, t, 2, lambda s: f.stream_cooldown(s, 86_400, idle_ms=400 * 86_400_000)).collect()} == want
    e = KEYED(spark, sf).filter("key < 8").withColumn("ts", F.col("ts").cast("timestamp"))
    want = {(r.id, r.allowed) for r in f.fixed_window_limit(e, 2, 86_400).collect()}
    assert {(r.id, r.allowed) for r in run(spark, e, 2, lambda s: f.stream_limit(s, 2, 86_400, idle_ms=400 * 86_400_000)).collect()} == want


def test_ordered(spark):
    t = spark.createDataFrame([(1, 2, "c", 1), (1, 0, "a", 2), (1, 1, "b", 3), (2, 1, "y", 1)], "request_id long, idx long, item string, ts int")
    got = run(spark, t, 2, lambda s: f.stream_ordered_emit(s.withColumn("ts", F.timestamp_seconds("ts"))))
    assert sorted((r.request_id, r.idx, r.item) for r in got.collect()) == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c")]


def test_repeated_and_late_indexes_wait_for_nothing(spark):
    rows = [(1, 0, "a", 1), (1, 1, "b", 2), (1, 0, "again", 3), (1, 3, "d", 4), (1, 2, "c", 5), (1, 1, "again", 6)]
    t, kept = spark.createDataFrame(rows, "request_id long, idx long, item string, ts int"), []
    got = run(spark, t, 3, lambda s: f.stream_ordered_emit(s.withColumn("ts", F.timestamp_seconds("ts"))), keep=kept)
    assert [(r.idx, r.item) for r in sorted(got.collect(), key=lambda r: r.idx)] == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]
    assert states(spark, kept[0], "held") == 0


@pytest.mark.parametrize("parts", [1, 4])
def test_debounce(spark, parts):
    rows = [(k, s * 7.5 + k, 100 * k + n) for k in range(3) for n, s in enumerate((0, 1, 1.2, 9, 9.1, 9.2, 30))] + [(9, 1e6, 999)]
    t = spark.createDataFrame(rows, "key long, s double, id long").select("key", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("ts"), "id")
    want = {r.id for r in f.debounce(t, 2000).collect()} - {999}
    # the last event alone is what moves the watermark past the others
    assert {r.id for r in run(spark, t, parts, lambda s: f.stream_debounce(s, 2000)).collect()} == want


@pytest.mark.parametrize("parts", [1, 3])
def test_running_total(spark, sf, parts):
    t = FRAMES(spark, sf).filter("session_id < 8").select("session_id", F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("top_card").isNotNull(), F.round("sim", 4)).alias("price"))
    want = {(r.session_id, r.value, r.priced) for r in f.running_total(t).collect()}
    last = {}
    for r in run(spark, t, parts, lambda s: f.stream_running_total(s, "400 days", 400 * 86_400_000), mode="update").collect():
        if r.priced >= last.get(r.session_id, (None, -1))[1]:
            last[r.session_id] = r.value, r.priced
    assert {(k, v, n) for k, (v, n) in last.items()} == want


@pytest.mark.parametrize("parts", [1, 4])
def test_prices_expire(spark, parts):
    rows = [(1, 0, 1, 5.0), (1, 100, 2, 6.0), (2, 50, 3, None), (3, 60, 4, 7.0), (3, 90_000, 5, 8.0), (4, 1_000, 6, None), (4, 1_100, 7, 2.5), (5, 100_000, 8, None), (6, 110_000, 9, 1.0)]
    t = spark.createDataFrame(rows, "key long, s long, id long, price double").select("key", F.timestamp_seconds("s").alias("ts"), "id", "price")
    last, kept = {}, []
    for r in run(spark, t, parts, lambda s: f.stream_price_state(s, delay="1 second"), mode="update", keep=kept).collect():
        if (r.ts, r.state == "expired") >= last.get(r.key, (r.ts, False))[:2]:
            last[r.key] = (r.ts, r.state == "expired", r.price, r.state)
    want = {(r.key, r.price, r.state) for r in f.price_state(t, F.timestamp_seconds(F.lit(110_000 - 1))).collect()}
    assert {(k, x[2], x[3]) for k, x in last.items() if x[3] != "expired"} == want and {1, 2, 4, 5} == {k for k, x in last.items() if x[3] == "expired"}
    assert states(spark, kept[0]) == len(want)


def test_idle_state_goes(spark):
    day = 86_400
    rows = [(s, 10 * s + k, s * 100 + 10 * k, "c", 0.5) for s in range(5) for k in range(3)] + [(99, 999, 3 * day, "c", 0.5)]
    t = spark.createDataFrame(rows, "session_id long, frame_id long, s long, top_card string, sim double").select("session_id", "frame_id", F.timestamp_seconds("s").alias("ts"), "top_card", "sim")
    e = t.select(F.col("session_id").alias("key"), "ts", F.col("frame_id").alias("id"))
    for table, build in ((t, f.stream_confirm_gate), (t, f.stream_cooldown), (e, lambda s: f.stream_limit(s, 2, 60)), (t.withColumn("price", F.col("sim")), f.stream_running_total)):
        kept = []
        run(spark, table, 4, build, mode="update" if build is f.stream_running_total else "append", keep=kept)
        assert states(spark, kept[0]) == 1


def test_identify_batches_equal_one_run(spark, sf):
    from tallyglass.operators import search
    from tallyglass.plans.search import CAT, QRY

    q, found = QRY(spark, sf), []
    catalog = CAT(spark, sf)
    folder = tempfile.mkdtemp(prefix="spark-stream-")
    q.repartition(2).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(q.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    w = f.stream_identify(stream, lambda df: search.name_search(df, catalog), lambda df, n: found.extend(df.collect())).option("checkpointLocation", f"{folder}/cp").start()
    w.processAllAvailable()
    w.stop()
    assert sorted(map(tuple, found)) == sorted(map(tuple, search.name_search(q, catalog).collect()))


def test_stream_identifies_as_the_batch_does(spark, sf):
    from tallyglass import registry

    queries = registry.queries()
    key = lambda r: r.query_id
    batch, stream = (sorted(queries[n](spark, sf).collect(), key=key) for n in ("r8_identify", "s3_stream_identify_full"))
    assert stream == batch and {"image", "both"} & {r.source for r in stream}


def test_calls_to_the_state_do_not_grow_with_keys(spark, monkeypatch):
    """Two micro-batches of 600 keys in 4 buckets: states are read and written once a bucket, and results equal the twin's."""
    calls, key = spark.sparkContext.accumulator(0), F.col("id") % 600
    t = spark.range(2400).select(key.alias("session_id"), F.col("id").alias("frame_id"), F.timestamp_seconds(F.col("id") * 7 + 86_400).alias("ts"), F.lit("c").alias("top_card"))
    monkeypatch.setattr(f, "BUCKETS", 4)

    class Counted(f._Cooldown):
        def load(self):
            calls.add(1)
            return super().load()

    monkeypatch.setattr(f, "_Cooldown", Counted)
    got = run(spark, t, 2, lambda s: f.stream_cooldown(s, 5000, idle_ms=400 * 86_400_000))
    assert {r.frame_id for r in got.collect()} == {r.frame_id for r in f.cooldown(t, 5000).collect()} and 0 < calls.value <= 8


def test_ordered_emit_takes_every_request(spark, sf):
    """Every request is in the result, up to the first index that its items lack."""
    from tallyglass.plans.streams import QUERIES

    have = {}
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber").distinct().collect():
        have.setdefault(r.l_orderkey, set()).add(r.l_linenumber - 1)
    want = {(k, n) for k, own in have.items() for n in range(len(own)) if all(i in own for i in range(n + 1))}
    assert {(r.request_id, r.idx) for r in QUERIES["s4_ordered_emit_stream"](spark, sf).collect()} == want
