"""Frame streams: confirmation gate, cooldown, ordered emission, limiter, debounce, running totals and expiring prices.

Each has a batch twin over a table, which tests hold against the stream under different micro-batch splits. The stateful operators
sort the rows of a micro-batch by (event time, id). A row older than the last one of its key is late and dropped, and counted in the
key's state by gate, cooldown and limiter; rows behind the watermark are dropped by Spark. State goes when a timer in event time finds its
key idle for long enough; a key that comes back begins anew.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

# ---------------------------------------------------------------- batch twins


def confirm_gate(frames: DataFrame, high: float = 0.70) -> DataFrame:
    """Frames whose card is the pending one or sure (``sim >= high``). An unsure card becomes pending, a sure one leaves it, an empty frame clears it."""
    w = Window.partitionBy("session_id").orderBy("ts", "frame_id").rowsBetween(Window.unboundedPreceding, -1)
    sets = F.when(F.col("top_card").isNull() | (F.col("sim") < high), F.struct("top_card"))
    return frames.withColumn("pending", F.last(sets, ignorenulls=True).over(w)["top_card"]).filter(F.col("top_card").isNotNull() & ((F.col("sim") >= high) | (F.col("pending") == F.col("top_card")))).drop("pending")


def _in_order(df: DataFrame, keys: list[str], order: list[str], schema: str, step) -> DataFrame:
    """``df``, of key columns, order columns and no others, through ``step(state, row) -> (state, row out or None)`` key by key in order.

    Rows stream through the task of their key: memory holds one batch and one state, whatever the key's size.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = state = None
        for b in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[: len(keys)] != key:
                    key, state = row[: len(keys)], None
                state, made = step(state, row)
                if made is not None:
                    out.append(made)
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=pa.schema([(n, ARROW[x.split()[1]]) for n, x in zip(names, schema.split(", "), strict=True)]))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


ARROW = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def cooldown(frames: DataFrame, seconds: int = 30) -> DataFrame:
    """``session_id, top_card, ts, frame_id`` of frames at least ``seconds`` after the last one emitted of the same session and card."""

    def step(last, row):
        session, card, us, frame = row
        return (us, row) if last is None or us - last >= seconds * 1_000_000 else (last, None)

    f = frames.filter("top_card IS NOT NULL").select(F.col("session_id").cast("long").alias("session_id"), "top_card", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("frame_id").cast("long").alias("frame_id"))
    kept = _in_order(f, ["session_id", "top_card"], ["us", "frame_id"], "session_id long, top_card string, us long, frame_id long", step)
    return kept.select("session_id", "top_card", F.timestamp_micros("us").alias("ts"), "frame_id")


def fixed_window_limit(events: DataFrame, n: int, seconds: int) -> DataFrame:
    """``key, ts, id, allowed``: the first event of a key opens a window of ``seconds``; its first n events are allowed; the next event after it opens another."""

    def step(state, row):
        key, us, at = row
        opened, count = state if state is not None and us - state[0] < seconds * 1_000_000 else (us, 0)
        return (opened, count + 1), (key, us, at, count < n)

    e = events.select(F.col("key").cast("long").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("id").cast("long").alias("id"))
    return _in_order(e, ["key"], ["us", "id"], "key long, us long, id long, allowed boolean", step).select("key", F.timestamp_micros("us").alias("ts"), "id", "allowed")


def ordered_emit(items: DataFrame) -> DataFrame:
    """``request_id, idx, arrived, emitted``: an item is out when it and all of smaller index have arrived."""
    w = Window.partitionBy("request_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("emitted", F.max("arrived").over(w))


def debounce(events: DataFrame, gap_ms: int = 400) -> DataFrame:
    """``key, ts, id`` of events that nothing of their key follows within the gap."""
    w = Window.partitionBy("key").orderBy("ts", "id")
    nxt = F.lead("ts").over(w)
    quiet = nxt.isNull() | (F.unix_micros(nxt.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")) > gap_ms * 1000)
    return events.withColumn("quiet", quiet).filter("quiet").drop("quiet")


def running_total(items: DataFrame) -> DataFrame:
    return items.groupBy("session_id").agg(F.round(F.sum("price"), 2).alias("value"), F.count("price").alias("priced"))


def price_state(updates: DataFrame, now, hours: int = 24, missing_hours: int = 1) -> DataFrame:
    """``key, price, state``: the latest update of each key, if it has not expired (a miss, a null price, sooner)."""
    last = updates.groupBy("key").agg(F.max_by(F.struct("ts", "price"), F.struct("ts", "id")).alias("u"))
    age = F.unix_timestamp(now) - F.unix_timestamp(F.col("u.ts").cast("timestamp"))
    life = F.when(F.col("u.price").isNull(), missing_hours * 3600).otherwise(hours * 3600)
    return last.filter(age < life).select("key", "u.price", F.when(F.col("u.price").isNull(), "missing").otherwise("fresh").alias("state"))


# ---------------------------------------------------------------- streams

#: How late an event may be, and how long after its last event a key's state is kept; both in event time.
DELAY, IDLE_MS = "10 minutes", 6 * 3_600_000
#: Keys are dealt by hash into so many buckets; the stateful operators read and write the states of a bucket's keys together.
BUCKETS = 2048
TYPES = {"top_card": "string", "item": "string", "sim": "double", "price": "double"}


def _fields(*columns: str) -> StructType:
    kinds = {"string": StringType(), "double": DoubleType()}
    return StructType([StructField(c, kinds.get(TYPES.get(c), LongType())) for c in columns])


def _store(state, rows: list[tuple]) -> None:
    if rows:
        state.put(rows)
    else:
        state.clear()


class _Expiring(StatefulProcessor):
    """States of a bucket's keys, each with the number of its late rows. One that had no event for ``idle_ms`` of event time goes.

    A call to the state costs far more than a state's bytes, so a micro-batch makes a few calls for each bucket and none for each key. The bucket's
    timer stands at the first time at which a state goes. The last of a state's ``values`` is the time of its key's last event, in microseconds.
    """

    keys, order, values, columns = ["session_id"], ["us"], ["seen"], []

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getListState("state", _fields(*self.keys, "late", *self.values))

    def step(self, key: tuple, rows: list[Row], state: tuple | None) -> tuple[tuple, int, list[tuple]]:
        """(the key's new state, the number of late rows, rows out) of its rows in order."""
        raise NotImplementedError

    def expires(self, state: tuple) -> int:
        return state[-1] // 1000 + self.idle_ms

    def end(self, key: tuple, state: tuple) -> list[tuple]:
        """Rows out when a key's state goes."""
        return []

    def load(self) -> dict[tuple, tuple]:
        n = len(self.keys)
        return {tuple(r[:n]): (r[n], tuple(r[n + 1 :])) for r in self.state.get()}

    def save(self, states: dict[tuple, tuple]) -> None:
        _store(self.state, [(*k, late, *state) for k, (late, state) in states.items()])

    def due(self, states: dict[tuple, tuple]) -> int | None:
        return min((self.expires(state) for _, state in states.values()), default=None)

    def made(self, out: list[tuple]) -> Iterator[Row]:
        return (Row(**dict(zip(self.columns, r, strict=True))) for r in out)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        own, out, states = defaultdict(list), [], self.load()
        for row in rows:
            own[tuple(row[k] for k in self.keys)].append(row)
        before = self.due(states)
        for k, some in own.items():
            late, state = states.get(k, (0, None))
            state, more, made = self.step(k, sorted(some, key=lambda r: [(r[c] is None, r[c]) for c in self.order]), state)
            states[k] = (late + more, state)
            out += made
        self.save(states)
        after = self.due(states)
        if after != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(after)
        return self.made(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now, out, states = timerValues.getCurrentWatermarkInMs(), [], self.load()
        for k, (_, state) in list(states.items()):
            if self.expires(state) <= now:
                out += self.end(k, state)
                del states[k]
        self.save(states)
        if states:
            self.handle.registerTimer(self.due(states))
        return self.made(out)

    def close(self) -> None:
        pass


def _run(events: DataFrame, columns: list[str], processor: _Expiring, schema: str, mode: str, delay: str) -> DataFrame:
    """The processor over the keys' buckets; ``us`` among its columns is the time in microseconds."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    bucket = F.pmod(F.xxhash64(*processor.keys), F.lit(BUCKETS)).cast("int")
    typed = [F.col(c).cast(TYPES.get(c, "long")).alias(c) for c in (*processor.keys, *columns)]
    dealt = timed.select(bucket.alias("bucket"), *typed, "ts", F.unix_micros("ts").alias("us"))
    out = dealt.groupBy("bucket").transformWithState(processor, schema, mode, "EventTime")
    return out.select(*(F.timestamp_micros("us").alias("ts") if c == "us" else c for c in processor.columns))


class _Gate(_Expiring):
    order, values, columns = ["us", "frame_id"], ["top_card", "seen"], ["session_id", "frame_id", "us", "top_card", "sim"]

    def __init__(self, high: float, idle_ms: int):
        super().__init__(idle_ms)
        self.high = high

    def step(self, key: tuple, rows: list[Row], state: tuple | None) -> tuple[tuple, int, list[tuple]]:
        (card, seen), late, out = state or (None, None), 0, []
        for row in rows:
            if seen is not None and row.us < seen:
                late += 1
                continue
            seen = row.us
            if row.top_card is None:
                card = None
            else:
                sure = row.sim is not None and not row.sim < self.high  # Spark holds NaN for greater than any number
                if sure or card == row.top_card:
                    out.append((*key, row.frame_id, row.us, row.top_card, row.sim))
                if row.sim is not None and not sure:
                    card = row.top_card
        return (card, seen), late, out


def stream_confirm_gate(frames: DataFrame, high: float = 0.70, delay: str = DELAY, idle_ms: int = IDLE_MS) -> DataFrame:
    """``frames(session_id, frame_id, ts, top_card, sim)``, a stream; emits in append mode."""
    return _run(frames, ["frame_id", "top_card", "sim"], _Gate(high, idle_ms), "session_id long, frame_id long, us long, top_card string, sim double", "Append", delay)


class _Cooldown(_Expiring):
    keys, order, values, columns = ["session_id", "top_card"], ["us", "frame_id"], ["us", "seen"], ["session_id", "top_card", "us", "frame_id"]

    def __init__(self, seconds: int, idle_ms: int):
        super().__init__(idle_ms)
        self.gap = seconds * 1_000_000

    def step(self, key: tuple, rows: list[Row], state: tuple | None) -> tuple[tuple, int, list[tuple]]:
        (last, seen), late, out = state or (None, None), 0, []
        for row in rows:
            if seen is not None and row.us < seen:
                late += 1
                continue
            seen = row.us
            if last is None or row.us - last >= self.gap:
                last = row.us
                out.append((*key, row.us, row.frame_id))
        # what came more than the gap ago silences nothing
        return (last, seen), late, out


def stream_cooldown(frames: DataFrame, seconds: int = 30, delay: str = DELAY, idle_ms: int = IDLE_MS) -> DataFrame:
    """State outlives the cooldown, however short ``idle_ms`` is."""
    f = frames.filter("top_card IS NOT NULL")
    return _run(f, ["frame_id"], _Cooldown(seconds, max(idle_ms, seconds * 1000)), "session_id long, top_card string, us long, frame_id long", "Append", delay)


class _Limit(_Expiring):
    keys, order, values, columns = ["key"], ["us", "id"], ["us", "n", "seen"], ["key", "us", "id", "allowed"]

    def __init__(self, n: int, seconds: int, idle_ms: int):
        super().__init__(idle_ms)
        self.n, self.gap = n, seconds * 1_000_000

    def step(self, key: tuple, rows: list[Row], state: tuple | None) -> tuple[tuple, int, list[tuple]]:
        (at, n, seen), late, out = state or (None, 0, None), 0, []
        for row in rows:
            if seen is not None and row.us < seen:
                late += 1
                continue
            seen = row.us
            if at is None or row.us - at >= self.gap:
                at, n = row.us, 0
            n += 1
            out.append((*key, row.us, row.id, n <= self.n))
        return (at, n, seen), late, out


def stream_limit(events: DataFrame, n: int, seconds: int, delay: str = DELAY, idle_ms: int = IDLE_MS) -> DataFrame:
    return _run(events, ["id"], _Limit(n, seconds, max(idle_ms, seconds * 1000)), "key long, us long, id long, allowed boolean", "Append", delay)


class _Ordered(_Expiring):
    keys, order, values, columns = ["request_id"], ["idx", "us"], ["idx", "waiting", "seen"], ["request_id", "idx", "item"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.held = handle.getListState("held", _fields("request_id", "idx", "item"))

    def load(self) -> dict[tuple, tuple]:
        states, self.waiting = super().load(), defaultdict(dict)
        self.any_held = any(state[1] for _, state in states.values())
        for request, idx, item in self.held.get() if self.any_held else ():
            self.waiting[(request,)][idx] = item
        return states

    def save(self, states: dict[tuple, tuple]) -> None:
        super().save(states)
        held = [(*k, idx, item) for k in states for idx, item in self.waiting[k].items()]
        if held or self.any_held:
            _store(self.held, held)

    def step(self, key: tuple, rows: list[Row], state: tuple | None) -> tuple[tuple, int, list[tuple]]:
        (at, _, seen), late, out, waiting = state or (0, 0, None), 0, [], self.waiting[key]
        for row in rows:
            seen = row.us if seen is None else max(seen, row.us)
            if row.idx < at:
                late += 1  # out already
            else:
                waiting.setdefault(row.idx, row.item)
        while at in waiting:
            out.append((*key, at, waiting.pop(at)))
            at += 1
        return (at, len(waiting), seen), late, out


def stream_ordered_emit(items: DataFrame, delay: str = DELAY, idle_ms: int = IDLE_MS) -> DataFrame:
    """``items(request_id, idx, item, ts)``, indexes from 0; an item waits in state for those before it, and one whose index has come is dropped. A bucket's waiting items sit in one task's memory."""
    return _run(items, ["idx", "item"], _Ordered(idle_ms), "request_id long, idx long, item string", "Append", delay)


class _Total(_Expiring):
    values, columns = ["price", "priced", "seen"], ["session_id", "value", "priced"]

    def step(self, key: tuple, rows: list[Row], state: tuple | None) -> tuple[tuple, int, list[tuple]]:
        value, priced, seen = state or (0.0, 0, rows[0].us)
        prices = [r.price for r in rows if r.price is not None]
        value, priced = sum(prices, value), priced + len(prices)
        return (value, priced, max(seen, rows[-1].us)), 0, [(*key, round(value, 2) if priced else None, priced)]


def stream_running_total(items: DataFrame, delay: str = DELAY, idle_ms: int = IDLE_MS) -> DataFrame:
    """``items(session_id, ts, price)``; in update mode, the value of each session that a batch changed."""
    return _run(items, ["price"], _Total(idle_ms), "session_id long, value double, priced long", "Update", delay)


class _Prices(_Expiring):
    keys, order, values, columns = ["key"], ["us", "id"], ["price", "id", "seen"], ["key", "us", "price", "state"]

    def __init__(self, hours: int, missing_hours: int):
        super().__init__(hours * 3_600_000)
        self.missing_ms = missing_hours * 3_600_000

    def step(self, key: tuple, rows: list[Row], state: tuple | None) -> tuple[tuple, int, list[tuple]]:
        new = rows[-1]
        if state is not None and (state[2], state[1]) > (new.us, new.id):
            return tuple(state), 0, []
        return (new.price, new.id, new.us), 0, [(*key, new.us, new.price, "missing" if new.price is None else "fresh")]

    def expires(self, state: tuple) -> int:
        return state[-1] // 1000 + (self.missing_ms if state[0] is None else self.idle_ms)

    def end(self, key: tuple, state: tuple) -> list[tuple]:
        return [(*key, state[-1], None, "expired")]


def stream_price_state(updates: DataFrame, hours: int = 24, missing_hours: int = 1, delay: str = DELAY) -> DataFrame:
    """``updates(key, ts, id, price)``; in update mode, each key's latest price (a null price is a miss) and, once the watermark passes its life, that it expired."""
    return _run(updates, ["id", "price"], _Prices(hours, missing_hours), "key long, us long, price double, state string", "Update", delay)


def stream_debounce(events: DataFrame, gap_ms: int = 400, delay: str = "10 seconds") -> DataFrame:
    """Sessions that end after a quiet gap, behind a watermark; the last event of each."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return e.groupBy("key", F.session_window("ts", f"{gap_ms} milliseconds")).agg(F.max_by(F.struct("ts", "id"), F.struct("ts", "id")).alias("last")).select("key", "last.ts", "last.id")


def stream_identify(scans: DataFrame, batch_function, sink) -> Any:
    """Runs a batch identification on each micro-batch of scans and hands its rows to ``sink(df, batch_id)``; ranks need whole batches."""
    return scans.writeStream.foreachBatch(lambda df, n: sink(batch_function(df), n))
