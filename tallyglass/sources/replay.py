"""Replays a table as a stream: slices of it land one after the other, and each is a micro-batch of a query that starts again from its checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import landing

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def by_time(df: DataFrame, ts: str, slices: int) -> DataFrame:
    """``df`` with ``slice``: the number of the equal stretch of time, of ``slices``, that a row falls into."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    ends = df.agg(F.min(us).alias("_least"), F.max(us).alias("_most"))
    return df.join(F.broadcast(ends)).withColumn("slice", F.expr(f"((unix_micros(cast({ts} as timestamp)) - _least) * {slices}) div (_most - _least + 1)").cast("int")).drop("_least", "_most")


def replay(df: DataFrame, slices: int, build: Callable[[DataFrame], DataFrame], mode: str = "append") -> tuple[DataFrame, str]:
    """(rows that ``build`` makes of the stream, with the number of their micro-batch as ``batch``; the query's checkpoint).

    ``df`` has the slice of each row as ``slice``. Each slice is landed and processed to its end before the next one lands, so a stream's state is
    written and read again between them. A micro-batch that is run again replaces its own rows.
    """
    spark: SparkSession = df.sparkSession
    path, rows = landing(spark, "replay"), df.drop("slice")
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        for k in range(slices):
            df.filter(F.col("slice") == k).drop("slice").write.mode("append").parquet(f"{path}/in")
            stream = build(spark.readStream.schema(rows.schema).parquet(f"{path}/in"))
            sink = lambda out, n: out.write.mode("overwrite").parquet(f"{path}/out/batch={n}")
            stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is not None:
            spark.conf.set(PROVIDER, before)
    return spark.read.option("basePath", f"{path}/out").parquet(f"{path}/out"), f"{path}/state"


def latest(out: DataFrame, key: str) -> DataFrame:
    """Of the rows of an update-mode stream, those of each key's last micro-batch."""
    last = out.withColumn("_last", F.max("batch").over(Window.partitionBy(key)))
    return last.filter(F.col("batch") == F.col("_last")).drop("_last", "batch")


def counted_late(spark: SparkSession, checkpoint: str, key: str) -> DataFrame:
    """``key, late``: the rows that a stateful operator dropped because later ones of their key had been seen, from its state."""
    s = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "state").load()
    return s.select(F.col(f"list_element.{key}").alias(key), F.col("list_element.late").alias("late"))
