"""Prefix sums and other running aggregates over numbered blocks, without a window that spans them all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Blocks whose aggregates one window orders, and levels of such windows: enough for 1024 ** 3 blocks.
WIDTH, LEVELS = 1024, 3


def before(blocks: DataFrame, block: str, value: str, name: str, combine: Callable[[Column], Column] = F.sum, width: int = WIDTH, levels: int = LEVELS) -> DataFrame:
    """``blocks``, one row for each number in ``block``, with ``name``: ``combine`` (a sum, a greatest or a least value) of ``value`` over all smaller numbers, null if there are none.

    Runs of ``width`` numbers are ordered each on its own; their aggregates are numbered blocks again, one level up, and what stands before a
    run there is combined with what stands before a block in it. Numbers of any sign count from the least one."""
    least = blocks.agg(F.min(block).alias("_least"))
    d = blocks.join(F.broadcast(least)).withColumn("_at", (F.col(block) - F.col("_least")).cast("long")).drop("_least")
    return _level(d, value, name, combine, width, levels).drop("_at")


def _level(d: DataFrame, value: str, name: str, combine, width: int, levels: int) -> DataFrame:
    d = d.withColumn("_run", F.floor(F.col("_at") / width))
    own = combine(F.col(value)).over(Window.partitionBy("_run").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn(name, own)
    if levels == 1:
        return d.drop("_run")
    runs = _level(d.groupBy(F.col("_run").alias("_at")).agg(combine(F.col(value)).alias("_value")), "_value", "_before", combine, width, levels - 1)
    d = d.join(runs.select(F.col("_at").alias("_run"), F.col("_before").alias("_above")), "_run")
    both = F.array_compact(F.array(name, "_above"))
    joined = {F.sum: lambda: F.aggregate(F.slice(both, 2, 1), F.get(both, F.lit(0)), lambda a, x: a + x), F.max: lambda: F.array_max(both), F.min: lambda: F.array_min(both)}[combine]()
    return d.withColumn(name, joined).drop("_run", "_above")
