"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` of long node ids to ``(node, root)``; the root is the smallest node reachable. Nodes without a link do not appear.

    Each step hangs neighbours on the smallest node they can see, so the number of steps grows with the logarithm of the
    longest path. State stays in the shared checkpoint folder; the driver sees only two numbers a step.
    """
    pairs = cut(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    seen = None
    while True:
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select("b", "a"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: larger neighbours of u go to the smallest node next to u
        large = both.filter("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b").distinct()
        # small star: smaller neighbours of b, and b itself, go to the smallest of them
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(least, "b")
        pairs = cut(joined.select(F.col("m").alias("a"), F.col("a").alias("b")).filter("a <> b").union(joined.select(F.col("m").alias("a"), "b")).distinct())
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    return pairs.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")).union(pairs.select("a", "a").distinct())
