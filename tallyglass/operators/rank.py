"""Ranking and fusion of result lists ``query_id, card_id, rank[, sim]``; ranks begin at 1 and every order ends with an id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import strip_zeros, two_places


def again(df: DataFrame, *order: Column) -> DataFrame:
    """The rows with a new rank in the given order within their query."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def promo() -> Column:
    return F.coalesce(F.startswith("set_code", F.lit("mcd")), F.lit(False)).cast("int")


def dedupe_and_rank(hits: DataFrame, queries: DataFrame, catalog: DataFrame, totals: DataFrame) -> DataFrame:
    """The first of equal name, set and number; then stable by set-total match, number match (equal, prefix, other) and promo sets last.

    ``totals(set_code, total)`` gives the printed totals of first-language sets; second-language rows carry their own.
    """
    rows = hits.join(catalog.select("card_id", "language", "name", "set_code", "card_number", "set_total"), "card_id")
    same = Window.partitionBy("query_id", "name", F.coalesce("set_code", F.lit("")), F.coalesce("card_number", F.lit(""))).orderBy("rank", "card_id")
    rows = rows.withColumn("nth", F.row_number().over(same)).filter("nth = 1")
    rows = rows.join(queries.select("query_id", F.col("card_number").alias("q_number"), F.col("set_total").alias("q_total")), "query_id").join(totals, "set_code", "left")
    printed = F.when(F.col("language") == "ja", F.col("set_total")).otherwise(F.col("total"))
    total_rank = F.when(F.col("q_total").isNotNull() & (printed == F.col("q_total")), 0).otherwise(1)
    number, hint = F.split(F.regexp_replace(F.coalesce("card_number", F.lit("")), "^0+", ""), "/")[0], F.regexp_replace("q_number", "^0+", "")
    number_rank = F.when(F.coalesce("q_number", F.lit("")) == "", 0).when(number == hint, 0).when(F.startswith(number, hint), 1).otherwise(2)
    return again(rows, total_rank, number_rank, promo(), F.col("rank"), F.col("card_id")).select("query_id", "card_id", "rank")


def fuse(image: DataFrame, text: DataFrame, weights: tuple[float, float] = (1.0, 2.0), k: int = 60, least_sim: float = 0.83) -> DataFrame:
    """Weighted reciprocal ranks, ``query_id, card_id, score, rank``. Image lists are left out where there is text and the best similarity is under ``least_sim``."""
    usable = image.groupBy("query_id").agg(F.max("sim").alias("best")).join(text.select("query_id", F.lit(1).alias("t")).distinct(), "query_id", "left").filter((F.col("best") >= least_sim) | F.col("t").isNull()).select("query_id")
    one = image.join(usable, "query_id", "left_semi").select("query_id", "card_id", (F.lit(weights[0]) / (F.col("rank") - 1 + k)).alias("part"), F.struct(F.lit(0).alias("list"), F.col("rank").alias("rank")).alias("seen"))
    two = text.select("query_id", "card_id", (F.lit(weights[1]) / (F.col("rank") - 1 + k)).alias("part"), F.struct(F.lit(1).alias("list"), F.col("rank").alias("rank")).alias("seen"))
    g = one.union(two).groupBy("query_id", "card_id").agg(F.round(F.sum("part"), 9).alias("score"), F.min("seen").alias("seen"))
    return again(g, F.desc("score"), F.col("seen"), F.col("card_id")).select("query_id", "card_id", "score", "rank")


def promote_number(hits: DataFrame, catalog: DataFrame, numbers: DataFrame) -> DataFrame:
    """Cards whose unpadded number equals the query's ``card_number`` first, the order within kept."""
    j = hits.join(catalog.select("card_id", "card_number"), "card_id", "left").join(numbers.select("query_id", F.col("card_number").alias("q")), "query_id", "left")
    equal = F.coalesce(strip_zeros(F.col("card_number")) == strip_zeros(F.col("q")), F.lit(False))
    return again(j.withColumn("e", equal), F.desc("e"), F.col("rank"), F.col("card_id")).select(*hits.columns)


def demote_promos(hits: DataFrame, catalog: DataFrame) -> DataFrame:
    j = hits.join(catalog.select("card_id", "set_code"), "card_id", "left").withColumn("p", promo())
    return again(j, F.col("p"), F.col("rank"), F.col("card_id")).select(*hits.columns)


def intersect_boost(image: DataFrame, text: DataFrame, catalog: DataFrame, k: int = 10) -> DataFrame:
    """Cards of both lists first in image order, then image only, then text only with promo sets last."""
    j = image.select("query_id", "card_id", F.col("rank").alias("ri")).join(text.select("query_id", "card_id", F.col("rank").alias("rt")), ["query_id", "card_id"], "full_outer").join(catalog.select("card_id", "set_code"), "card_id", "left")
    kind = F.when(F.col("ri").isNotNull() & F.col("rt").isNotNull(), 0).when(F.col("ri").isNotNull(), 1).otherwise(2)
    j = j.withColumn("kind", kind)
    return again(j, F.col("kind"), F.when(F.col("kind") == 2, promo()).otherwise(0), F.coalesce("ri", "rt"), F.col("card_id")).filter(F.col("rank") <= k).select("query_id", "card_id", "kind", "rank")


def image_label(best: Column) -> Column:
    return F.when(best.isNull(), "image:no_match").otherwise(F.concat(F.lit("image:"), two_places(best)))


def assemble(crops: DataFrame, fused: DataFrame, image_sim: DataFrame, text: DataFrame, least_sim: float = 0.83) -> DataFrame:
    """One row per crop: ordered candidates, the label of the search used, the source (both, image, ocr, none) and the partial flag with its reasons.

    ``crops(query_id, label, image_failed, ocr_failed)``, ``label`` of the text search; ``image_sim(query_id, best)``.
    """
    lists = fused.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "card_id"))).alias("c"))
    j = crops.join(lists, "query_id", "left").join(image_sim, "query_id", "left").join(text.select("query_id", F.lit(True).alias("has_text")).distinct(), "query_id", "left")
    has_text = F.coalesce("has_text", F.lit(False))
    has_image = F.col("best").isNotNull() & (~has_text | (F.col("best") >= least_sim))
    reasons = F.array_compact(F.array(F.when(F.col("image_failed"), "image_failed"), F.when(F.col("ocr_failed"), "ocr_failed")))
    return j.select("query_id", F.coalesce(F.transform("c", lambda x: x["card_id"]), F.array().cast("array<bigint>")).alias("candidates"), F.when(has_text, F.col("label")).otherwise(image_label(F.col("best"))).alias("query_used"), F.when(has_text & has_image, "both").when(has_image, "image").when(has_text, "ocr").otherwise("none").alias("source"), (F.size(reasons) > 0).alias("partial"), F.when(F.size(reasons) > 0, F.array_join(reasons, ",")).alias("partial_reason"))


def first_per_top_hit(results: DataFrame) -> DataFrame:
    """Of crops with one and the same best card, the first; crops without candidates all stay. ``results(scan_id, crop, candidates, source)``."""
    r = results.withColumn("best", F.get("candidates", F.lit(0)))
    w = Window.partitionBy("scan_id", "best").orderBy("crop")
    return r.withColumn("n", F.row_number().over(w)).filter("n = 1 OR best IS NULL").select("scan_id", "crop", "best", "source")


def scan_counts(first: DataFrame) -> DataFrame:
    return first.groupBy("scan_id").agg(F.count("best").alias("found"), F.count_if(F.col("source").isin("both", "image")).alias("confident"))
