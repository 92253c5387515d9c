"""Identify scans: text and vector search of each crop, fused into one answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import strip_zeros
from ..sources.shared import landed
from . import ocr, rank, search, vectors
from .grams import Grams

HITS = "query_id long, card_id long, rank int"


def image_hits(query_vectors: DataFrame, index: DataFrame, floor: float) -> DataFrame:
    """The nearest cards of queries whose best similarity reaches the floor, landed."""
    hits = landed(vectors.knn_exact(query_vectors, index), "image-hits")
    good = hits.groupBy("query_id").agg(F.max("sim").alias("best")).filter(F.col("best") >= floor)
    return hits.join(good.select("query_id"), "query_id", "left_semi")


def answer(queries: DataFrame, image: DataFrame, text: DataFrame, catalog: DataFrame, mode: str, least_sim: float, confident: float) -> DataFrame:
    """``query_id, candidates, query_used, source, partial, partial_reason``.

    ``queries(query_id, label, card_number, image_number, image_failed, ocr_failed)``: the image hits are re-ranked by ``image_number`` before
    the fusion, all of it by ``card_number`` after. A branch that failed has no hits, and its mode says so.
    """
    image = rank.promote_number(image, catalog, queries.select("query_id", F.col("image_number").alias("card_number")))
    best = image.groupBy("query_id").agg(F.max("sim").alias("best"))
    crops = queries.select("query_id", "label", (F.col("image_failed") & F.lit(mode != "ocr")).alias("image_failed"), (F.col("ocr_failed") & F.lit(mode != "image")).alias("ocr_failed"))
    if mode == "ocr":
        shown = rank.assemble(crops, text, best, text).drop("query_used").join(crops.select("query_id", F.coalesce("label", F.lit("unknown")).alias("query_used")), "query_id")
        return shown.select("query_id", "candidates", "query_used", "source", "partial", "partial_reason")
    if mode == "image":
        shown = rank.assemble(crops, rank.demote_promos(image.select("query_id", "card_id", "rank"), catalog), best, text, 0.0)
        low = shown.join(best, "query_id", "left").withColumn("source", F.when(F.col("best") >= confident, "image").when(F.col("best").isNotNull(), "image:low").otherwise("none"))
        return low.drop("best")
    fused = rank.fuse(image, text, least_sim=least_sim).drop("score")
    fused = rank.demote_promos(rank.promote_number(fused, catalog, queries.select("query_id", "card_number")), catalog)
    return rank.assemble(crops, fused, best, text, least_sim)


def identify(queries: DataFrame, query_vectors: DataFrame, catalog: DataFrame, index: DataFrame, totals: DataFrame, mode: str = "combined", least_sim: float = 0.83, floor: float = 0.45, confident: float = 0.65, grams: Grams | None = None) -> DataFrame:
    """The answer to ready queries ``query_id, game, language, text, card_number, set_total``.

    Modes: ``ocr`` (text only), ``image`` (vectors only), ``combined``. Either search runs once over the whole table, and its hits are landed.
    ``grams``: the stored index of the catalogue.
    """
    none = queries.sparkSession.createDataFrame([], HITS)
    text = none if mode == "image" else landed(rank.dedupe_and_rank(search.search(queries, catalog, grams=grams).drop("source"), queries, catalog, totals), "text-hits")
    image = none.withColumn("sim", F.lit(0.0)) if mode == "ocr" else image_hits(query_vectors, index, floor)
    q = queries.select("query_id", F.col("text").alias("label"), "card_number", F.col("card_number").alias("image_number"), F.lit(False).alias("image_failed"), F.lit(False).alias("ocr_failed"))
    return answer(q, image, text, catalog, mode, least_sim, confident)


def scan_queries(scans: DataFrame, names: DataFrame, entries: DataFrame) -> DataFrame:
    """The hints of scans ``scan_id, game, language, raw_text`` as searches."""
    h = scans.select("scan_id", "game", "language", "raw_text").join(ocr.build_hints(scans, names, entries), "scan_id")
    number = F.when(F.col("raw_text").rlike(r"\d+/\d+"), strip_zeros(F.regexp_extract("raw_text", r"(\d+)/\d+", 1)))
    return h.select(F.col("scan_id").alias("query_id"), "game", "language", F.col("name").alias("text"), F.col("ja_trainer_name").alias("trainer"), "card_number", F.col("set_total").cast("int").alias("set_total"), "label", number.alias("image_number"))


def text_search(queries: DataFrame, catalog: DataFrame, other: DataFrame | None = None, k: int = 10, grams: Grams | None = None) -> DataFrame:
    """Substring, else fuzzy search by name; second-language trainer names where no name is known; a second catalogue where hits are few."""
    named = queries.filter("text IS NOT NULL")
    first = search.name_search(named, catalog, k, grams)
    if grams and grams.name.buckets > 1:  # the buckets that the rest asks for are looked up first
        first = landed(first, "name-hits")
    own = first.unionByName(search.fuzzy_search(search.unmatched(named, first), catalog, k=k, grams=grams).drop("sim"))
    trainers = search.unmatched(queries.filter("language = 'ja' AND trainer IS NOT NULL"), own).withColumn("text", F.col("trainer"))
    hits = own.unionByName(search.ja_name_search(trainers, catalog, k, grams))
    return hits if other is None else search.fallback_source(named, hits, catalog, other).drop("origin")


def identify_scans(scans: DataFrame, query_vectors: DataFrame, names: DataFrame, entries: DataFrame, catalog: DataFrame, index: DataFrame, totals: DataFrame, mode: str = "combined", other: DataFrame | None = None, least_sim: float = 0.83, floor: float = 0.45, confident: float = 0.65, k: int = 10, grams: Grams | None = None) -> DataFrame:
    """The answer to raw scans: hints from their text, search by them, vectors, fusion. ``grams``: the stored index of the catalogue.

    ``scans(scan_id, game, language, raw_text, image_failed, ocr_failed)``: the flags say that a scan's image or text could not be had; that
    branch is left out and reported. Second-language scans without a hit are read and searched again as first-language ones.
    """
    none = scans.sparkSession.createDataFrame([], HITS)
    flags = scans.select(F.col("scan_id").alias("query_id"), F.coalesce("image_failed", F.lit(False)).alias("image_failed"), F.coalesce("ocr_failed", F.lit(False)).alias("ocr_failed"))
    readable = scans.filter("NOT coalesce(ocr_failed, false) AND trim(coalesce(raw_text, '')) <> ''")
    cards = catalog if other is None else catalog.unionByName(other)
    q = landed(scan_queries(readable, names, entries), "queries")
    if mode == "image":
        text = none
    else:
        first = landed(text_search(q, catalog, other, k, grams), "text-hits")
        again = readable.filter("language = 'ja'").join(first.select(F.col("query_id").alias("scan_id")).distinct(), "scan_id", "left_anti").withColumn("language", F.lit("en"))
        q2 = landed(scan_queries(again, names, entries), "queries")
        q = q.join(q2.select("query_id"), "query_id", "left_anti").unionByName(q2)
        hits = rank.dedupe_and_rank(first.unionByName(text_search(q2, catalog, other, k, grams)), q, cards, totals)
        text = landed(hits.filter(F.col("rank") <= k), "text-hits")
    image = none.withColumn("sim", F.lit(0.0)) if mode == "ocr" else image_hits(query_vectors.join(flags.filter("image_failed").select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti"), index, floor)
    # a number after fusion counts only where the label shows one
    shown = F.when(F.contains("label", F.lit("#")), F.col("card_number"))
    asked = flags.join(q.select("query_id", "label", shown.alias("card_number"), "image_number"), "query_id", "left")
    return answer(asked, image, text, cards, mode, least_sim, confident)
