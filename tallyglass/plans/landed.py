"""Queries that land records as files or streams and read them back, with their DuckDB texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as c
from ..operators import identify as full
from ..operators import search
from ..operators.grams import stored
from ..sources.shared import landing
from ..sources.views import VIEWS, table, view, with_views
from ..streaming import frames
from . import identify
from .search import CAT, QRY, j1

VIEWS["v_variants"] = """SELECT concat('{', CASE p_partkey % 3 WHEN 0 THEN concat('"id":"a', p_partkey, '"') WHEN 1 THEN concat('"id":null,"cardId":"b', p_partkey, '"') ELSE concat('"cardId":"c', p_partkey, '"') END, ',"name":"', p_name, '"',
       CASE p_partkey % 4 WHEN 0 THEN ',"nameJp":null,"nameJa":"x"' WHEN 1 THEN ',"nameJa":"カ"' ELSE '' END, CASE WHEN p_partkey % 2 = 0 THEN ',"set":"' ELSE ',"setId":"' END, p_type, '","setName":"', p_brand, '"',
       CASE p_partkey % 5 WHEN 0 THEN concat(',"images":{"small":"s', p_partkey, '"},"imageUrl":"w"') WHEN 1 THEN concat(',"imageUrl":"i', p_partkey, '"') ELSE '' END, CASE p_partkey % 6 WHEN 0 THEN ',"colors":["Red","Blue"]' WHEN 1 THEN ',"color":"Green"' ELSE '' END, '}') AS record FROM part"""
#: Cards on a landed page, and in a landed asset.
PAGE_CARDS, ASSET_CARDS = 50, 1000
#: Micro-batches of the stream of scans.
SCAN_BATCHES = 2


def landed_pages(sp, d):
    """A folder of JSON pages, one page a line; some fields are left out."""
    id_ = F.col("card_id")
    images = F.when(id_ % 5 != 0, F.struct(F.concat(F.lit("u"), id_).alias("small"), F.concat(F.lit("v"), id_).alias("large")))
    card = F.struct(id_.cast("string").alias("id"), F.when(id_ % 9 != 0, F.col("name")).alias("name"), F.struct(F.col("set_code").alias("id"), F.col("set_name").alias("name")).alias("set"), F.when(id_ % 4 != 0, F.col("card_number")).alias("number"),
                    F.when(id_ % 3 == 0, "Rare").alias("rarity"), images.alias("images"), F.when(id_ % 8 == 0, F.array(F.lit("Basic"), F.lit("Old"))).alias("subtypes"))
    path = landing(sp, "pages")
    CAT(sp, d).groupBy(F.floor(id_ / PAGE_CARDS)).agg(F.collect_list(card).alias("data")).select(F.to_json(F.struct("data")).alias("value")).write.text(path)
    return path


def catalog_pages(sp, d):
    return c.read_catalog_pages(sp, landed_pages(sp, d)).withColumn("subtypes", F.array_join("subtypes", ","))


def misread(sp, d):
    """Second-language names, a third of them read in the wrong encoding, and a third that only looks so."""
    text = F.coalesce("name_ja", F.concat(F.lit("Pokémon "), "name"))
    wrong = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    return CAT(sp, d).select("card_id", F.when(F.col("card_id") % 3 == 0, wrong).when(F.col("card_id") % 3 == 1, text).otherwise(F.concat(F.lit("Ã "), "name")).alias("text"))


def page_encoder():
    """A stand-in for an image model: the number of bytes and of tags; nothing for an empty image."""
    return lambda images: [[float(len(b)), float(b.count(b"<"))] if b else None for b in images]


def embedded_pages(sp, d):
    images = table(sp, d, "pages").select(F.col("page_id").alias("image_id"), F.when(F.col("page_id") % 7 != 0, F.encode("html", "UTF-8")).alias("bytes"))
    return c.embed_images(images, page_encoder).select("image_id", F.get("embedding", F.lit(0)).cast("long").alias("n_bytes"), F.get("embedding", F.lit(1)).cast("long").alias("n_tags"), "reason")


def asset_manifest(sp, d):
    """Assets of a bounded number of cards each, one file a folder; file names are Spark's own, so they are left out."""
    path = landing(sp, "assets")
    lines = CAT(sp, d).select("card_id", F.floor(F.col("card_id") / ASSET_CARDS).alias("asset"), F.concat_ws(":", "card_id", "name").alias("value"))
    lines.repartition("asset").sortWithinPartitions("asset", "card_id").select("asset", "value").write.partitionBy("asset").text(path)
    return c.manifest(sp, path).filter("endswith(filename, '.txt')").select("sha256", "size")


def results_jsonl(sp, d):
    """The candidates of each query, written as JSON lines and read again."""
    hits = search.name_search(QRY(sp, d), CAT(sp, d)).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "card_id"))).alias("candidates"))
    path = landing(sp, "results")
    c.write_results_jsonl(hits, path)
    back = sp.read.schema("query_id long, candidates array<struct<rank:int,card_id:long>>").json(path)
    return back.select("query_id", F.array_join(F.transform("candidates", lambda x: F.concat_ws(":", x["rank"].cast("string"), x["card_id"].cast("string"))), ",").alias("candidates"))


def identified_stream(sp, d):
    """Name search over a stream of queries; a micro-batch that is run again replaces its own rows. The catalogue's index is opened once."""
    path, queries = landing(sp, "scans"), QRY(sp, d)
    queries.write.parquet(f"{path}/in")
    catalog, grams = CAT(sp, d), stored(CAT(sp, d))
    scans = sp.readStream.schema(queries.schema).option("maxFilesPerTrigger", 1000).parquet(f"{path}/in")
    sink = lambda found, n: found.write.mode("overwrite").parquet(f"{path}/out/batch={n}")
    run = frames.stream_identify(scans, lambda batch: search.name_search(batch, catalog, grams=grams), sink).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return sp.read.schema("query_id long, card_id long, rank int").parquet(f"{path}/out").select("query_id", "card_id", "rank")


def identified_in_full(sp, d):
    """The whole identification of ``r8_identify`` over a stream of scans, in ``SCAN_BATCHES`` micro-batches."""
    path, queries = landing(sp, "scans"), QRY(sp, d)
    queries.repartition(SCAN_BATCHES, "query_id").write.parquet(f"{path}/in")
    scans = sp.readStream.schema(queries.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    grams = stored(CAT(sp, d))

    def find(batch):
        own = identify.QV(sp, d).join(batch.select(F.col("query_id").alias("vec_id")), "vec_id", "left_semi")
        return full.identify(batch, own, CAT(sp, d), identify.VEC(sp, d), identify.totals(sp, d), least_sim=identify.WITH_TEXT, floor=identify.FLOOR, grams=grams)

    sink = lambda found, n: found.write.mode("overwrite").parquet(f"{path}/out/batch={n}")
    run = frames.stream_identify(scans, find, sink).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    found = sp.read.schema("query_id long, candidates array<long>, query_used string, source string, partial boolean, partial_reason string").parquet(f"{path}/out")
    return found.select("query_id", F.array_join("candidates", ",").alias("candidates"), "query_used", "source", "partial", "partial_reason")


def identified_scans(sp, d):
    """``r8_identify_scans``, hints included, over a stream of raw scans in ``SCAN_BATCHES`` micro-batches."""
    path, scans = landing(sp, "scans"), identify.raw_scans(sp, d)
    scans.repartition(SCAN_BATCHES, "scan_id").write.parquet(f"{path}/in")
    grams = stored(CAT(sp, d))
    stream = sp.readStream.schema(scans.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    sink = lambda found, n: found.write.mode("overwrite").parquet(f"{path}/out/batch={n}")
    run = frames.stream_identify(stream, lambda batch: identify.scanned(sp, d, batch, "combined", grams), sink).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    found = sp.read.schema("query_id long, candidates string, query_used string, source string, partial boolean, partial_reason string").parquet(f"{path}/out")
    return found.select("query_id", "candidates", "query_used", "source", "partial", "partial_reason")


QUERIES = {
    "a1_read_catalog_pages": catalog_pages,
    "a2_map_variant_fields": lambda sp, d: c.map_variant_fields(view(sp, d, "v_variants")).withColumn("colors", F.array_join("colors", ",")),
    "a6_repair_mojibake": lambda sp, d: c.repair_mojibake(misread(sp, d), ["text"]),
    "a16_embed_images": embedded_pages,
    "a20_manifest": asset_manifest,
    "a25_write_results_jsonl": results_jsonl,
    "s3_stream_identify": identified_stream,
    "s3_stream_identify_full": identified_in_full,
    "s3_stream_identify_scans": identified_scans,
}

ORACLES = {
    "a1_read_catalog_pages": with_views("""SELECT card_id::VARCHAR AS external_id, CASE WHEN card_id % 9 <> 0 THEN name ELSE '' END AS name, set_name, set_code, CASE WHEN card_id % 4 <> 0 THEN card_number ELSE '' END AS card_number, CASE WHEN card_id % 3 = 0 THEN 'Rare' END AS rarity,
      CASE WHEN card_id % 5 <> 0 THEN 'u' || card_id END AS image_url, CASE WHEN card_id % 5 <> 0 THEN 'v' || card_id END AS image_url_hi, '' AS supertype, CASE WHEN card_id % 8 = 0 THEN 'Basic,Old' ELSE '' END AS subtypes FROM v_catalog"""),
    "a2_map_variant_fields": """SELECT CASE p_partkey % 3 WHEN 0 THEN 'a' || p_partkey WHEN 2 THEN 'c' || p_partkey END AS external_id, p_name AS name, CASE p_partkey % 4 WHEN 1 THEN 'カ' END AS name_ja, p_type AS set_name, p_brand AS set_code,
      CASE p_partkey % 5 WHEN 0 THEN 's' || p_partkey WHEN 1 THEN 'i' || p_partkey END AS image_url, CASE p_partkey % 6 WHEN 0 THEN 'Red,Blue' WHEN 1 THEN 'Green' ELSE '' END AS colors FROM part""",
    "a6_repair_mojibake": with_views("SELECT card_id, CASE WHEN card_id % 3 = 2 THEN 'Ã ' || name ELSE coalesce(name_ja, 'Pokémon ' || name) END AS text FROM v_catalog"),
    "a16_embed_images": "SELECT page_id AS image_id, CASE WHEN page_id % 7 <> 0 THEN octet_length(encode(html)) END::BIGINT AS n_bytes, CASE WHEN page_id % 7 <> 0 THEN length(html) - length(replace(html, '<', '')) END::BIGINT AS n_tags, CASE WHEN page_id % 7 = 0 THEN 'no vector' END AS reason FROM pages",
    "a20_manifest": with_views(f"SELECT sha256(t) AS sha256, octet_length(encode(t))::BIGINT AS size FROM (SELECT string_agg(card_id || ':' || name || chr(10), '' ORDER BY card_id) AS t FROM v_catalog GROUP BY card_id // {ASSET_CARDS})"),
    "a25_write_results_jsonl": with_views(f"SELECT query_id, string_agg(rank || ':' || card_id, ',' ORDER BY rank) AS candidates FROM ({j1()}) GROUP BY query_id"),
    "s3_stream_identify": with_views(j1()),
    "s3_stream_identify_full": identify.ORACLES["r8_identify"],
    "s3_stream_identify_scans": identify.ORACLES["r8_identify_scans"],
}
