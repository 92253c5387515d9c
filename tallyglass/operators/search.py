"""Text search of a catalogue by whole query tables.

Theta joins (substring, trigram similarity) run as equi-joins over grams of the distinct texts of either side; only the pairs of
texts that match fan out to rows. The catalogue's grams are worked out within a search, or read from a stored index (``grams``, see
:func:`.grams.stored`). A catalogue row: ``card_id, game, language, name, ..``; a query row: ``query_id, game, language, text``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import similarity, strip_zeros, top, word_similarity
from ..sources.shared import landed
from .grams import KEY, Grams, similar_pairs, substring_pairs

def name_search(queries: DataFrame, catalog: DataFrame, k: int = 10, grams: Grams | None = None) -> DataFrame:
    """``query_id, card_id, rank``: exact names first, then by number (if given) or set total, then the newest.

    Equal searches are made once. Of the cards of one name and number (for searches with a number) or set total (for the others), which all
    rank alike, only the ``k`` newest meet the searches, so the work does not grow with queries times cards of a name.
    """
    number = F.col("card_number")
    q = queries.select("query_id", *KEY, F.col("text").alias("needle"), number.alias("q_number"), F.when(number.isNull(), F.col("set_total")).alias("q_total"))
    asked = q.drop("query_id").distinct().withColumn("numbered", F.col("q_number").isNotNull())
    pairs = substring_pairs(q.select(*KEY, "needle"), grams.name if grams else catalog)
    rows = catalog.select("card_id", *KEY, "name", "card_number", "set_total")
    newest = lambda by, numbered: top(rows, [*KEY, "name", by], [F.desc("card_id")], k).drop("rank").withColumn("numbered", F.lit(numbered))
    hits = asked.join(pairs, [*KEY, "needle"]).join(newest("card_number", True).unionByName(newest("set_total", False)), [*KEY, "name", "numbered"])
    exact = F.when(F.lower("name") == F.lower("needle"), 0).otherwise(1)
    number = F.when(F.col("numbered"), F.when(F.contains("card_number", "q_number"), 0).otherwise(1)).otherwise(F.when(F.col("set_total") == F.col("q_total"), 0).otherwise(1))
    search = [*KEY, "needle", "q_number", "q_total"]
    return fan_out(q, top(hits, search, [exact, number, F.desc("card_id")], k), search).select("query_id", "card_id", "rank")


def fan_out(queries: DataFrame, found: DataFrame, search: list[str]) -> DataFrame:
    """The rows that were found for a search, for each query that asks for it; a search's missing values are equal."""
    f = found.select(*[F.col(c).alias(f"_{c}") for c in search], *[c for c in found.columns if c not in search])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in search]
    return queries.join(f, same).drop(*[f"_{c}" for c in search])


def fuzzy_search(queries: DataFrame, catalog: DataFrame, least: float = 0.35, k: int = 10, grams: Grams | None = None) -> DataFrame:
    """``query_id, card_id, sim, rank`` by trigram similarity; give it the queries that :func:`name_search` left without a hit.

    The first ``k`` cards of a name meet a text once, whatever the number of its queries and of the name's cards."""
    q = queries.select("query_id", *KEY, F.col("text").alias("needle"))
    first = top(catalog.select("card_id", *KEY, "name"), [*KEY, "name"], [F.asc("card_id")], k).drop("rank")
    hits = similar_pairs(q, grams.name if grams else catalog, least).join(first, [*KEY, "name"])
    hits = top(hits, [*KEY, "needle"], [F.desc("sim"), F.asc("card_id")], k)
    return q.join(hits, [*KEY, "needle"]).select("query_id", "card_id", F.round("sim", 6).alias("sim"), "rank")


def unmatched(queries: DataFrame, hits: DataFrame) -> DataFrame:
    return queries.join(hits.select("query_id").distinct(), "query_id", "left_anti")


def ja_name_search(queries: DataFrame, catalog: DataFrame, k: int = 10, grams: Grams | None = None) -> DataFrame:
    """Substring search of the second-language name, number matches first, for queries of that language."""
    other = catalog.filter("language = 'ja' AND name_ja IS NOT NULL").select("card_id", *KEY, F.col("name_ja").alias("name"), "card_number", "set_total")
    q = queries.filter("language = 'ja'").select("query_id", *KEY, F.col("text").alias("needle"), F.col("card_number").alias("q"))
    pairs = substring_pairs(q.select(*KEY, "needle"), grams.name_ja if grams else other)
    newest = top(other, [*KEY, "name", "card_number"], [F.desc("card_id")], k).drop("rank")
    hits = q.drop("query_id").distinct().join(pairs, [*KEY, "needle"]).join(newest, [*KEY, "name"])
    search = [*KEY, "needle", "q"]
    return fan_out(q, top(hits, search, [F.when(F.contains("card_number", "q"), 0).otherwise(1), F.desc("card_id")], k), search).select("query_id", "card_id", "rank")


def search(queries: DataFrame, catalog: DataFrame, k: int = 10, grams: Grams | None = None) -> DataFrame:
    """The text cascade: substring, else fuzzy, else second-language name. ``query_id, card_id, rank, source``."""
    first = name_search(queries, catalog, k, grams)
    left = unmatched(queries, first)
    second = fuzzy_search(left, catalog, k=k, grams=grams)
    third = ja_name_search(unmatched(left, second), catalog, k, grams)
    return first.withColumn("source", F.lit("name")).unionByName(second.drop("sim").withColumn("source", F.lit("fuzzy"))).unionByName(third.withColumn("source", F.lit("name_ja")))


def fallback_source(queries: DataFrame, hits: DataFrame, catalog: DataFrame, other: DataFrame, least: int = 3) -> DataFrame:
    """Adds rows of a second catalogue, after the found ones, to first-language queries with under ``least`` hits or none with the number."""
    own = hits.join(catalog.select("card_id", "card_number"), "card_id").join(queries.select("query_id", F.col("card_number").alias("q")), "query_id")
    have = own.groupBy("query_id").agg(F.count("*").alias("n"), F.coalesce(F.bool_or(F.contains("card_number", "q")), F.lit(False)).alias("numbered"), F.max("rank").alias("last"))
    need = queries.filter("language = 'en'").join(have, "query_id", "left").filter((F.coalesce("n", F.lit(0)) < least) | (F.col("card_number").isNotNull() & ~F.coalesce("numbered", F.lit(False))))
    extra = name_search(need.select("query_id", *KEY, "text", "card_number", "set_total"), other).join(hits.select("query_id", "card_id"), ["query_id", "card_id"], "left_anti")
    extra = extra.join(have.select("query_id", "last"), "query_id", "left").select("query_id", "card_id", (F.coalesce("last", F.lit(0)) + F.col("rank")).alias("rank"), F.lit("other").alias("origin"))
    return hits.select("query_id", "card_id", "rank", F.lit("own").alias("origin")).unionByName(extra)


def language_fallback(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """Second-language queries without a hit are run again in the first language. ``query_id, card_id, rank, searched``."""
    first = name_search(queries, catalog)
    again = unmatched(queries.filter("language = 'ja'"), first).withColumn("language", F.lit("en"))
    return first.withColumn("searched", F.lit("own")).unionByName(name_search(again, catalog).withColumn("searched", F.lit("en")))


def clean_first_line(text: Column) -> Column:
    """The first line without n/m and digits at the end; null if under two characters are left."""
    line = F.trim(F.regexp_replace(F.regexp_replace(F.split(text, "\n")[0], r"\d+\s*/\s*\d+", ""), r"\d+\s*$", ""))
    return F.when(F.length(line) >= 2, line)


def tokens_of(text: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(F.lower(F.regexp_replace(text, '["\']', "")), r"[^\p{L}\p{N}]+"), ""))


def tokens_search(queries: DataFrame, catalog: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Cards in which all tokens of a query occur (either name or the set), by BM25 over an inverted index. ``query_id, card_id, score, rank``.

    Cards of one language and equal words score alike, so they are one kind, and only the first ``k`` cards of a kind meet a search; each different
    search is made once. Its kinds come from the postings of its rarest token alone; the other tokens are looked up in the words of those kinds.
    Kinds are dealt into blocks of equal length, for which each token's greatest weight is known: a search visits the block with the greatest
    bound first, and then only the blocks whose bound reaches its k-th best score so far.
    """
    body = F.array_remove(F.split(F.lower(F.concat_ws(" ", "name", "name_ja", "set_name")), r"[^\p{L}\p{N}]+"), "")
    cards = catalog.select("card_id", "language", body.alias("words"))
    kinds = landed(cards.groupBy("language", "words").agg(F.count("*").alias("n_cards"), F.min("card_id").alias("least")), "token-kinds").withColumn("dl", F.size("words"))
    first_cards = landed(top(cards, ["language", "words"], [F.asc("card_id")], k).drop("rank"), "token-cards")
    size = kinds.agg(F.sum("n_cards").alias("n"), F.sum(F.col("dl") * F.col("n_cards")).alias("length")).select("n", (F.col("length") / F.col("n")).alias("avgdl"))
    weight = lambda tf: tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    post = kinds.select("language", "dl", "n_cards", "least", F.explode(F.array_distinct("words")).alias("token"), "words")
    blocks = post.withColumn("tf", F.size(F.filter("words", lambda w: w == F.col("token")))).groupBy("token", "language", "dl").agg(F.sum("n_cards").alias("n_cards"), F.max("tf").alias("most"))
    df = blocks.groupBy("token").agg(F.sum("n_cards").alias("df"))

    q = queries.select("query_id", "language", F.sort_array(tokens_of(F.col("text"))).alias("t")).filter("size(t) > 0")
    asked = q.select("language", "t").distinct()
    known = asked.select("language", "t", F.explode("t").alias("token")).join(df, "token").join(F.broadcast(size)).withColumn("idf", idf)
    known = known.groupBy("language", "t").agg(F.min_by("token", F.struct("df", "token")).alias("rarest"), F.map_from_entries(F.collect_list(F.struct("token", "idf"))).alias("idfs"), F.first("avgdl").alias("avgdl")).filter("size(idfs) = size(t)")
    bounds = known.select("language", "t", "rarest", "idfs", "avgdl", F.explode("t").alias("token")).join(blocks, ["token", "language"])
    bounds = bounds.groupBy("language", "t", "rarest", "dl").agg(F.first("idfs").alias("idfs"), F.first("avgdl").alias("avgdl"), F.count("*").alias("c"), F.sum(F.col("idfs")[F.col("token")] * weight(F.col("most"))).alias("bound")).filter("c = size(t)").drop("c")
    bounds = landed(bounds, "token-bounds")

    def scored(visits: DataFrame) -> DataFrame:
        hit = visits.select("language", "t", F.col("rarest").alias("token"), "dl", "idfs", "avgdl").join(post.select("token", "language", "dl", "least", "words"), ["token", "language", "dl"])
        hit = hit.withColumn("tfs", F.transform("t", lambda x: F.size(F.filter("words", lambda w: w == x)))).filter(F.forall("tfs", lambda x: x > 0))
        one = lambda x, i: F.col("idfs")[x] * weight(F.get("tfs", i))
        hit = hit.withColumn("score", F.round(F.aggregate(F.transform("t", one), F.lit(0.0), lambda s, x: s + x), 6))
        # the first k cards are of the first k kinds, as a kind's place is that of its first card
        hit = top(hit, ["language", "t"], [F.desc("score"), F.asc("least")], k).drop("rank").join(first_cards, ["language", "words"])
        return top(hit, ["language", "t"], [F.desc("score"), F.asc("card_id")], k).select("language", "t", "dl", "card_id", "score")

    best = bounds.groupBy("language", "t").agg(F.max_by("dl", F.struct("bound", "dl")).alias("dl"))
    first = landed(scored(bounds.join(best, ["language", "t", "dl"])), "token-hits")
    reached = first.groupBy("language", "t").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    rest = bounds.join(best, ["language", "t", "dl"], "left_anti").join(reached, ["language", "t"], "left").filter(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 1e-6))
    found = top(first.unionByName(scored(rest)), ["language", "t"], [F.desc("score"), F.asc("card_id")], k)
    return q.join(found, ["language", "t"]).select("query_id", "card_id", "score", "rank")


def tiered_lookup(queries: DataFrame, ref: DataFrame, strict: bool = True, second: DataFrame | None = None) -> DataFrame:
    """``query_id, card_id, tier``: the best row of equal name, by total and number (0), total (1), number (2), newest (3).

    ``strict`` gives none if a hint was given but nothing matches it. ``second(card_id, game, language, name, set_total, place)`` answers
    for names that ``ref`` does not have: the least place in a set of the total (4), else the newest (5).
    """
    rows = lambda cards, *more: cards.select("card_id", *KEY, "name", F.col("set_total").alias("total"), *more)
    q = queries.select("query_id", *KEY, F.col("text").alias("name"), strip_zeros(F.col("card_number")).alias("number"), F.col("set_total").alias("total"))
    best = _by_tier(q, rows(ref, strip_zeros(F.col("card_number")).alias("number")), [["total", "number"], ["total"], ["number"], []], F.max("card_id"))
    if strict:
        best = best.filter((F.col("tier") < 3) | (F.col("number").isNull() & F.col("total").isNull()))
    best = best.select("query_id", "card_id", "tier")
    if second is None:
        return best
    unknown = q.join(ref.select(*KEY, "name").distinct(), [*KEY, "name"], "left_anti").withColumn("total", F.when(F.col("total") > 0, F.col("total")))
    others = rows(second, "place")
    placed = others.groupBy(*KEY, "name", "total").agg(F.min(F.struct("place", -F.col("card_id"))).alias("p")).select(*KEY, "name", "total", (-F.col("p.col2")).alias("placed"))
    newest = others.groupBy(*KEY, "name").agg(F.max("card_id").alias("newest"))
    other = unknown.join(newest, [*KEY, "name"]).join(placed, [*KEY, "name", "total"], "left")
    return best.unionByName(other.select("query_id", F.coalesce("placed", "newest").alias("card_id"), F.when(F.col("placed").isNotNull(), 4).otherwise(5).alias("tier")))


def _by_tier(queries: DataFrame, rows: DataFrame, tiers: list[list[str]], best: Column) -> DataFrame:
    """``queries`` with ``card_id, tier``: the best row of equal name and, by tier, equal further columns; a look-up for each tier, of one row a key."""
    found = queries
    for n, more in enumerate(tiers):
        found = found.join(rows.groupBy(*KEY, "name", *more).agg(best.alias(f"_{n}")), [*KEY, "name", *more], "left")
    ids = [F.col(f"_{n}") for n in range(len(tiers))]
    tier = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for n, c in enumerate(ids)])
    return found.withColumn("card_id", F.coalesce(*ids)).withColumn("tier", tier).drop(*[f"_{n}" for n in range(len(tiers))]).filter("tier IS NOT NULL")


#: Parts that the cards of one name are dealt to where every query of the name gets all of them.
NAME_PARTS = 32


def all_of_name(queries: DataFrame, ref: DataFrame, second: DataFrame) -> DataFrame:
    """``query_id, card_id, rank``: all rows of equal name, the newest first; those of ``second`` where ``ref`` has none.

    The cards of a name are ranked once; what grows with queries times cards is the result alone."""
    q = queries.select("query_id", *KEY, F.col("text").alias("name"))
    own = ref.select("card_id", *KEY, "name")
    other = second.select("card_id", *KEY, "name").join(own.select(*KEY, "name").distinct(), [*KEY, "name"], "left_anti")
    asked = q.select(*KEY, "name").distinct()
    cards = own.unionByName(other).join(asked, [*KEY, "name"], "left_semi")
    ranked = cards.withColumn("rank", F.row_number().over(Window.partitionBy(*KEY, "name").orderBy(F.desc("card_id")))).withColumn("part", F.pmod("rank", F.lit(NAME_PARTS)))
    every = q.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(NAME_PARTS - 1))))
    return every.join(ranked, [*KEY, "name", "part"]).select("query_id", "card_id", "rank")


def attach_metadata(ranked: DataFrame, catalog: DataFrame) -> DataFrame:
    """Ids to rows, rank kept; unknown ids drop out."""
    return ranked.join(catalog, "card_id").select("query_id", "rank", "card_id", "name", "set_code", "card_number")


def match_certificates(certs: DataFrame, catalog: DataFrame, prices: DataFrame) -> DataFrame:
    """Certificate name to its first hit in the first language and that card's price."""
    q = certs.select(F.col("cert_id").alias("query_id"), F.lit("pokemon").alias("game"), F.lit("en").alias("language"), F.col("name").alias("text"), F.lit(None).cast("string").alias("card_number"), F.lit(None).cast("int").alias("set_total"))
    first = search(q, catalog, 1).select(F.col("query_id").alias("cert_id"), "card_id")
    return certs.select("cert_id", "name").join(first, "cert_id", "left").join(prices, "card_id", "left").select("cert_id", "name", "card_id", "price")


def share_searches(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """Equal (game, language, text, number) are searched once, the result fanned out to all."""
    key = F.md5(F.concat_ws("|", "game", "language", "text", F.coalesce("card_number", F.lit("")), F.coalesce(F.col("set_total").cast("string"), F.lit(""))))
    keyed = queries.withColumn("key", key)
    once = keyed.groupBy("key").agg(F.min("query_id").alias("query_id"))
    hits = name_search(keyed.drop("key").join(once.select("query_id"), "query_id", "left_semi"), catalog)
    return keyed.select("key", F.col("query_id").alias("id")).join(once, "key").join(hits, "query_id").select(F.col("id").alias("query_id"), "card_id", "rank")


def parse_query(text: Column) -> Column:
    """struct(tokens, excluded, number, name_text, set_hint) of a search text; tokens null if only exclusions are given."""
    words = F.array_remove(F.split(F.lower(F.trim(text)), r"\s+"), "")
    excluded = F.transform(F.filter(words, lambda w: w.startswith("-") & (F.length(w) > 1)), lambda w: F.substring(w, F.lit(2), F.length(w)))
    plain = F.filter(words, lambda w: ~w.startswith("-"))
    last = F.try_element_at(plain, F.lit(-1))
    number = F.when(last.rlike("^[0-9]+$"), last)
    tokens = F.when(number.isNotNull(), F.slice(plain, F.lit(1), F.greatest(F.size(plain) - 1, F.lit(0)))).otherwise(plain)
    nothing = (F.size(tokens) == 0) & number.isNull()
    return F.struct(F.when(~nothing, tokens).alias("tokens"), excluded.alias("excluded"), number.alias("number"), F.when(F.size(tokens) > 0, F.array_join(tokens, " ")).otherwise(F.lower(F.trim(text))).alias("name_text"), F.when(F.size(tokens) >= 2, F.array_join(F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))), " ")).alias("set_hint"))


def search_candidates(needles: DataFrame, kinds: DataFrame, grams: Grams, by_name: float, by_set: float) -> DataFrame:
    """The pairs of a needle and a kind of card (``name, name_ja, set_name``) of which one text may be similar enough to the needle, each once.

    Either bound is a similarity join of its own over distinct texts; only texts that pass it fan out to kinds."""
    found = None
    for field, least in (("name", by_name), ("name_ja", by_name), ("set_name", by_set)):
        pairs = similar_pairs(needles, getattr(grams, field), least).withColumnRenamed("name", field).drop("sim")
        own = kinds.filter("language = 'ja'") if field == "name_ja" else kinds
        own = pairs.join(own, [*KEY, field]).select(*KEY, "needle", "name", "name_ja", "set_name")
        found = own if found is None else found.unionByName(own)
    return found.distinct()


def catalog_search(queries: DataFrame, catalog: DataFrame, k: int = 20, grams: Grams | None = None) -> DataFrame:
    """Scored catalogue search, ``query_id, card_id, score, rank``.

    A card counts if its name (or second-language name) is similar to the text by more than 0.1, or its set by more than 0.2. Scores are worked out
    once for each pair of a distinct query text and a distinct (name, second name, set) that passes one of these bounds.
    """
    q = queries.select("query_id", *KEY, parse_query(F.col("text")).alias("p")).select("query_id", *KEY, "p.*").filter("tokens IS NOT NULL")
    kinds = catalog.select(*KEY, "name", "name_ja", "set_name").distinct()
    texts = q.select(*KEY, "name_text", "tokens", "set_hint").distinct()
    near = search_candidates(texts.select(*KEY, F.col("name_text").alias("needle")), kinds, grams or Grams.of(catalog), 0.1, 0.2)
    pairs = texts.join(near.withColumnRenamed("needle", "name_text"), [*KEY, "name_text"])
    ja = F.when(F.col("language") == "ja", F.coalesce(similarity(F.col("name_ja"), F.col("name_text")), F.lit(0.0))).otherwise(0.0)
    pairs = pairs.withColumn("by_name", F.greatest(similarity(F.col("name"), F.col("name_text")), ja)).withColumn("by_set", similarity(F.col("set_name"), F.col("name_text"))).filter("by_name > 0.1 OR by_set > 0.2")
    many = F.size("tokens") >= 2
    first = similarity(F.col("tokens")[0], F.split(F.lower("name"), " ")[0])
    score = F.when(many, F.col("by_name") * first + 0.5 * word_similarity(F.col("set_hint"), F.col("set_name"))).otherwise(F.col("by_name"))
    pairs = pairs.withColumn("score", F.round(F.greatest(score, 0.6 * F.col("by_set")), 6)).select(*KEY, "name_text", "name", F.coalesce("name_ja", F.lit("")).alias("nj"), "set_name", "score").distinct()
    # searches with a number meet the first cards of that number, the others the first of all; these rank alike within a kind
    kind = [*KEY, "name", "nj", "set_name"]
    rows = catalog.select("card_id", *KEY, "name", F.coalesce("name_ja", F.lit("")).alias("nj"), "set_name", F.substring_index("card_number", "/", 1).alias("head"))
    first_of = lambda by: top(rows, [*kind, *by], [F.asc("card_id")], k).drop("rank").withColumn("numbered", F.lit(bool(by)))
    first_cards = first_of(["head"]).unionByName(first_of([]).withColumn("head", F.lit("")))
    search = [*KEY, "name_text", "number", "excluded"]
    asked = q.select(*search).distinct().withColumn("numbered", F.col("number").isNotNull()).withColumn("head", F.coalesce("number", F.lit("")))
    hits = asked.join(pairs, [*KEY, "name_text"]).filter(~F.exists("excluded", lambda e: F.contains(F.lower("name"), e) | F.contains(F.lower("set_name"), e)))
    hits = top(hits.join(first_cards, [*kind, "numbered", "head"]), search, [F.desc("score"), F.asc("card_id")], k)
    return fan_out(q.select("query_id", *search), hits, search).select("query_id", "card_id", "score", "rank")
