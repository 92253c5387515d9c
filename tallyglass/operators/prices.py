"""Prices from landed pages: keys, extraction, sales, history, freshness, conversion. Pages are text; nothing is fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import half_up, slug, strip_zeros, top

#: Page-path prefix by language, and the part of the path that names a variant.
PREFIX = {"en": "pokemon-", "ja": "pokemon-japanese-"}
VARIANTS = {"1st_edition": "-1st-edition", "shadowless": "-shadowless", "poke_ball": "-poke-ball", "master_ball": "-master-ball"}
#: Marketplaces preferred as a sale's link.
MARKETS = "ebay\\.|tcgplayer\\.|mercari\\.|yahoo\\."
#: Sale classes by title.
GRADED = r"(?i)\b(PSA|BGS|CGC|SGC|graded?)\b"
BALLS = r"(?i)pok[eé][\s-]?ball|master[\s-]?ball"


def grade_pattern(grade: int) -> str:
    more = r"|gem[\s-]?mint" if grade == 10 else ""
    return rf"(?i)\b(PSA|BGS|CGC|SGC)[\s-]?{grade}\b|graded?\s*{grade}\b|\b{grade}\.0\b{more}"


def page_keys(cards: DataFrame, alias: DataFrame, language: str | None = None, variant: str = "normal", scan_type: str = "card") -> DataFrame:
    """``card_id, page, cache_key``: page path and cache key per card; null where set or number is missing.

    ``alias(set_name, language, alias)`` replaces a set's slug. With ``language`` 'ja', second-language rows use their own number, others the
    scanned one. A stored page is used only for the normal variant in the card's own language.
    """
    lang = F.lit(language) if language else F.col("language")
    a = alias.select(F.col("set_name").alias("a_set"), F.col("language").alias("a_lang"), "alias")
    j = cards.withColumn("price_lang", lang).join(F.broadcast(a), (F.col("set_name") == F.col("a_set")) & (F.col("price_lang") == F.col("a_lang")), "left")
    number = F.when((F.col("price_lang") == "ja") & (F.col("language") != "ja"), F.coalesce("scanned_number", "card_number")).otherwise(F.col("card_number")) if language == "ja" else F.col("card_number")
    number = strip_zeros(F.split(number, "/")[0])
    prefix = F.when(F.col("price_lang") == "ja", PREFIX["ja"]).otherwise(PREFIX["en"])
    built = F.concat(F.lit("game/"), prefix, F.coalesce("alias", slug(F.col("set_name"))), F.lit("/"), slug(F.col("name")), F.lit(VARIANTS.get(variant, "") + "-"), number)
    page = built if variant != "normal" or language == "ja" else F.coalesce("stored_page", built)
    key = F.concat_ws("_", F.try_element_at(F.split("page", "/"), F.lit(-2)), F.try_element_at(F.split("page", "/"), F.lit(-1)))
    return j.withColumn("page", page).select("card_id", "page", F.when(F.col("page").isNotNull(), F.concat(key, F.lit(f":{scan_type}:"), "price_lang")).alias("cache_key"))


def plain(html: Column) -> Column:
    return F.trim(F.regexp_replace(html, "<[^>]*>", ""))


def money(text: Column) -> Column:
    """Digits and dots of a text as a number; null if that is none."""
    return F.regexp_replace(text, "[^0-9.]", "").try_cast("double")


def opens(tag: str, attribute: str, value: str) -> str:
    """A pattern of a start tag with this value among others of the attribute: quotes of either kind or none, attributes in any order and case."""
    return rf"""(?is)<{tag}\b[^>]*?\s{attribute}\s*=\s*(?:"(?:[^"]*\s)?{value}(?:\s[^"]*)?"|'(?:[^']*\s)?{value}(?:\s[^']*)?'|{value}(?=[\s>]))[^>]*>"""


#: The target of a link, quoted in either way or not.
HREF = r"""(?i)<a\b[^>]*?\shref\s*=\s*["']?((?<=")[^"]*|(?<=')[^']*|[^\s"'>]+)"""


def cell_price(cell: Column) -> Column:
    """The accepted offer if the cell has one, else the text without a listed price."""
    offer = F.regexp_extract(cell, opens("span", "title", "best offer accepted price") + "(.*?)</span>", 1)
    rest = F.regexp_replace(cell, opens("span", "class", "listed-price-inline") + ".*?</span>", "")
    return money(plain(F.when(offer != "", offer).otherwise(rest)))


def rows_of(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))


def cells_of(row: Column, tags: str = "t[dh]") -> Column:
    return F.regexp_extract_all(row, F.lit(rf"(?is)<{tags}\b[^>]*>(.*?)</{tags}>"), F.lit(1))


def extract_prices(pages: DataFrame) -> DataFrame:
    """``page_id, ungraded, grade_7, grade_8, grade_9, grade_10`` from the price table; the last row of a label wins; ungraded falls back to its own element.

    A row for each row of ``pages``, worked out within it: no page is shuffled or sorted."""
    body = F.regexp_extract("html", opens("[a-z]+", "id", "full-prices") + "(.*?)</table>", 1)
    cells = F.filter(F.transform(rows_of(body), lambda x: cells_of(x)), lambda c: F.size(c) >= 2)
    r = pages.select("page_id", "html", F.transform(cells, lambda c: F.struct(F.lower(plain(c[0])).alias("label"), cell_price(c[1]).alias("price"))).alias("rows"))
    names = {"ungraded": "ungraded", "grade 7": "grade_7", "grade 8": "grade_8", "grade 9": "grade_9", "psa 10": "grade_10"}
    last = lambda k: F.try_element_at(F.filter("rows", lambda x: x["label"] == k), F.lit(-1))["price"]
    spare = cell_price(F.regexp_extract("html", opens("([a-z]+)", "id", "used_price") + r"(.*?)</\1>", 2))
    return r.select("page_id", *[(F.coalesce(last(k), spare) if v == "ungraded" else last(k)).alias(v) for k, v in names.items()])


def extract_history(pages: DataFrame) -> DataFrame:
    """``page_id, series, month, price`` from the embedded series; zero prices are skipped, text that is no JSON gives none."""
    text = F.regexp_extract("html", r"(?s)VGPC\.chart_data\s*=\s*(\{.*?\});", 1)
    s = pages.select("page_id", F.from_json(text, "used array<array<bigint>>, graded array<array<bigint>>").alias("c"))
    e = s.select("page_id", F.explode(F.array(F.struct(F.lit("used").alias("series"), F.col("c.used").alias("p")), F.struct(F.lit("graded").alias("series"), F.col("c.graded").alias("p")))).alias("x")).select("page_id", "x.series", F.posexplode("x.p").alias("at", "p"))
    return e.filter("p[1] <> 0").select("page_id", "series", "at", F.date_format(F.timestamp_millis(F.col("p")[0]), "yyyy-MM").alias("month"), F.round(F.col("p")[1] / 100, 2).alias("price"))


def repair_url(href: Column) -> Column:
    return F.when(href.rlike("^https?://"), href).when(href.startswith("https//"), F.concat(F.lit("https://"), F.substr(href, F.lit(8)))).when(href.startswith("http//"), F.concat(F.lit("http://"), F.substr(href, F.lit(7)))).when(href.startswith("//"), F.concat(F.lit("https:"), href)).when(href.startswith("/"), F.concat(F.lit("https://prices.example"), href)).otherwise(F.concat(F.lit("https://prices.example/"), href))


#: The classes of a sale table, in any order, quoted or not.
SALES = r"""(?is)<table\b(?=[^>]*\bhoverable-rows\b)(?=[^>]*\bsortable\b)[^>]*>"""


def extract_sales(pages: DataFrame) -> DataFrame:
    """``page_id, at, date_text, title, price, url``: all rows of four cells or more of the sale tables; a marketplace's link first, else the title's unless it is a set listing."""
    tables = F.regexp_extract_all("html", F.lit(SALES + "(.*?)</table>"), F.lit(1))
    r = pages.select("page_id", F.posexplode(F.flatten(F.transform(tables, rows_of))).alias("at", "row"))
    # through a generator: a filter on the cells would be pushed below them and find them again
    cells = F.filter(F.array(cells_of(F.col("row"), "td")), lambda c: F.size(c) >= 4)
    r = r.select("page_id", "at", "row", F.explode(cells).alias("cells"))
    links = lambda x: F.transform(F.regexp_extract_all(x, F.lit(HREF), F.lit(1)), repair_url)
    market = F.get(F.filter(links(F.col("row")), lambda u: u.rlike(MARKETS)), F.lit(0))
    own = F.get(links(F.col("cells")[2]), F.lit(0))
    return r.select("page_id", "at", plain(F.col("cells")[0]).alias("date_text"), plain(F.col("cells")[2]).alias("title"), cell_price(F.col("cells")[3]).alias("price"), F.coalesce(market, F.when(~F.contains(own, F.lit("/console/")), own)).alias("url"))


def date_key(text: Column) -> Column:
    """A text in one of four date formats as yyyy-MM-dd; any other text as it is."""
    day = lambda form, like: F.when(text.rlike(like), F.to_date(F.try_to_timestamp(text, F.lit(form))).cast("string"))
    return F.coalesce(day("yyyy-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$"), day("M/d/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"), day("MMM d, yyyy", r"^[A-Za-z]{3} \d{1,2}, \d{4}$"), day("MMMM d, yyyy", r"^[A-Za-z]{4,} \d{1,2}, \d{4}$"), text)


def recent_sales(sales: DataFrame, ungraded: DataFrame, n: int = 10, tie: tuple[str, ...] = ("l_orderkey", "l_linenumber", "l_suppkey")) -> DataFrame:
    """The newest n sales of each card, page order at ties; all dropped if none has a link and the card has no ungraded price."""
    r = top(sales.withColumn("key", date_key(F.col("date_text"))), ["card_id"], [F.desc("key"), *map(F.asc, tie)], n)
    r = r.withColumn("links", F.count("href").over(Window.partitionBy("card_id"))).join(ungraded.select("card_id", "ungraded"), "card_id", "left")
    return r.filter("ungraded IS NOT NULL OR links > 0").select("card_id", *tie, "rank", "date_text", "title", "href")


def extract_search_hits(pages: DataFrame, n: int = 20) -> DataFrame:
    """``page_id, at, title, url, hit_id, price1, price2, price3, console`` of the first n result rows."""
    body = F.regexp_extract("html", opens("table", "id", "games_table") + "(.*?)</table>", 1)
    r = pages.select("page_id", F.posexplode(F.filter(rows_of(body), lambda x: x.rlike(opens("td", "class", "title")))).alias("at", "row")).filter(F.col("at") < n)
    cell = lambda c: F.regexp_extract("row", opens("td", "class", c) + "(.*?)</td>", 1)
    url = repair_url(F.regexp_extract(cell("title"), HREF, 1))
    return r.select("page_id", "at", plain(cell("title")).alias("title"), url.alias("url"), F.try_element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), F.lit(-1)).alias("hit_id"), *[cell_price(cell(f"price{k}")).alias(f"price{k}") for k in (1, 2, 3)], plain(cell("console")).alias("console"))


#: Certificate fields by label pattern.
CERTIFICATE = {"name": "subject|player|name", "grade": "grade", "set_name": "set|brand", "year": "year", "variety": "variety|pedigree", "higher": "higher", "population": "population|^pop"}


def extract_certificates(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages``: label and value pairs into fields by label pattern, the first pair of a field; counts keep digits only; a heading stands in for the name.

    It is worked out within the row: no page is shuffled or sorted."""
    every = lambda tag: F.regexp_extract_all("html", F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1))
    pairs = F.transform(F.arrays_zip(every("dt").alias("label"), every("dd").alias("value")), lambda p: F.struct(F.lower(plain(p["label"])).alias("label"), plain(p["value"]).alias("value")))
    field = lambda label: F.coalesce(*[F.when(label.rlike(pattern), F.lit(name)) for name, pattern in CERTIFICATE.items()])
    r = pages.select("page_id", "html", F.transform(pairs, lambda p: F.struct(field(p["label"]).alias("field"), p["value"].alias("value"))).alias("pairs"))
    first = lambda f: F.get(F.filter("pairs", lambda p: p["field"] == f), F.lit(0))["value"]
    g = r.select("page_id", "html", *[first(f).alias(f) for f in CERTIFICATE])
    heading = plain(F.regexp_extract("html", r"(?is)<h1\b[^>]*>(.*?)</h1>", 1))
    number = lambda c: F.regexp_replace(c, "[^0-9]", "").try_cast("int")  # noqa: E731  a count of any length stops no job
    return g.select("page_id", F.coalesce("name", F.when(heading != "", heading)).alias("name"), "grade", "set_name", "year", "variety", number(F.col("population")).alias("population"), number(F.col("higher")).alias("higher"))


def freshness(cards: DataFrame, cache: DataFrame, now: Column, force: bool = False, hours: int = 24, missing_hours: int = 1) -> DataFrame:
    """``card_id, state, fetch``: by the latest cached entry, fresh, known missing, expired or never. ``cache(card_id, cached_at, price)``; a null price is a miss."""
    last = cache.filter("card_id IS NOT NULL").groupBy("card_id").agg(F.max_by(F.struct("cached_at", "price"), F.struct("cached_at", "id")).alias("c"))
    j = cards.select("card_id").join(last, "card_id", "left")
    age = F.unix_timestamp(now) - F.unix_timestamp(F.col("c.cached_at").cast("timestamp"))
    miss = F.col("c.price").isNull()
    state = F.when(F.col("c").isNull(), "never").when(miss & (age < missing_hours * 3600), "missing").when(~miss & (age < hours * 3600), "fresh").otherwise("expired")
    return j.withColumn("state", state).select("card_id", "state", (F.lit(force) | F.col("state").isin("never", "expired")).alias("fetch"))


def batch_prices(requests: DataFrame, cards: DataFrame, prices: DataFrame, cap: int = 25) -> DataFrame:
    """``request_id, at, card_id, status, price``: ids of a request deduped in order and capped; ids that no card has are reported."""
    first = requests.groupBy("request_id", "card_id").agg(F.min("at").alias("at"))
    kept = top(first, ["request_id"], [F.asc("at"), F.asc("card_id")], cap)
    j = kept.join(cards.select("card_id", F.lit(True).alias("known")), "card_id", "left").join(prices.select("card_id", "price"), "card_id", "left")
    return j.select("request_id", F.col("rank").alias("at"), "card_id", F.when(F.col("known").isNull(), "not_found").otherwise("ok").alias("status"), F.when(F.col("known"), F.col("price")).alias("price"))


def batch_prices_slim(requests: DataFrame, cards: DataFrame, prices: DataFrame, sales: DataFrame, cap: int = 25, n: int = 3) -> DataFrame:
    """:func:`batch_prices` in its slim form: the current prices and the first ``n`` sales, no histories, as one struct.

    ``prices(card_id, ...)``: every further column of it is a field; ``sales(card_id, rank, ...)``.
    """
    kept = batch_prices(requests, cards, prices.select("card_id", F.lit(None).cast("double").alias("price")), cap).drop("price")
    fields = [c for c in sales.columns if c != "card_id"]
    few = sales.filter(F.col("rank") <= n).groupBy("card_id").agg(F.sort_array(F.collect_list(F.struct("rank", *[c for c in fields if c != "rank"]))).alias("recent_sales"))
    known = prices.select("card_id", F.struct(*[c for c in prices.columns if c != "card_id"]).alias("now"))
    j = kept.join(known, "card_id", "left").join(few, "card_id", "left")
    sold = F.coalesce("recent_sales", F.array().cast(few.schema["recent_sales"].dataType))
    price = F.when((F.col("status") == "ok") & F.col("now").isNotNull(), F.struct("now.*", sold.alias("recent_sales")))
    return j.select("request_id", "at", "card_id", "status", price.alias("price"))


def classify_sales(sales: DataFrame, variant: str = "normal", n: int = 10, tie: tuple[str, ...] = ("l_orderkey", "l_linenumber", "l_suppkey")) -> DataFrame:
    """The first n sales of each card and class (raw, 7 to 10; a title may be in several)."""
    s = sales if variant != "normal" else sales.filter(~F.col("title").rlike(BALLS))
    found = F.array_compact(F.array(F.when(~F.col("title").rlike(GRADED), F.lit("raw")), *[F.when(F.col("title").rlike(grade_pattern(g)), F.lit(str(g))) for g in (7, 8, 9, 10)]))
    return top(s.withColumn("sale_class", F.explode(found)), ["card_id", "sale_class"], [F.asc(t) for t in tie], n).select("card_id", "sale_class", "rank", *tie, "title")


def convert_currency(prices: DataFrame, rates: DataFrame) -> DataFrame:
    """``card_id, jpy, shown``: by the latest rate, halves up; null prices show as N/A. ``rates(day, rate)``."""
    last = rates.agg(F.max_by("rate", "day").alias("rate"))
    yen = half_up(F.col("price") * F.col("rate")).cast("long")
    return prices.join(F.broadcast(last)).select("card_id", yen.alias("jpy"), F.when(F.col("price").isNull(), "N/A").otherwise(F.concat(F.lit("¥"), F.format_number(yen, 0))).alias("shown"))


def convert_history(history: DataFrame, rates: DataFrame, currency: str = "JPY") -> DataFrame:
    """The points of price histories in another currency: whole yen by the latest rate, halves up; unchanged in USD or without a rate. All columns but ``price`` stay."""
    if currency == "USD":
        return history
    last = rates.agg(F.max_by("rate", "day").alias("_rate"))
    yen = F.when(F.col("_rate").isNull(), F.col("price")).otherwise(half_up(F.col("price") * F.col("_rate")).cast("double"))
    return history.join(F.broadcast(last)).withColumn("price", yen).drop("_rate")


def chart_series(history: DataFrame, n: int = 24) -> DataFrame:
    """The last n points of each series of two or more, a label on every ceil(points / 6)-th, and the axis decimals. ``history(card_id, at, month, price)``."""
    w = Window.partitionBy("card_id")
    r = top(history, ["card_id"], [F.desc("at")], n).withColumn("points", F.count("*").over(w)).withColumn("most", F.max("price").over(w)).filter("points >= 2")
    place = F.col("points") - F.col("rank")
    return r.select("card_id", place.cast("int").alias("place"), "price", F.when(place % F.ceil(F.col("points") / 6) == 0, F.substring("month", 1, 7)).otherwise("").alias("label"), F.when(F.col("most") < 1, 2).when(F.col("most") < 10, 1).otherwise(0).alias("decimals"))


def portfolio_value(items: DataFrame, prices: DataFrame) -> DataFrame:
    """``collection_id, value``: sum of the price of each item's kind (ungraded or grade 10), nulls ignored. ``items(collection_id, card_id, kind)``."""
    j = items.join(prices, "card_id")
    return j.groupBy("collection_id").agg(F.round(F.coalesce(F.sum(F.when(F.col("kind") == "graded", F.col("grade_10")).otherwise(F.col("ungraded"))), F.lit(0.0)), 2).alias("value"), F.count("*").alias("items"))


def link_label(url: Column) -> Column:
    return F.when(F.contains(url, F.lit("tcgplayer")), "TCGPlayer").when(F.contains(url, F.lit("ebay")), "eBay").when(url.isNotNull(), "View")
