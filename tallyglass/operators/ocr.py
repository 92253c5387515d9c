"""OCR text to search hints: numbers, names near anchors, dictionaries, language and a plausibility score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import strip_zeros, top
from .grams import substring_pairs

# The wording that the rules look for.
HP = r"(?i)\bHP\s*(\d+)\b"
NON_NAME = (
    r"\S{0,2}as[in][cgsq]\w*|stage[12]|mega|weakness|resistance|retreat|damage|ability|trainer|item|stadium|supporter|energy|water|fire|grass|lightning|psychic|"
    r"fighting|darkness|metal|fairy|colorless|dragon|pok[eé]mon|nintendo|creatures|game\s*freak|illus\.?|no\.|copyright|overrun|aurora|beam|hp"
)
ATTACK = (
    r"put|this\s+attack|your\s+opponent|you\s+may|flip|discard|search|draw|choose|look\s+at|if\s+your|once\s+during|during\s+your|when\s+you|"
    r"attach|move|switch|return|heal|remove|each\s+of|both\s+player|the\s+defending|does\s+\d+\s+damage"
)
TYPE_LINE = {"en": r"(?i)^(Trainer|Supporter|Item|Tool|Technical\s+Machine)$", "ja": "^(グッズ|サポート|スタジアム|ポケモンのどうぐ)$"}
NOT_NAMES_JA = ["たね", "1進化", "2進化", "ステージ1", "ステージ2"]
CODE = r"(?i)(OP\d{2}-\d{3}|ST\d{2}-\d{3}|P-\d{3})"
KEYWORDS = {"en": r"(?i)\b(weakness|resistance|retreat|basic|stage\s*[12]|trainer|supporter|stadium|item|energy)\b", "ja": "弱点|抵抗力|にげる|逃げる|特性|ワザ|グッズ|サポート|スタジアム|たね|進化"}
RIGHTS = r"(?i)©|\bpokémon\b|\bnintendo\b|\bgame\s*freak\b|\bcreatures\b|\bbandai\b"


def lines_of(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def extract_numbers(df: DataFrame) -> DataFrame:
    """``scan_id, number, total, hp, code``: letters misread for digits are put right where they begin a number."""
    t = F.regexp_replace(F.regexp_replace("raw_text", r"(?<![\p{L}\p{N}_])[oO](?=\d)", "0"), r"(?<![\p{L}\p{N}_])[lI](?=\d)", "1")
    pattern = r"(\d{1,3})\s*/\s*(\d{1,3})"
    found = lambda x: F.when(x != "", x)
    return df.select("scan_id", strip_zeros(found(F.regexp_extract(t, pattern, 1))).alias("number"), strip_zeros(found(F.regexp_extract(t, pattern, 2))).alias("total"), found(F.regexp_extract("raw_text", HP, 1)).alias("hp"), F.upper(found(F.regexp_extract("raw_text", CODE, 1))).alias("code"))


def _plain(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9 ]", ""))


def dictionary_gate(candidates: DataFrame, names: DataFrame) -> DataFrame:
    """``candidates`` with ``known``: whether a word or two adjacent words of ``text`` are a known name. Keyed by (scan_id, pos)."""
    w = F.array_remove(F.split(_plain(F.col("text")), " +"), "")
    pairs = F.when(F.size(w) >= 2, F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))).otherwise(F.array().cast("array<string>"))
    grams = candidates.select("scan_id", "pos", F.explode(F.array_distinct(F.concat(w, pairs))).alias("gram"))
    known = grams.join(names.select(_plain(F.col("name")).alias("gram")).distinct(), "gram", "left_semi").select("scan_id", "pos", F.lit(True).alias("hit")).distinct()
    return candidates.join(known, ["scan_id", "pos"], "left").withColumn("known", F.coalesce("hit", F.lit(False))).drop("hit")


def _wording_ok(text: Column) -> Column:
    """No digits, no punctuation but a possessive, a capital first, not all capitals."""
    bare = F.regexp_replace(text, r"(?<=\w)'s\b", "")
    return ~text.rlike(r"\d") & ~bare.rlike(r"[.,!?;:()/\\']") & text.rlike(r"^\p{Lu}") & ~((F.upper(text) == text) & text.rlike(r"\p{L}") & (F.length(text) > 3))


def find_name(df: DataFrame, names: DataFrame, most: int = 4) -> DataFrame:
    """``scan_id, name``: the first acceptable of the first ``most`` lines, none below the line with HP."""
    d = df.select("scan_id", F.slice(lines_of(F.col("raw_text")), 1, most).alias("l"))
    hp = F.array_position(F.transform("l", lambda x: x.rlike(HP)), True)
    d = d.select("scan_id", hp.alias("hp"), "l", F.posexplode("l").alias("pos", "line")).filter((F.col("hp") == 0) | (F.col("pos") < F.least(F.col("hp"), F.lit(6))))
    text = F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace("line", HP, "")), rf"(?i)^(?:(?:{NON_NAME})(?:\s+|$))+", ""), r"\s+", " "))
    d = d.withColumn("text", text).withColumn("w", F.split("text", " "))
    ok = (F.length("text") >= 3) & (F.size("w") <= 3) & _wording_ok(F.col("text")) & ~F.exists("w", lambda x: x.rlike(rf"(?i)^(?:{NON_NAME})$"))
    ok = ok & ~((F.col("hp") == 0) & F.coalesce(F.get("l", F.col("pos") + 1).rlike(rf"(?i)^(?:{ATTACK})"), F.lit(False)))
    return dictionary_gate(d.filter(ok).select("scan_id", "pos", "text"), names).filter("known").groupBy("scan_id").agg(F.min_by("text", "pos").alias("name"))


def find_name_near_keyword(df: DataFrame, language: str = "en") -> DataFrame:
    """``scan_id, name``: of the two lines above a line that is a type keyword, the first valid one, higher line first."""
    d = df.select("scan_id", lines_of(F.col("raw_text")).alias("l")).select("scan_id", "l", F.posexplode("l").alias("pos", "line")).filter(F.col("line").rlike(TYPE_LINE[language]))
    c = d.select("scan_id", "pos", F.explode(F.array(F.col("pos") - 2, F.col("pos") - 1)).alias("at"), "l").filter("at >= 0").withColumn("text", F.get("l", F.col("at")))
    if language == "ja":
        text = F.trim(F.regexp_replace(F.regexp_replace("text", "\\s*（[^）]*）\\s*$", ""), r"\s*\([^)]*\)\s*$", ""))
        ok = (F.col("text") != "") & ~F.col("text").rlike(TYPE_LINE["ja"]) & F.col("text").rlike("[ぁ-ゖ゠-ヿ一-鿿]")
    else:
        text = F.trim(F.regexp_replace("text", r"\s*\([^)]*\)\s*$", ""))
        ok = (F.length("text") >= 3) & (F.size(F.split("text", r"\s+")) <= 5) & _wording_ok(F.col("text"))
    return c.withColumn("text", text).filter(ok).groupBy("scan_id").agg(F.min_by("text", F.struct("pos", "at")).alias("name"))


def lookup_dictionary(df: DataFrame, entries: DataFrame) -> DataFrame:
    """``scan_id, entry, translation``: whole lines first, then entries inside a line; by line, then by entry. ``entries(entry, translation, dict_pos)``."""
    d = df.select("scan_id", F.posexplode(lines_of(F.col("raw_text"))).alias("pos", "line")).filter(~F.col("line").isin(NOT_NAMES_JA))
    key = [F.lit("").alias("game"), F.lit("").alias("language")]
    inside = substring_pairs(entries.select(*key, F.col("entry").alias("needle")), d.select(*key, F.col("line").alias("name"))).filter(F.contains("name", "needle"))
    j = d.join(inside.select(F.col("name").alias("line"), F.col("needle").alias("entry")), "line").join(entries, "entry")
    best = top(j.withColumn("tier", F.when(F.col("line") == F.col("entry"), 0).otherwise(1)), ["scan_id"], [F.asc("tier"), F.asc("pos"), F.asc("dict_pos")], 1)
    return best.select("scan_id", "entry", "translation")


def build_hints(df: DataFrame, names: DataFrame, entries: DataFrame) -> DataFrame:
    """One hint row per scan ``scan_id, game, language, raw_text``, with a label for display."""
    n = extract_numbers(df)
    first = df.filter("game = 'pokemon' AND language <> 'ja'")
    second = df.filter("game = 'pokemon' AND language = 'ja'")
    own = find_name(first, names).withColumnRenamed("name", "a")
    near = find_name_near_keyword(first).withColumnRenamed("name", "b")
    kana = lookup_dictionary(second, entries).withColumnRenamed("translation", "c")
    near_ja = find_name_near_keyword(second, "ja").withColumnRenamed("name", "t")
    j = df.join(n, "scan_id").join(own, "scan_id", "left").join(near, "scan_id", "left").join(kana, "scan_id", "left").join(near_ja, "scan_id", "left")
    other = F.col("game") == "onepiece"
    name = F.when(other, F.get(lines_of(F.col("raw_text")), F.lit(0))).otherwise(F.coalesce("a", "b", "c"))
    number = F.when(other, F.col("code")).otherwise(F.col("number"))
    trainer = F.when(F.col("entry").isNull(), F.col("t"))
    shown = F.coalesce(name, trainer)
    label = F.when(shown.isNull(), "(unknown)").when(number.isNotNull(), F.concat(shown, F.lit(" #"), number)).otherwise(shown)
    return j.select("scan_id", name.alias("name"), F.col("entry").alias("kana_name"), trainer.alias("ja_trainer_name"), number.alias("card_number"), F.when(~other, F.col("total")).alias("set_total"), F.when(~other, F.col("hp")).alias("hp"), label.alias("label"))


def detect_language(df: DataFrame) -> DataFrame:
    """``scan_id, language, kana, number, total``: two kana in a row make a text second-language; then its longest katakana run and its number."""
    ja = F.col("text").rlike("[゠-ヿぁ-ゖ]{2,}")
    runs = F.regexp_extract_all("text", F.lit("([゠-ヿー]+)"), F.lit(1))
    longest = F.aggregate(runs, F.lit(""), lambda a, x: F.when(F.length(a) >= F.length(x), a).otherwise(x))
    part = lambda k: F.when(ja & F.col("text").rlike(r"\d+/\d+"), F.regexp_extract("text", r"(\d+)/(\d+)", k))
    return df.select("scan_id", F.when(ja, "ja").otherwise("en").alias("language"), F.when(ja & (longest != ""), longest).alias("kana"), part(1).alias("number"), part(2).try_cast("long").alias("total"))


def score_card_text(df: DataFrame) -> DataFrame:
    """``scan_id, score, is_card, reason`` of ``scan_id, text, blocks, game, language``: 0 to 10, accepted from 3."""
    lines = lines_of(F.col("text"))
    n = lambda c, k: F.when(c, k).otherwise(0)
    pokemon, ja = F.col("game") == "pokemon", F.col("language") == "ja"
    numbered = n(pokemon & F.col("text").rlike(r"\b\d{1,3}\s*/\s*\d{2,3}\b"), 3) + n(~pokemon & F.col("text").rlike(r"(?i)\b(OP|ST|P)-?\d{2}-?\d{3}\b"), 3)
    hp = n(pokemon & F.col("text").rlike(r"(?i)\bHP\s*\d+|\d+\s*HP\b"), 2)
    words = F.least(F.size(F.regexp_extract_all("text", F.lit(KEYWORDS["en"]), F.lit(0))), F.lit(2)) + n(F.exists(F.slice(lines, 1, 5), lambda x: x.rlike(r"^[A-Z][a-zA-Z\s\-'.]{1,30}$")), 1)
    words_ja = F.least(F.size(F.regexp_extract_all("text", F.lit(KEYWORDS["ja"]), F.lit(0))), F.lit(2)) + n(F.exists(F.slice(lines, 1, 6), lambda x: x.rlike("[゠-ヿ]{3,}")), 2)
    total = numbered + hp + F.when(ja, words_ja).otherwise(words) + n(F.col("text").rlike(RIGHTS), 1) - n(F.col("blocks") > 20, 1)
    sure = pokemon & F.exists(F.split("text", "\n"), lambda x: x.rlike(TYPE_LINE["en"]))
    score = F.when(sure, 10).otherwise(F.greatest(F.least(total, F.lit(10)), F.lit(0)))
    reason = F.when(score >= 3, None).when(F.size(lines) < 3, "too little text").when(F.col("blocks") > 20, "too many regions").otherwise("no card")
    return df.select("scan_id", score.cast("int").alias("score"), (score >= 3).alias("is_card"), reason.alias("reason"))


def detect_blocked_pages(pages: DataFrame) -> DataFrame:
    """``page_id, outcome`` of ``page_id, status, html``: the first that holds of refused, limited, server error, challenge, cookie gate, short."""
    has = lambda s: F.contains("html", F.lit(s))
    outcome = F.when(F.col("status") == 403, "forbidden").when(F.col("status") == 429, "rate limited").when(F.col("status") >= 500, "server error").when(has("Just a moment") | has("cf-browser-verification"), "challenge").when(has("Enable JavaScript") | has("Please enable cookies"), "cookie gate").when(F.length("html") < 2000, "short").otherwise("ok")
    return pages.select("page_id", outcome.alias("outcome"))


def _unexpected() -> Column:
    """A run failed: refused or not understood, or without a price where one is expected."""
    return F.col("outcome").isin("blocked", "parse error") | ((F.col("outcome") == "no price") & F.col("expected").isNull())


def assess_fetch_runs(results: DataFrame, no_price: DataFrame, runs: int = 3) -> DataFrame:
    """Per item: outcome of each run, counts, and in how many runs it failed unexpectedly. ``results(item, run, outcome)`` with priced, no price, blocked, parse error."""
    g = results.groupBy("item").pivot("run", list(range(1, runs + 1))).agg(F.first("outcome"))
    g = g.select("item", *[F.col(str(r)).alias(f"run_{r}") for r in range(1, runs + 1)])
    marked = results.join(no_price.select("item", F.lit(True).alias("expected")).distinct(), "item", "left")
    c = marked.groupBy("item").agg(*[F.count_if(F.col("outcome") == o).alias(a) for o, a in (("priced", "priced"), ("no price", "no_price"), ("blocked", "blocked"))], F.count_if(_unexpected()).alias("failures"))
    return g.join(c, "item").withColumn("unexpected", F.col("failures") > 0)


def fetch_totals(results: DataFrame, no_price: DataFrame) -> DataFrame:
    """One row: runs with a price, runs of items of which one is expected, items with an unexpected failure."""
    marked = results.join(no_price.select("item", F.lit(True).alias("expected")).distinct(), "item", "left")
    failed = marked.filter(_unexpected()).agg(F.count_distinct("item").alias("failed_items"))
    return marked.agg(F.count_if(F.col("outcome") == "priced").alias("priced"), F.count_if(F.col("expected").isNull()).alias("expected_priced")).join(F.broadcast(failed))
