"""Shared column expressions and their DuckDB texts: trigram similarity, vectors, hashes, slugs."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trigrams(s: Column) -> Column:
    """Distinct trigrams of the words of letters and digits, two blanks before each word and one after it."""
    words = F.regexp_extract_all(F.lower(s), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigrams_sql(s: str) -> str:
    return rf"list_distinct(flatten(list_transform(regexp_extract_all(lower({s}), '[\p{{L}}\p{{N}}]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def share(a: Column, b: Column) -> Column:
    """Shared over all of two sets of trigrams."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every > 0, both / every).otherwise(F.lit(0.0))


def share_sql(a: str, b: str) -> str:
    return f"coalesce(len(list_intersect({a}, {b})) / nullif(len({a}) + len({b}) - len(list_intersect({a}, {b})), 0), 0)"


def similarity(a: Column, b: Column) -> Column:
    return share(trigrams(a), trigrams(b))


def ordered_trigrams(s: Column) -> Column:
    words = F.regexp_extract_all(F.lower(s), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))))


def word_similarity(a: Column, b: Column) -> Column:
    """The greatest share of a's trigrams with any continuous extent of b's ordered trigrams."""
    ta, tb = trigrams(a), ordered_trigrams(b)
    n = F.size(tb)

    def best_from(i):
        return F.array_max(F.transform(F.sequence(i, n), lambda j: share(ta, F.array_distinct(F.slice(tb, i, j - i + 1)))))

    return F.when((n > 0) & (F.size(ta) > 0), F.array_max(F.transform(F.sequence(F.lit(1), n), best_from))).otherwise(F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def hamming_hex(a: Column, b: Column) -> Column:
    """Differing bits of two hexadecimal hashes of 16 digits, taken as two halves; 999 if one is null."""

    def half(x, at):
        return F.conv(F.substring(x, at, 8), 16, 10).cast("long")

    d = F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9)))
    return F.coalesce(d, F.lit(999)).cast("int")


def strip_zeros(s: Column) -> Column:
    """Leading zeros dropped; '0' if nothing is left."""
    t = F.regexp_replace(s, "^0+", "")
    return F.when(s.isNull(), None).when(t == "", "0").otherwise(t)


def _plain_letters() -> tuple[str, str, dict[str, str]]:
    """What compatibility decomposition leaves of each character among a-z, 0-9, blanks and hyphens: (single characters, what becomes of each, those
    that become several). White space beyond ASCII becomes a blank. Whatever leaves nothing is dropped by the slug itself."""
    single, several = {}, {}
    for code in [*range(0x1C, 0x20), *range(0x80, 0xD800), *range(0xF900, 0x20000)]:
        c = chr(code)
        left = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        left = re.sub(r"[^a-z0-9 -]", "", re.sub(r"\s", " ", left))
        if len(left) == 1:
            single[c] = left
        elif left:
            several[c] = left
    return "".join(single), "".join(single.values()), several


_FROM, _TO, _SEVERAL = _plain_letters()


def slug(s: Column) -> Column:
    """Lower-case letters and digits joined by hyphens, accents and other forms of letters made plain."""
    low = F.lower(s)
    each = F.create_map(*[F.lit(x) for pair in _SEVERAL.items() for x in pair])
    long = F.array_join(F.transform(F.split(low, ""), lambda c: F.coalesce(each[c], c)), "")
    plain = F.translate(F.when(low.rlike("[" + "".join(_SEVERAL) + "]"), long).otherwise(low), _FROM, _TO)
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^a-z0-9\s-]", ""), r"[\s-]+", "-"), F.lit("-"))


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def two_places(x: Column) -> Column:
    """A number of moderate size with two places, rounded by its exact binary value, half to even, as printf does; Java rounds the shortest decimal text half up.

    Twice the hundredths are taken from two halves of the digits, of which each product is exact, so the sign of the distance to the middle is too."""
    a = F.abs(x)
    high = a.cast("float").cast("double")
    whole = F.floor(a * 100)
    beyond = (high * 200 - (2 * whole + 1)) + (a - high) * 200
    n = whole + F.when((beyond > 0) | ((beyond == 0) & (whole % 2 == 1)), 1).otherwise(0)
    return F.concat(F.when(x < 0, "-").otherwise(""), F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))


def top(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with their rank from 1."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)
