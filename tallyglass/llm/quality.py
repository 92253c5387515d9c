"""Quality rules: a threshold table compiled into one projection of built-in expressions.

Rows: one per input row. A null text counts as empty (no words, ``base_failed``); a null ``doc_id`` is kept as null; repeated
rows are judged each on their own; an empty table gives an empty result; further columns of the input are ignored by
:func:`measure` and passed through by :func:`keep_good`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, texts

#: Windows of a text up to which their places share the 64 bits of their hashes: 50 bits are left at least, as many as tell 8,192 windows
#: apart but for one text in 30 million.
LONG = 1 << 13
BLANKS = " \t\n\x0b\x0c\r"
#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in a is that it for on was as with be by this are or an at from "
    "der die das und den von zu ist ein im mit sich auf für nicht dem des eine als auch "
    "de la le et les des en un une du que est pour dans qui sur pas au par il "
    "el los las y del se con una su para es al lo como más o"
).split()

#: (rule, ratio, least, most); None leaves a side open. A document is kept if every ratio lies within its bounds.
THRESHOLDS = [
    ("word_count", "n_words", 50, None),
    ("repeated_words", "repeat_ratio", None, 0.5),
    ("word_length", "mean_word_length", 2.0, 12.0),
    ("symbols", "symbol_ratio", None, 0.1),
    ("stop_words", "stop_ratio", 0.02, None),
    ("duplicate_lines", "dup_line_ratio", None, 0.4),
]


def measure(docs: DataFrame) -> DataFrame:
    """Counts and ratios of every whole text.

    A repeated three-word window is found by its 64-bit hash: the hashes, with the low bits replaced by the position, are
    sorted as plain longs, and neighbours that agree above those bits are the repeats. Texts of more than ``LONG`` words, of whose hashes
    too few bits would be left, have them sorted whole with the position beside. All work stays inside the row.
    """
    return _measure_text(texts(docs), ["doc_id"])


def _measure_text(d: DataFrame, carried: list[str]) -> DataFrame:
    d = d.select(
        *carried,
        F.array_remove(F.split("text", f"{SPACE}+"), "").alias("words"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: F.ltrim(x, F.lit(BLANKS)) != "").alias("lines"),
    )
    n = F.size("words")
    d = d.select(
        *carried,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop"),
        F.ceil(F.log2(n + 1)).cast("int").alias("bits"),
        F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))).alias("windows"),
    )
    d = d.withColumn("repeats", F.size("windows") > F.size(F.array_distinct("windows")))
    short = F.col("repeats") & (F.size("windows") <= LONG)
    d = d.withColumn("sorted", F.when(short, F.sort_array(F.transform("windows", lambda h, i: F.call_function("shiftleft", h, F.col("bits")).bitwiseOR(i.cast("long"))))))
    d = d.withColumn("sorted_long", F.when(F.col("repeats") & (F.size("windows") > LONG), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i")))))).drop("windows")

    def repeated(name: str, of) -> Column:
        """Places in the sorted array whose neighbour is equal."""
        same = lambda i, j: F.coalesce(of(F.get(name, i)) == of(F.get(name, j)), F.lit(False))
        return F.filter(F.sequence(F.lit(0), F.size(name) - 1), lambda i: same(i, i - 1) | same(i, i + 1))

    low = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits")) - 1
    starts = F.transform(repeated("sorted", lambda x: F.call_function("shiftright", x, F.col("bits"))), lambda i: F.get("sorted", i).bitwiseAND(low))
    starts_long = F.transform(repeated("sorted_long", lambda x: x["h"]), lambda i: F.get("sorted_long", i)["i"])
    d = d.withColumn("starts", F.when(F.col("sorted").isNotNull(), starts).when(F.col("sorted_long").isNotNull(), starts_long))
    covered = F.size(F.array_distinct(F.concat("starts", F.transform("starts", lambda p: p + 1), F.transform("starts", lambda p: p + 2))))
    d = d.withColumn("n_repeat_words", F.when(F.col("repeats"), covered).otherwise(0).cast("long"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    # The counts leave through a generator: a caller's filter on them stays above it, where a projection would be copied into the filter.
    counts = F.struct(
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share("word_chars", "n_words").alias("mean_word_length"), share("n_symbols", "n_words").alias("symbol_ratio"), share("n_stop", "n_words").alias("stop_ratio"),
        share("n_dup_lines", "n_lines").alias("dup_line_ratio"), share("n_repeat_words", "n_words").alias("repeat_ratio"),
    )
    return d.select(*carried, F.explode(F.array(counts)).alias("counts")).select(*carried, "counts.*")


def broken(thresholds=THRESHOLDS) -> Column:
    """The names of the rules that a row breaks, as an array."""
    tests = []
    for rule, ratio, least, most in thresholds:
        bad = F.lit(False)
        if least is not None:
            bad = bad | (F.col(ratio) < least)
        if most is not None:
            bad = bad | (F.col(ratio) > most)
        tests.append(F.when(bad, F.lit(rule)))
    return F.array_compact(F.array(*tests))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """Counts, the base verdict, the table's verdict (``kept``) and the rules broken, for every document."""
    d = measure(docs).withColumn("base_failed", base_failed()).withColumn("rules", broken(thresholds))
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size("rules") == 0)).alias("kept"), F.array_join("rules", ",").alias("failed_rules"),
    )


def keep_good(docs: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """The input rows, with all their columns, that pass. Everything happens in one pass over the rows, without a shuffle."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    d = _measure_text(docs.select(row.alias("row"), F.coalesce("text", F.lit("")).alias("text")), ["row"]).withColumn("rules", broken(thresholds))
    # A filter here would be pushed below the projections, which copies their expressions into it; a generator is not.
    good = F.when(~base_failed() & (F.size("rules") == 0), F.array("row"))
    return d.select(F.explode(good).alias("row")).select("row.*")
