"""Line dedup by overlapping windows of three consecutive lines.

Lines without a word are left alone and skipped when windows are formed. A window's key is 96 bits of hash; of all windows with one
key the first by (doc_id, row, line) stays, the later ones are removed: their positions are merged and the lines at them dropped.

Every row gets a number of its own when the texts are written to the shared folder, together with the hashes of their lines, so each
text is parsed once and rows are told apart whatever repeats in them. The first window of a key is found in two steps, in parts of the
rows and then among the parts' first ones, so that a passage that very many rows share is no single task's.

Defined cases: null text is empty; texts under three lines with a word have no window and stay whole; a null ``doc_id`` sorts first;
rows that repeat a ``doc_id`` are separate texts, in the order of the input's files: of two equal ones the later loses its windows, and
a line that stands in no repeated window stays; empty tables give empty results; further columns are ignored by :func:`dedup_lines`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, scratch, texts

WINDOW = 3
BLANKS = " \t\n\x0b\x0c\r"


def worded(line: Column) -> Column:
    return F.ltrim(line, F.lit(BLANKS)) != ""


def _with(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` worked out once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def numbered(docs: DataFrame) -> DataFrame:
    """``row, doc_id, text, n_lines, keys``, written and read back; ``keys`` has two hashes of each line with a word."""
    lines = F.filter(F.split("text", "\n"), worded)
    keys = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.hash(x).alias("b")))
    d = texts(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", keys.alias("keys"))
    path = scratch(docs.sparkSession, "lines")
    d.write.parquet(path)
    return docs.sparkSession.read.parquet(path).withColumn("n_lines", F.size("keys").cast("long"))


def windows(rows: DataFrame) -> DataFrame:
    """``row, doc_id, pos, h1, h2``: every window; ``pos`` counts lines with a word."""
    of = lambda i, name: [F.get("keys", i + k)[name] for k in range(WINDOW)]
    each = F.transform(F.sequence(F.lit(0), F.size("keys") - WINDOW), lambda i: F.struct(i.alias("pos"), F.xxhash64(*of(i, "a")).alias("h1"), F.hash(*of(i, "b")).alias("h2")))
    return rows.filter(F.size("keys") >= WINDOW).select("row", "doc_id", F.inline(each))


def later(w: DataFrame) -> DataFrame:
    """``row, pos`` of the windows that are not the first of their key."""
    parts, place = partitions(w.sparkSession), ["doc_id", "row", "pos"]
    w = w.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)))
    w = w.withColumn("late", F.row_number().over(Window.partitionBy("h1", "h2", "part").orderBy(*place)) > 1)
    # windows already found late need no common place
    w = w.withColumn("part", F.when(F.col("late"), F.col("part")).otherwise(-1))
    return w.withColumn("nth", F.row_number().over(Window.partitionBy("h1", "h2", "part").orderBy(*place))).filter("late OR nth > 1").select("row", "pos")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_removed, text`` for every row: lines with a word, how many of them went, and the text that is left."""
    rows = numbered(docs)
    gone = later(windows(rows)).groupBy("row").agg(F.collect_list("pos").alias("starts"))
    gone = gone.select("row", F.array_distinct(F.flatten(F.transform("starts", lambda p: F.sequence(p, p + (WINDOW - 1))))).alias("gone"))
    every = lambda x: F.sequence(F.lit(0), F.size(x) - 1)

    def rest(lines: Column) -> Column:
        own = F.filter(every(lines), lambda i: worded(F.get(lines, i)))
        out = _with(own, lambda o: F.transform("gone", lambda j: F.get(o, j)))
        return F.array_join(F.transform(F.array_except(every(lines), out), lambda i: F.get(lines, i)), "\n")

    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(_with(F.split("text", "\n"), rest))
    return rows.select("row", "doc_id", "text", "n_lines").join(gone, "row", "left").select("doc_id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), kept.alias("text"))


def digest(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars_kept"), F.md5("text").alias("kept_md5"))


SQL = r"""
WITH l AS (SELECT doc_id, i, ls[i] AS line, regexp_matches(ls[i], '[^\x20\x09-\x0D]') AS worded FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
n AS (SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM l WHERE worded),
w AS (SELECT doc_id, pos, line || chr(10) || lead(line) OVER v || chr(10) || lead(line, 2) OVER v AS k FROM n WINDOW v AS (PARTITION BY doc_id ORDER BY pos)),
later AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS r FROM w WHERE k IS NOT NULL) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS pos FROM later),
s AS (SELECT l.doc_id, l.i, l.line, l.worded, gone.pos IS NOT NULL AS out FROM l LEFT JOIN n USING (doc_id, i) LEFT JOIN gone ON gone.doc_id = n.doc_id AND gone.pos = n.pos),
t AS (SELECT doc_id, count(*) FILTER (worded) AS n_lines, count(*) FILTER (out) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT out), '') AS text FROM s GROUP BY doc_id)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_removed::BIGINT AS n_removed, length(text)::BIGINT AS n_chars_kept, md5(text) AS kept_md5 FROM t
"""
