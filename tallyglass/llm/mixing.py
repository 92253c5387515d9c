"""Mixing sources to target weights by temperature.

Source i with token share p_i gets weight p_i^a / sum_j p_j^a. The exponent a in [0, 1] is the largest whose weights reach the target
entropy, raised if need be until no source is repeated more than ``max_epochs`` times. A budget of tokens is then dealt out:
each source is taken whole as often as its target allows, and the rest comes from one more pass in the order of a keyed
permutation, whose blocks of documents are taken whole up to the one that the target cuts; of that one, the documents up to a key.
So a source's row of the plan (whole passes and the last key drawn) decides for each of its documents how often it is drawn, and
the texts themselves are not joined by document.

Defined cases: null text is empty; a null source is the source ''; documents without a word carry no tokens and are drawn with their
source's passes (a source without a token has none, with ``keep_all`` one); a null ``doc_id`` is drawn like any other; rows that repeat a
``doc_id`` have one place in the permutation and are each drawn or not drawn there together; an empty table gives an empty result;
further columns are ignored by :func:`draw` and kept by :func:`mix`.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, cut, partitions, texts

#: Share of the largest possible entropy to reach, passes over one source at most, budget in times of all tokens.
ENTROPY, MAX_EPOCHS, BUDGET = 0.98, 4.0, 1.0
GRID, ROUNDS = 32, 6
#: Hexadecimal digits of the permutation key that name a block: 4,096 blocks a source.
BLOCK_DIGITS, SEED = 3, "mix-1"
#: A plan of at most so many sources and characters of their names is broadcast. A longer one is joined, in parts of a source's
#: documents, so that a source with most of the rows is no single task's.
FEW_SOURCES, FEW_CHARS, SALTS = 50_000, 4_000_000, 64


def source_tokens(docs: DataFrame) -> DataFrame:
    d = texts(docs, F.coalesce(F.col("source"), F.lit("")).alias("source"))
    return d.select("doc_id", "source", F.size(F.array_remove(F.split("text", f"{SPACE}+"), "")).cast("long").alias("n_tokens"))


def sources(tokens: DataFrame) -> DataFrame:
    return cut(tokens.groupBy("source").agg(F.sum("n_tokens").alias("total")))


def shares(totals: DataFrame) -> tuple[DataFrame, int, int]:
    """(source, total, share) of the sources with a token, their number and all tokens."""
    totals = totals.filter("total > 0")
    n, every = totals.agg(F.count("*"), F.coalesce(F.sum("total"), F.lit(0))).first()
    return totals.withColumn("share", F.col("total") / F.lit(float(every or 1))), n, int(every)


def exponent(shared: DataFrame, n: int, budget: float | None, entropy: float | None, max_epochs: float | None) -> float:
    """The exponent, by repeated bisection into ``GRID`` steps at once: each round is one aggregation over the sources.

    Over 0 <= a <= 1 both entropy and the most repetitions fall as a rises. Without a budget, the source that is repeated least is taken once.
    """

    def search(reached: str) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(ROUNDS):
            grid = [lo + (hi - lo) * k / GRID for k in range(GRID + 1)]
            each = shared.select("share", F.posexplode(F.array(*map(F.lit, grid))).alias("k", "a")).select("k", "a", "share", F.pow("share", F.col("a")).alias("x"))
            sums = each.groupBy("k", "a").agg(F.sum("x").alias("z"), F.sum(F.col("x") * F.log("share")).alias("l"), F.max(F.col("x") / F.col("share")).alias("r"), F.min(F.col("x") / F.col("share")).alias("s"))
            held = {r.k: r.ok for r in sums.select("k", F.expr(reached).alias("ok")).collect()}
            k = next((k for k in range(GRID, -1, -1) if held.get(k)), 0) if "log" in reached else next((k for k in range(GRID + 1) if held.get(k)), GRID)
            if "log" in reached:
                lo, hi = grid[k], grid[min(k + 1, GRID)]
            else:
                lo, hi = grid[max(k - 1, 0)], grid[k]
        return lo if "log" in reached else hi

    a = 1.0
    if n and entropy is not None:
        a = search(f"log(z) - a * l / z >= {entropy * math.log(n)!r}D")
    if n and max_epochs is not None:
        a = max(a if entropy is not None else 0.0, search(f"{budget!r}D * r / z <= {max_epochs!r}D" if budget is not None else f"r / s <= {max_epochs!r}D"))
    return round(a, 9)


def targets(tokens: DataFrame, budget: float = BUDGET, entropy: float | None = ENTROPY, max_epochs: float | None = MAX_EPOCHS, keep_all: bool = False) -> DataFrame:
    """``source, total, weight, passes, rest``: whole passes over a source and the tokens of the pass that is cut.

    With ``keep_all`` the budget is the least that takes every source whole once; sources without a token pass once.
    """
    totals = sources(tokens)
    shared, n, every = shares(totals)
    a = exponent(shared, n, None if keep_all else budget, entropy, max_epochs)
    z = shared.agg(F.sum(F.pow("share", F.lit(a)))).first()[0] or 1.0
    weighted = shared.withColumn("weight", F.pow("share", F.lit(a)) / F.lit(z))
    if keep_all:
        aim = F.pow("share", F.lit(a - 1.0)) * F.col("total") / F.lit(shared.agg(F.min(F.pow("share", F.lit(a - 1.0)))).first()[0] or 1.0)
    else:
        aim = F.col("weight") * F.lit(float(budget * every))
    # a whole number that the order of a sum of doubles puts just below itself is not cut
    target = F.floor(aim + F.greatest(aim * 1e-12, F.lit(1e-6)))
    if keep_all:
        target = F.greatest(target, F.col("total"))
    dealt = weighted.withColumn("target", target).select("source", "total", "weight", F.floor(F.col("target") / F.col("total")).alias("passes"), (F.col("target") % F.col("total")).alias("rest"))
    if not keep_all:
        return dealt
    return dealt.union(totals.filter("total = 0").select("source", "total", F.lit(0.0), F.lit(1).cast("long"), F.lit(0).cast("long")))


def keyed(d: DataFrame, epoch, name: str = "perm_key") -> DataFrame:
    return d.withColumn(name, F.md5(F.concat_ws("|", F.lit(SEED), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))


def meet(rows: DataFrame, by_source: DataFrame, few: bool, *spread: str) -> DataFrame:
    """``rows`` with their source's row of ``by_source``; where that is long, ``spread`` names the columns that deal a source's rows out."""
    if few:
        return rows.join(F.broadcast(by_source), "source")
    repeated = by_source.withColumn("_part", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
    return rows.withColumn("_part", F.pmod(F.xxhash64(*spread), F.lit(SALTS))).join(repeated, ["source", "_part"]).drop("_part")


def plan(tokens: DataFrame, **how) -> tuple[DataFrame, bool]:
    """``source, total, passes, rest, last_key`` and whether that is short: the pass that is cut takes the keys up to ``last_key``."""
    dealt = cut(targets(tokens, **how))
    n, chars = dealt.agg(F.count("*"), F.coalesce(F.sum(F.length("source")), F.lit(0))).first()
    few = n <= FEW_SOURCES and chars <= FEW_CHARS
    last = meet(tokens, dealt.filter("rest > 0").select("source", "passes", "rest"), few, "doc_id", "n_tokens")
    last = keyed(last, F.col("passes")).withColumn("block", F.substring("perm_key", 1, BLOCK_DIGITS))
    sums = last.groupBy("source", "block", "rest").agg(F.sum("n_tokens").alias("in_block"))
    sums = sums.withColumn("before", F.sum("in_block").over(Window.partitionBy("source").orderBy("block")) - F.col("in_block"))
    # the last block that is begun; those before it are whole
    ends = cut(sums.filter("before < rest").groupBy("source").agg(F.max_by(F.struct("block", "before"), "block").alias("end")).select("source", F.col("end.block").alias("end"), F.col("end.before").alias("before")))
    inside = meet(last.drop("before"), ends, few, "doc_id", "n_tokens").filter("block = end")
    # rows of equal key are peers, which the frame takes together
    taken = inside.withColumn("upto", F.col("before") + F.sum("n_tokens").over(Window.partitionBy("source").orderBy("perm_key"))).filter("upto <= rest")
    keys = ends.join(taken.groupBy("source").agg(F.max("perm_key").alias("key")), "source", "left").select("source", F.coalesce("key", "end").alias("last_key"))
    return cut(dealt.join(keys, "source", "left").select("source", "total", "passes", "rest", "last_key")), few


def drawn(rows: DataFrame) -> DataFrame:
    """A row with ``epoch`` and ``perm_key`` for each time a row with its source's plan is drawn."""
    again = keyed(rows, F.col("passes"), "cut_key").withColumn("times", F.col("passes") + F.coalesce(F.col("cut_key") <= F.col("last_key"), F.lit(False)).cast("int"))
    return keyed(again.filter("times > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1))), F.col("epoch"))


def draw(docs: DataFrame, **how) -> DataFrame:
    """``doc_id, source, epoch, block, perm_key, n_tokens``, a row for each time a document is drawn; (epoch, block, perm_key) is the order."""
    tokens = cut(source_tokens(docs))
    by_source, few = plan(tokens, **how)
    return drawn(meet(tokens, by_source, few, "doc_id", "n_tokens")).select("doc_id", "source", "epoch", F.substring("perm_key", 1, BLOCK_DIGITS).alias("block"), "perm_key", "n_tokens")


def mix(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, all columns, as often as :func:`draw` draws them, in an order in which every stretch holds the target weights.

    A source's passes follow each other in the order of their permutations and are spread evenly over the whole.
    """
    by_source, few = plan(cut(source_tokens(docs)), **how)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("source"), F.xxhash64("text").alias("t"))
    d = drawn(meet(rows, by_source, few, "doc_id", "t"))
    share = F.conv(F.substring("perm_key", 1, 12), 16, 10).cast("double") / float(16**12)
    all_passes = F.col("passes") + F.when(F.col("total") > 0, F.col("rest") / F.col("total")).otherwise(0.0)
    d = d.select("row", ((F.col("epoch") + share) / all_passes).alias("at"), "perm_key", "t")
    return d.repartitionByRange(partitions(docs.sparkSession), "at").sortWithinPartitions("at", "perm_key", "t").select("row.*")


def _sql(budget: float = BUDGET, entropy: float = ENTROPY, max_epochs: float = MAX_EPOCHS) -> str:
    parts = [
        r"""t AS (SELECT doc_id, coalesce(source, '') AS source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS n_tokens FROM documents)""",
        "tot AS (SELECT source, sum(n_tokens)::BIGINT AS total FROM t GROUP BY source HAVING sum(n_tokens) > 0)",
        "sh AS (SELECT source, total, total / (SELECT sum(total)::DOUBLE FROM tot) AS p FROM tot)",
        "e0 AS (SELECT 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi)",
        "m0 AS (SELECT 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi)",
    ]
    for r in range(1, ROUNDS + 1):
        for x, ok, low, high in (
            ("e", f"ln(z) - a * l / z >= {entropy} * ln((SELECT count(*) FROM sh))", "max(k) FILTER (ok)", "max(k) FILTER (ok) + 1"),
            ("m", f"{budget} * r / z <= {max_epochs}", "coalesce(min(k) FILTER (ok), %d) - 1" % GRID, "coalesce(min(k) FILTER (ok), %d)" % GRID),
        ):
            b = f"{x}{r - 1}"
            parts.append(
                f"{x}g{r} AS (SELECT k, a, {ok} AS ok FROM (SELECT k, a, sum(pow(p, a)) AS z, sum(pow(p, a) * ln(p)) AS l, max(pow(p, a) / p) AS r FROM sh, (SELECT k, lo + (hi - lo) * k / {GRID} AS a FROM {b}, range(0, {GRID + 1}) AS g(k)) GROUP BY k, a))"
            )
            parts.append(f"{x}{r} AS (SELECT lo + (hi - lo) * greatest(k0, 0) / {GRID} AS lo, lo + (hi - lo) * least(k1, {GRID}) / {GRID} AS hi FROM {b}, (SELECT coalesce({low}, 0) AS k0, coalesce({high}, 1) AS k1 FROM {x}g{r}))")
    parts += [
        f"al AS (SELECT round(greatest((SELECT lo FROM e{ROUNDS}), (SELECT hi FROM m{ROUNDS})), 9) AS a)",
        f"am AS (SELECT source, total, pow(p, a) / (SELECT sum(pow(p, a)) FROM sh, al) * ({budget} * (SELECT sum(total)::DOUBLE FROM tot)) AS aim FROM sh, al)",
        "pl AS (SELECT source, total, floor(aim + greatest(aim * 1e-12, 1e-6))::BIGINT AS target FROM am)",
        "d AS (SELECT doc_id, t.source, n_tokens, target // total AS passes, target % total AS rest FROM t JOIN pl USING (source))",
        f"w AS (SELECT doc_id, source, n_tokens, e AS epoch, md5('{SEED}|' || e || '|' || doc_id) AS perm_key FROM (SELECT doc_id, source, n_tokens, unnest(range(0, passes)) AS e FROM d WHERE passes > 0))",
        f"l AS (SELECT doc_id, source, n_tokens, passes AS epoch, rest, md5('{SEED}|' || passes || '|' || doc_id) AS perm_key FROM d WHERE rest > 0)",
        f"lc AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY perm_key) AS s, sum(n_tokens) OVER (PARTITION BY source ORDER BY left(perm_key, {BLOCK_DIGITS})) - sum(n_tokens) OVER (PARTITION BY source, left(perm_key, {BLOCK_DIGITS})) AS before FROM l)",
        "o AS (SELECT doc_id, source, n_tokens, epoch, perm_key FROM w UNION ALL SELECT doc_id, source, n_tokens, epoch, perm_key FROM lc WHERE s <= rest AND before < rest)",
    ]
    return f"WITH {', '.join(parts)} SELECT doc_id, source, epoch::BIGINT AS epoch, left(perm_key, {BLOCK_DIGITS}) AS block, perm_key, n_tokens FROM o"


SQL = _sql()
