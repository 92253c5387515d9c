"""Scan history (append tables, paging) and collections (folded from events)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import top


def to_append(views: DataFrame) -> DataFrame:
    """The views that go into the history: first, normal-variant, priced, no test. ``views(.., refresh, variant, price, test)``."""
    return views.filter(~F.col("refresh") & (F.col("variant") == "normal") & F.col("price").isNotNull() & ~F.col("test"))


def append_history(views: DataFrame, path: str, batch: int) -> None:
    """Appends the rows of a batch of views to the history at ``path``. A batch that is written again replaces its own rows, so replays add nothing."""
    to_append(views).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def page_before(history: DataFrame, before_id: int | None, limit: int = 50) -> DataFrame:
    """Keyset page: ids under the cursor, newest id first; at most 200 rows."""
    rows = history if before_id is None else history.filter(F.col("id") < before_id)
    return rows.orderBy(F.desc("id")).limit(min(limit, 200))


def page_at(history: DataFrame, offset: int, limit: int = 50) -> DataFrame:
    """Offset page by time, newest first."""
    return history.orderBy(F.desc("scanned_at"), F.desc("id")).offset(offset).limit(min(limit, 200))


def latest_per_card(history: DataFrame) -> DataFrame:
    """The newest row of each card; rows without a card all stay. One aggregation; the rows without a card take no part in it."""
    fields = [c for c in history.columns if c != "card_id"]
    last = history.filter("card_id IS NOT NULL").groupBy("card_id").agg(F.max_by(F.struct(*fields), F.struct("scanned_at", "id")).alias("r")).select("card_id", "r.*").select(history.columns)
    return last.unionByName(history.filter("card_id IS NULL"))


def next_page_unseen(page: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows of the page whose card was not shown yet; rows without a card stay."""
    return page.join(seen.select("card_id").distinct(), "card_id", "left_anti")


def age_text(at: Column, now: Column) -> Column:
    minutes = F.floor((F.unix_timestamp(now) - F.unix_timestamp(at.cast("timestamp"))) / 60)
    text = lambda n, unit: F.concat(n.cast("string"), F.lit(f"{unit} ago"))
    return F.when(minutes < 1, "just now").when(minutes < 60, text(minutes, "m")).when(minutes < 1440, text(F.floor(minutes / 60), "h")).otherwise(text(F.floor(minutes / 1440), "d"))


def fold_collection_events(events: DataFrame) -> DataFrame:
    """``collection_id, card_id, position`` after all events ``seq, collection_id, card_id, op`` (add, remove, remove_all, delete).

    A card is in a collection if it was added since the last event that took it out; its place is that of the first such add, the
    newest first. Deletions count for all cards of the collection, removals from all for all collections; the default one (id 0) is never deleted.
    """
    member = events.filter("op IN ('add', 'remove')")
    last_out = member.filter("op = 'remove'").groupBy("collection_id", "card_id").agg(F.max("seq").alias("out1"))
    everywhere = events.filter("op = 'remove_all'").groupBy("card_id").agg(F.max("seq").alias("out2"))
    deleted = events.filter("op = 'delete' AND collection_id <> 0").groupBy("collection_id").agg(F.max("seq").alias("out3"))
    adds = member.filter("op = 'add'").join(last_out, ["collection_id", "card_id"], "left").join(everywhere, "card_id", "left").join(deleted, "collection_id", "left")
    since = F.greatest(F.coalesce("out1", F.lit(-1)), F.coalesce("out2", F.lit(-1)), F.coalesce("out3", F.lit(-1)))
    standing = adds.filter(F.col("seq") > since).groupBy("collection_id", "card_id").agg(F.min("seq").alias("seq"))
    return top(standing, ["collection_id"], [F.desc("seq"), F.asc("card_id")], 2_000_000_000).select("collection_id", "card_id", F.col("rank").alias("position"))


def fold_delta(standing: DataFrame, events: DataFrame) -> DataFrame:
    """``collection_id, card_id, seq`` of the cards that stand after ``events``, all later than those that ``standing`` comes from.

    Only what the new events touch is worked out: a standing card goes if a new event takes it out, and comes again by the first add after the last of these."""
    member = events.filter("op IN ('add', 'remove')")
    pair = member.filter("op = 'remove'").groupBy("collection_id", "card_id").agg(F.max("seq").alias("out1"))
    card = events.filter("op = 'remove_all'").groupBy("card_id").agg(F.max("seq").alias("out2"))
    whole = events.filter("op = 'delete' AND collection_id <> 0").groupBy("collection_id").agg(F.max("seq").alias("out3"))
    kept = standing.join(pair, ["collection_id", "card_id"], "left_anti").join(card, "card_id", "left_anti").join(whole, "collection_id", "left_anti")
    adds = member.filter("op = 'add'").join(pair, ["collection_id", "card_id"], "left").join(card, "card_id", "left").join(whole, "collection_id", "left")
    adds = adds.filter(F.col("seq") > F.greatest(F.coalesce("out1", F.lit(-1)), F.coalesce("out2", F.lit(-1)), F.coalesce("out3", F.lit(-1))))
    fresh = adds.groupBy("collection_id", "card_id").agg(F.min("seq").alias("seq"))
    both = kept.select("collection_id", "card_id", "seq").unionByName(fresh.select("collection_id", "card_id", "seq"))
    return both.groupBy("collection_id", "card_id").agg(F.min("seq").alias("seq"))


class CollectionState:
    """Collections as a stored snapshot with the last event it has seen; each run reads the events after it and stores the next snapshot."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def last(self) -> int | None:
        """The last event of the newest whole snapshot."""
        try:
            return self.spark.read.schema("last long").json(f"{self.path}/seen").agg(F.max("last")).first()[0]
        except AnalysisException:
            return None

    def standing(self) -> DataFrame:
        last, schema = self.last(), "collection_id long, card_id long, seq long"
        return self.spark.createDataFrame([], schema) if last is None else self.spark.read.schema(schema).parquet(f"{self.path}/after={last}")

    def advance(self, events: DataFrame) -> int:
        """Folds the events that are later than the snapshot; returns their number. Events that come again change nothing; a run that broke off is done again."""
        last = self.last()
        new = events if last is None else events.filter(F.col("seq") > last)
        n, upto = new.agg(F.count("*"), F.max("seq")).first()
        if n:
            fold_delta(self.standing(), new).write.mode("overwrite").parquet(f"{self.path}/after={upto}")
            self.spark.createDataFrame([(upto,)], "last long").coalesce(1).write.mode("append").json(f"{self.path}/seen")
        return n

    def members(self) -> DataFrame:
        """``collection_id, card_id, position``, as :func:`fold_collection_events` gives them."""
        return top(self.standing(), ["collection_id"], [F.desc("seq"), F.asc("card_id")], 2_000_000_000).select("collection_id", "card_id", F.col("rank").alias("position"))


def fold_collection_names(events: DataFrame) -> DataFrame:
    """``collection_id, name`` of the collections that stand after all events ``seq, collection_id, op, name`` (create, rename, delete).

    A collection stands if it was created after its last deletion; its name is that of the last later renaming, trimmed, else that of its
    creation. The default one (id 0) can be neither deleted nor renamed; renaming what does not stand does nothing.
    """
    own = F.col("collection_id") == 0
    gone = events.filter((F.col("op") == "delete") & ~own).groupBy("collection_id").agg(F.max("seq").alias("gone"))
    after = events.join(gone, "collection_id", "left").filter(F.col("seq") > F.coalesce("gone", F.lit(-1)))
    made = after.filter("op = 'create'").groupBy("collection_id").agg(F.min_by("name", "seq").alias("made_name"), F.min("seq").alias("made"))
    renamed = after.filter((F.col("op") == "rename") & ~own).join(made.select("collection_id", "made"), "collection_id").filter("seq > made").groupBy("collection_id").agg(F.max_by(F.trim("name"), "seq").alias("new_name"))
    return made.join(renamed, "collection_id", "left").select("collection_id", F.coalesce("new_name", "made_name").alias("name"))


def collections_view(members: DataFrame, cards: DataFrame, previews: int = 4) -> DataFrame:
    """Non-empty collections with the number of their known cards and the first known cards as previews."""
    j = members.join(cards.select("card_id", "name"), "card_id")
    first = top(j, ["collection_id"], [F.asc("position")], previews).groupBy("collection_id").agg(F.sort_array(F.collect_list(F.struct("position", "name"))).alias("c"))
    g = j.groupBy("collection_id").agg(F.count("*").alias("cards")).join(first, "collection_id")
    return g.select("collection_id", "cards", F.array_join(F.transform("c", lambda x: x["name"]), "|").alias("previews"))


def collections_of_cards(members: DataFrame, collections: DataFrame) -> DataFrame:
    """``card_id, game, collections``: the collections of a game that hold a card, in order of their ids. ``collections(collection_id, game)``."""
    j = members.join(collections, "collection_id").groupBy("card_id", "game").agg(F.sort_array(F.collect_set("collection_id")).alias("c"))
    return j.select("card_id", "game", F.array_join(F.transform("c", lambda x: x.cast("string")), ",").alias("collections"))


def session_dedupe(items: DataFrame) -> DataFrame:
    """``session_id, kept, removed``: cards of a session and how many repeats went when the newest of each stays."""
    return items.groupBy("session_id").agg(F.count_distinct("card").alias("kept"), (F.count("card") - F.count_distinct("card")).alias("removed"))


def session_newest(items: DataFrame) -> DataFrame:
    return items.filter("card IS NOT NULL").groupBy("session_id", "card").agg(F.max_by("frame_id", F.struct("ts", "frame_id")).alias("frame_id"))


def stage_durations(timings: DataFrame) -> DataFrame:
    """Durations between the five times of a scan; without a first result its duration runs to the end. ``id, start, detected, read, first, done`` in ms."""
    return timings.select("id", (F.col("detected") - F.col("start")).alias("detect_ms"), (F.col("read") - F.col("detected")).alias("read_ms"), (F.coalesce("first", "done") - F.col("start")).alias("first_ms"), (F.col("done") - F.col("start")).alias("total_ms"))


def duration_summary(durations: DataFrame) -> DataFrame:
    return durations.agg(F.count("*").alias("scans"), *[F.round(F.avg(c), 3).alias(f"mean_{c}") for c in ("detect_ms", "read_ms", "first_ms", "total_ms")], F.percentile("total_ms", 0.5).alias("median_total"))
