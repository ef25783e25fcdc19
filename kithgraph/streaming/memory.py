"""Session memory: items that live while they are used, promotion, running summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kithgraph import model
from kithgraph.functions.text import truncate

M = model.MEMORY
FOREVER = "36500 days"


def item_lives(events: DataFrame, ttl_seconds: int = M["short_ttl"]) -> DataFrame:
    """One row per life of an item: it ends when the item is unused for longer than its time to live.

    Time to live runs from the last use, which is what a session window with that gap says; a pinned item
    gets an endless gap.  The same plan runs on a table and on a stream, where the watermark emits a life once
    it is over and drops its state.  Events: session_id, item_id, op (record / reinforce / pin), importance,
    content, ts.
    """
    unused_for = F.when(F.col("op") == "pin", F.lit(FOREVER)).otherwise(F.lit(f"{ttl_seconds} seconds 1 microsecond"))
    lives = events.groupBy("session_id", "item_id", F.session_window("ts", unused_for).alias("life")).agg(
        F.min("ts").alias("created_at"), F.max("ts").alias("last_used"), F.max("importance").alias("importance"),
        (F.count_if(F.col("op") == "reinforce") * M["increment"]).alias("strength"), F.bool_or(F.col("op") == "pin").alias("pinned"),
        F.max_by("content", "ts").alias("content"))
    return lives.withColumn("expires_at", F.col("life.end")).drop("life")


def live_at(lives: DataFrame, as_of: Column) -> DataFrame:
    """Items in memory at a moment: begun by then and neither run out nor replaced by a later life."""
    return lives.filter((F.col("created_at") <= as_of) & (F.col("pinned") | (F.col("expires_at") > as_of)))


def capped(items: DataFrame, cap: int = M["short_cap"]) -> DataFrame:
    """Newest items per session; the cut is taken before the shuffle as well, so a busy session stays small."""
    order = Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("item_id"))
    return items.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= cap).drop("position")


def promoted_to_mid(items: DataFrame, batch: int = M["batch"]) -> DataFrame:
    """Important ones among the first items of each session; they also stay in short-term memory."""
    order = Window.partitionBy("session_id").orderBy("created_at", "item_id")
    first = items.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= batch).drop("position")
    return first.filter(F.col("importance") >= M["short_promotion"])


def promoted_to_long(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(long-term rows, mid-term items that remain): pinned, important or often reinforced items are kept for good."""
    worthy = F.col("pinned") | (F.col("importance") >= M["mid_importance"]) | (F.col("strength") >= M["mid_strength"])
    ready = items.filter(worthy).withColumn("content", truncate(F.col("content")))
    return ready, items.filter(~worthy | F.col("pinned"))


def recent_history(rows: DataFrame, key: str, order: list[Column], size: int = M["history"]) -> DataFrame:
    """Last rows per key.  The top-k is taken on the map side first."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("position") <= size)


def session_summary(history: DataFrame, key: str = "session_id") -> DataFrame:
    """Joined summary of a bounded history, oldest first."""
    rows = history.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("position")).alias("o"), "summary"))).alias("h"))
    texts = F.filter(F.transform("h", lambda e: e["summary"]), lambda s: s.isNotNull() & (s != ""))
    return rows.select(key, F.array_join(texts, "; ").alias("summary"), F.size("h").alias("n"))


def merge_history(stored: DataFrame | None, batch: DataFrame, key: str = "session_id", size: int = M["history"]) -> DataFrame:
    """History after a micro-batch: the batch is cut to its newest rows before it meets the stored ones."""
    order = [F.desc("turn")]
    new = recent_history(batch, key, order, size).drop("position")
    rows = new if stored is None else stored.drop("position").unionByName(new).dropDuplicates([key, "turn"])
    return recent_history(rows, key, order, size)
