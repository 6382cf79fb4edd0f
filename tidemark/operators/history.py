"""Rank histories of items on lists: (source_id, item_id, batch, rank, seq)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ITEM = ["source_id", "item_id"]


def one_rank_each(observations: DataFrame) -> DataFrame:
    """One row for each item and batch: the best rank, of ties the first seen."""
    best = F.min(F.struct("rank", "seq")).alias("best")
    return observations.groupBy(*ITEM, "batch").agg(best).select(*ITEM, "batch", "best.rank", "best.seq")


def batches_in_order(observations: DataFrame) -> DataFrame:
    """(batch, previous) of all batches: one row for each, so few that one task orders them."""
    return observations.select("batch").distinct().withColumn("previous", F.lag("batch").over(Window.orderBy("batch")))


def off_list(observations: DataFrame) -> DataFrame:
    """Rank 0 rows of items that the batch before had and this one hasn't, for sources that this batch has.

    A source without any row in a batch has failed there, which says nothing about its items.
    """
    order = batches_in_order(observations).where("previous IS NOT NULL")
    before = observations.select(*ITEM, F.col("batch").alias("previous")).join(order, "previous")
    present = observations.select(*ITEM, "batch")
    succeeded = observations.select("source_id", "batch").distinct()
    gone = before.select(*ITEM, "batch").distinct().join(succeeded, ["source_id", "batch"], "left_semi").join(present, [*ITEM, "batch"], "left_anti")
    return gone.withColumn("rank", F.lit(0).cast("long")).withColumn("seq", F.lit(None).cast("long"))


def fold_ranks(history: DataFrame) -> DataFrame:
    """Per item: distinct visible ranks in order of first appearance, the timeline with null for off the list, and spans.

    Rows of rank 0 after the last batch that saw the item are not part of its history.
    """
    seen = F.max(F.when(F.col("rank") != 0, F.col("batch"))).alias("last_time")
    rows = F.array_sort(F.collect_list(F.struct("batch", F.coalesce("seq", F.lit(0)).alias("seq"), "rank"))).alias("rows")
    folded = history.groupBy(*ITEM).agg(F.min(F.when(F.col("rank") != 0, F.col("batch"))).alias("first_time"), seen, F.count(F.when(F.col("rank") != 0, 1)).alias("crawl_count"), rows)
    folded = folded.where("last_time IS NOT NULL").withColumn("rows", F.filter("rows", lambda r: (r["rank"] != 0) | (r["batch"] <= F.col("last_time"))))
    ranks = F.array_distinct(F.filter(F.transform("rows", lambda r: r["rank"]), lambda r: r != 0))
    timeline = F.transform("rows", lambda r: F.when(r["rank"] != 0, r["rank"]))
    return folded.select(*ITEM, "first_time", "last_time", "crawl_count", ranks.alias("ranks"), timeline.alias("timeline"))


def snapshot_ranks(history: DataFrame) -> DataFrame:
    """Per item all ranks in time order, with repeats and zeros, as the query tools count them."""
    rows = F.array_sort(F.collect_list(F.struct("batch", F.coalesce("seq", F.lit(0)).alias("seq"), "rank")))
    return history.groupBy(*ITEM).agg(F.transform(rows, lambda r: r["rank"]).alias("ranks"))


def latest_batch(observations: DataFrame) -> DataFrame:
    newest = observations.agg(F.max("batch").alias("newest"))
    return observations.join(F.broadcast(newest), F.col("batch") == F.col("newest")).drop("newest")


def new_items(observations: DataFrame, without_history: str = "all") -> DataFrame:
    """Items of the latest batch that no earlier one has. Where there is no earlier batch, all or none are new."""
    newest = observations.agg(F.max("batch").alias("newest"), F.min("batch").alias("oldest"))
    rows = observations.join(F.broadcast(newest))
    latest = rows.where("batch = newest").select(*ITEM, "batch", "rank", "oldest", "newest")
    found = latest.join(rows.where("batch < newest").select(*ITEM).distinct(), ITEM, "left_anti")
    return (found if without_history == "all" else found.where("oldest < newest")).select(*ITEM, "batch", "rank")


def merged_batches(rows: DataFrame) -> DataFrame:
    """Several batches folded into one state for each item: ranks as a sorted set, span, count, first link that isn't empty."""
    link = F.min_by(F.when(F.col("url") != "", F.col("url")), F.when(F.col("url") != "", F.col("seq")))
    return rows.groupBy(*ITEM).agg(
        F.array_sort(F.collect_set("rank")).alias("ranks"), F.min("batch").alias("first_time"), F.max("batch").alias("last_time"), F.countDistinct("batch").alias("crawl_count"), link.alias("url")
    )


def upserted(state: DataFrame, batch: DataFrame) -> DataFrame:
    """A state table (source_id, item_id, title, url, first_time, last_time, crawl_count) with a batch merged in.

    Rows of the batch that share a key are folded first, in seq order, as if they came one by one. Titles that look
    like links, and empty ones, don't replace a title.
    """
    real = (F.coalesce("title", F.lit("")) != "") & ~F.coalesce("title", F.lit("")).rlike("^https?://")
    folded = batch.groupBy(*ITEM).agg(
        F.max_by(F.when(real, F.col("title")), F.when(real, F.col("seq"))).alias("new_title"),
        F.min_by("title", "seq").alias("any_title"),
        F.max_by("url", "seq").alias("new_url"),
        F.min("batch").alias("new_first"),
        F.max("batch").alias("new_last"),
        F.count("*").alias("new_count"),
    )
    return state.join(folded, ITEM, "full_outer").select(
        *ITEM,
        F.coalesce("new_title", "title", "any_title").alias("title"),
        F.coalesce("new_url", "url").alias("url"),
        F.coalesce("first_time", "new_first").alias("first_time"),
        F.coalesce("new_last", "last_time").alias("last_time"),
        (F.coalesce("crawl_count", F.lit(0)) + F.coalesce("new_count", F.lit(0))).alias("crawl_count"),
    )


def title_changes(rows: DataFrame, title: str = "title") -> DataFrame:
    """(item, batch, old_title, new_title) wherever an item's title differs from the one before."""
    order = Window.partitionBy(*ITEM).orderBy("batch", "seq")
    changed = rows.withColumn("old_title", F.lag(title).over(order)).where(F.col("old_title") != F.col(title))
    return changed.select(*ITEM, "batch", "seq", "old_title", F.col(title).alias("new_title"))


def first_of_day(observations: DataFrame, day: Column) -> DataFrame:
    """Days with the number of their batches, and whether there was but one."""
    counts = observations.groupBy(day.alias("day")).agg(F.countDistinct("batch").alias("batches"))
    return counts.withColumn("first_crawl", F.col("batches") <= 1)


def with_previous(history: DataFrame) -> DataFrame:
    """Each row with the state just before it, the last visible rank before it, and how often it was visible by then."""
    order = Window.partitionBy(*ITEM).orderBy("batch", F.coalesce("seq", F.lit(0)))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    visible = (F.col("rank") > 0) & (F.col("rank") != 99)
    rank = F.when(visible, F.col("rank"))
    return history.select(
        "*",
        visible.alias("visible"),
        F.lag("rank").over(order).alias("row_before"),
        F.last(rank, ignorenulls=True).over(before).alias("visible_before"),
        F.count(rank).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("times_visible"),
    ).withColumn("delta", F.when((F.col("row_before") > 0) & (F.col("row_before") != 99), F.col("row_before") - F.col("rank")))
