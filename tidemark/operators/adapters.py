"""Titles of keyword statistics as items to score, with what is known of their ranks, times and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ranks import is_visible, rank_kind


def _seen(rank: Column) -> Column:
    return F.coalesce(is_visible(rank), F.lit(False))


def is_reliable(timeline: Column, mode: str) -> Column:
    """Whether a timeline of ranks, null where off the list, tells of growth: incremental runs make theirs up."""
    return F.lit(mode != "incremental") & F.coalesce(F.exists(timeline, lambda r: r.isNotNull()), F.lit(False))


def times_made_up(first: Column, last: Column, mode: str) -> Column:
    return F.lit(mode == "incremental") & F.coalesce(first == last, F.lit(False))


def count_meaning(count: Column, kind: str) -> Column:
    known = {"hotlist": "crawl_count", "rss": "rss_item_count"}.get(kind, "unknown")
    return F.when(count > 0, known).otherwise("unknown")


def new_meaning(is_new: Column, first_crawl: bool | None) -> Column:
    """unknown where an item isn't new; on the first crawl of a day all are, which says little."""
    return F.when(is_new, "incremental_first_crawl" if first_crawl else "new_titles_detection").otherwise("unknown")


def _common(rows: DataFrame, kind: str, mode: str, first_crawl: bool | None) -> DataFrame:
    first, last = F.col("first_time"), F.col("last_time")
    return rows.withColumns(
        {
            "kind": F.lit(kind),
            "has_times": first.isNotNull() | last.isNotNull(),
            "times_made_up": times_made_up(first, last, mode),
            "has_count": F.coalesce(F.col("count") > 0, F.lit(False)),
            "count_meaning": count_meaning(F.col("count"), kind),
            "new_meaning": new_meaning(F.col("is_new"), first_crawl),
        }
    )


def list_items(rows: DataFrame, mode: str = "daily", first_crawl: bool | None = None) -> DataFrame:
    """Rows (source_id, title, ranks, timeline, first_time, last_time, count, is_new, ...) of ranked lists as items.

    best_rank is the best visible of all ranks, or else the first that isn't null; kind_of_rank says which. rank is the
    last of the timeline, if that is reliable, or else best_rank if visible. An earlier observation counts for
    rank_delta only if it is the one just before, and visible; visible_before may be older. Arrays may be null or empty.
    """
    visible = F.array_min(F.filter("ranks", _seen))
    line = F.when(is_reliable(F.col("timeline"), mode), F.col("timeline")).otherwise(F.array().cast("array<long>"))
    rows = rows.withColumn("best_rank", F.coalesce(visible, F.get(F.filter("ranks", lambda r: r.isNotNull()), F.lit(0)))).withColumn("_line", line)
    size, earlier = F.size("_line"), F.slice("_line", 1, F.greatest(F.size("_line") - 1, F.lit(0)))
    just_before, last = F.get("_line", size - 2), F.get("_line", size - 1)
    rows = rows.withColumns(
        {
            "kind_of_rank": rank_kind(F.col("best_rank")),
            "reliable": size > 0,
            "times_visible": F.size(F.filter("_line", _seen)),
            "rank": F.when(size > 0, F.when(_seen(last), last)).otherwise(F.when(_seen(F.col("best_rank")), F.col("best_rank"))),
            "has_before": size > 1,
            "before_visible": (size > 1) & _seen(just_before),
            "visible_before": F.try_element_at(F.filter(earlier, _seen), F.lit(-1)),
        }
    )
    delta = F.when(F.col("before_visible"), F.col("visible_before") - F.col("rank"))
    return _common(rows.withColumn("rank_delta", delta).drop("_line"), "hotlist", mode, first_crawl)


def feed_items(rows: DataFrame, mode: str = "daily", first_crawl: bool | None = None) -> DataFrame:
    """Rows (feed_id, title, url, published_at, first_time, last_time, count, is_new, ...) of feeds as items.

    An entry's place by time of publication is no rank, so an item has none, nor a timeline; the time of publication
    stands for a first time that is missing.
    """
    rows = rows.withColumn("first_time", F.coalesce("first_time", "published_at"))
    none, no = F.lit(None).cast("long"), F.lit(False)
    rows = rows.withColumns({"best_rank": none, "kind_of_rank": F.lit("missing"), "reliable": no, "times_visible": F.lit(0), "rank": none})
    rows = rows.withColumns({"has_before": no, "before_visible": no, "visible_before": none, "rank_delta": none})
    return _common(rows, "rss", mode, first_crawl)


def with_observations(items: DataFrame, identity: Column, observed: DataFrame, recovered: DataFrame, owner: str) -> DataFrame:
    """Items with observed, whether this run saw their identity, and after_gap, whether their source then just came back.

    observed has a column identity; recovered a column source_id. An item whose source is blank is after no gap.
    """
    seen = observed.select(F.col("identity").alias("_identity")).distinct().withColumn("observed", F.lit(True))
    back = recovered.select(F.trim("source_id").alias("_owner")).where("_owner <> ''").distinct().withColumn("_back", F.lit(True))
    rows = items.withColumn("_identity", identity).withColumn("_owner", F.trim(owner)).join(seen, "_identity", "left").join(back, "_owner", "left")
    rows = rows.withColumn("observed", F.coalesce("observed", F.lit(False)))
    return rows.withColumn("after_gap", F.col("observed") & F.coalesce("_back", F.lit(False))).drop("_identity", "_owner", "_back")


def recovered_sources(failed_before: DataFrame, succeeded: DataFrame) -> DataFrame:
    """Sources (source_id) that failed the last time and now succeeded."""
    return failed_before.select("source_id").distinct().join(succeeded, "source_id", "left_semi")


def titles_for_mode(folded: DataFrame, new: DataFrame, mode: str, first_crawl: bool = False) -> DataFrame:
    """The titles (source_id, item_id, last_time, ...) that a run mode looks at, with is_new.

    daily: all; current: those that the newest batch has, with their whole history; both mark those in new (source_id,
    item_id). incremental: the new ones alone, on a day's first crawl all, and all are marked.
    """
    marks = new.select("source_id", "item_id").distinct().withColumn("is_new", F.lit(True))
    if mode == "incremental":
        rows = folded if first_crawl else folded.join(marks, ["source_id", "item_id"], "left_semi")
        return rows.withColumn("is_new", F.lit(True))
    if mode == "current":
        newest = folded.agg(F.max("last_time").alias("newest"))
        folded = folded.join(F.broadcast(newest), F.col("newest").isNull() | (F.col("last_time") == F.col("newest"))).drop("newest")
    return folded.join(marks, ["source_id", "item_id"], "left").withColumn("is_new", F.coalesce("is_new", F.lit(False)))


def without_background(groups: DataFrame, prefix: str = "背景-", name: str = "group_name") -> DataFrame:
    """Groups whose name doesn't begin with a prefix; all if that is empty. A group without name stays."""
    return groups.where(~F.coalesce(F.col(name).startswith(prefix), F.lit(False))) if prefix else groups
