"""Feed entries: (feed_id, guid, url, title, summary, author, published_at, batch, seq). Links and guids may be blank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.search import newest_of_each_link
from tidemark.plans.prefix_sums import positions
from tidemark.plans.rules import Rules

#: Position of an entry without link.
NO_POSITION = 99
DETAILS = ["title", "summary", "author", "published_at"]


def _blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def _link_like(title: Column) -> Column:
    return F.coalesce(F.ltrim(title), F.lit("")).rlike("^(https?:)?//")


def _folded(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of equal keys as one, as if they came one by one in seq order: what counts is the last of each value."""
    last = lambda c, when: F.max_by(F.when(when, F.col(c)), F.when(when, F.col("seq"))).alias(c)
    plain = F.coalesce("plain_title", F.when(~_link_like(F.col("title")), F.col("title")))
    return rows.withColumn("plain_title", plain).groupBy(*keys).agg(
        last("guid", ~_blank("guid")),
        last("url", ~_blank("url")),
        F.max_by("plain_title", F.when(F.col("plain_title").isNotNull(), F.col("seq"))).alias("plain_title"),
        F.max_by(F.struct(*DETAILS), "seq").alias("d"),
        F.min("first_batch").alias("first_batch"),
        F.max("last_batch").alias("last_batch"),
        F.sum("n").alias("n"),
        F.max("seq").alias("seq"),
    ).select(*keys, "guid", "url", "plain_title", "d.*", "first_batch", "last_batch", "n", "seq")


def upserted_entries(state: DataFrame, batch: DataFrame) -> DataFrame:
    """State (entry_id, feed_id, guid, url, title, summary, author, published_at, first_batch, last_batch, crawl_count) after a batch.

    An entry of the batch is the one of its feed with its guid, or else the one with its link; without either it is
    ignored, as is one without feed. The last values count, but blank guids and links replace nothing, and a title that looks like a link
    doesn't replace one that doesn't. Entries of the batch with equal guids are one, as are those without guid and one
    with an equal link (of several, that with the least guid); what matches one row of the state is one too. A null
    guid or link is blank; an empty batch leaves the state as it is.
    """
    rows = batch.where(~(_blank("guid") & _blank("url")) & F.col("feed_id").isNotNull()).withColumns({"guid": F.coalesce("guid", F.lit("")), "url": F.coalesce("url", F.lit("")), "n": F.lit(1).cast("long"), "plain_title": F.lit(None).cast("string"), "first_batch": F.col("batch"), "last_batch": F.col("batch")})
    by_link = rows.where("guid <> '' AND url <> ''").groupBy("feed_id", "url").agg(F.min("guid").alias("of_link"))
    key = F.when(F.col("guid") != "", F.concat(F.lit("g"), "guid")).otherwise(F.coalesce(F.concat(F.lit("g"), "of_link"), F.concat(F.lit("u"), "url")))
    folded = _folded(rows.join(by_link, ["feed_id", "url"], "left").withColumn("key", key), ["feed_id", "key"])

    known = lambda c, out: state.where(~_blank(c)).groupBy("feed_id", c).agg(F.min("entry_id").alias(out))
    found = folded.join(known("guid", "by_guid"), ["feed_id", "guid"], "left").join(known("url", "by_url"), ["feed_id", "url"], "left")
    new_id = F.sha2(F.concat_ws("\x1f", "feed_id", "key", F.col("first_batch").cast("string")), 256)
    named = found.withColumn("entry_id", F.coalesce("by_guid", "by_url", new_id))
    updates = _folded(named, ["feed_id", "entry_id"]).drop("seq")

    old = state.select("entry_id", "feed_id", *[F.col(c).alias(f"old_{c}") for c in ["guid", "url", "title", "first_batch", "crawl_count", "last_batch", "summary", "author", "published_at"]])
    both = old.join(updates, ["feed_id", "entry_id"], "full_outer")
    hit = F.col("n").isNotNull()
    kept = F.coalesce("plain_title", F.when(~_link_like(F.col("old_title")), F.col("old_title")))
    title = F.when(_link_like(F.col("title")) & (F.coalesce(kept, F.lit("")) != ""), kept).otherwise(F.col("title"))
    now = lambda c: F.when(hit, F.col(c)).otherwise(F.col(f"old_{c}")).alias(c)
    return both.select(
        "entry_id", "feed_id", F.coalesce("guid", "old_guid", F.lit("")).alias("guid"), F.coalesce("url", "old_url", F.lit("")).alias("url"), F.when(hit, title).otherwise(F.col("old_title")).alias("title"),
        now("summary"), now("author"), now("published_at"), F.coalesce("old_first_batch", "first_batch").alias("first_batch"), now("last_batch"),
        (F.coalesce("old_crawl_count", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("long").alias("crawl_count"),
    )


def day_entries(state: DataFrame, feeds: DataFrame) -> DataFrame:
    """All entries of a day's state with the names of their feeds (feed_id, name), the last published first."""
    named = state.join(feeds.select("feed_id", "name"), "feed_id", "left")
    return named.withColumn("feed_name", F.coalesce("name", "feed_id")).drop("name").orderBy(F.desc("published_at"), "entry_id")


def latest_entries(state: DataFrame, batches: DataFrame) -> DataFrame:
    """Entries that the newest batch saw; batches also lists those that brought nothing."""
    newest = batches.agg(F.max("batch").alias("newest"))
    return state.join(F.broadcast(newest), F.col("last_batch") == F.col("newest")).drop("newest")


def new_entries(batch: DataFrame, state: DataFrame, now: Column) -> DataFrame:
    """Entries of a batch whose link no earlier batch has seen in their feed; one without link is never new.

    Where no link was seen before now, all are new, also those without link.
    """
    seen = state.where(~_blank("url") & (F.col("first_batch") < now)).select("feed_id", "url").distinct()
    any_seen = seen.limit(1).agg((F.count("*") > 0).alias("any_seen"))
    rows = batch.join(F.broadcast(any_seen))
    fresh = rows.join(seen.withColumn("known", F.lit(True)), ["feed_id", "url"], "left")
    return fresh.where(~F.col("any_seen") | (F.col("known").isNull() & ~_blank("url"))).select(*batch.columns)


def frequencies(entries: DataFrame, rules: Rules, new_links: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Entries by keyword rules: (entries with group_no, position and is_new, groups with n and percentage).

    Of equal links over all feeds the first in seq order counts. The position is by time of publication, the newest
    first; one link's is that of its last entry in this order, and an entry without link has 99. The percentage is of
    all entries, repeated ones included. Without groups all entries are in group 0. Groups without entry are left out.
    """
    placed = positions(entries.withColumn("_at", F.coalesce(F.col("published_at").cast("string"), F.lit(""))), [F.desc("_at"), F.col("seq")], "_place").drop("_at")
    blank = _blank("url")
    linked = placed.where(~blank).groupBy("url").agg(F.min("seq").alias("seq"), (F.max("_place") + 1).alias("position"))
    first = placed.where(~blank).join(linked, ["url", "seq"]).unionByName(placed.where(blank).withColumn("position", F.lit(NO_POSITION).cast("long"))).drop("_place")
    group = rules.first_group(F.col("title")) if rules.groups else F.when(rules.passes(F.col("title")), F.lit(0))
    rows = first.withColumn("group_no", group).where("group_no IS NOT NULL")
    if new_links is None:
        rows = rows.withColumn("is_new", F.lit(False))
    else:
        known = new_links.where(~_blank("url")).select("url").distinct().withColumn("_new", F.lit(True))
        rows = rows.join(known, "url", "left").withColumn("is_new", F.coalesce("_new", F.lit(False))).drop("_new")
    whole = entries.agg(F.count("*").alias("whole"))
    counts = rows.groupBy("group_no").agg(F.count("*").alias("n")).join(F.broadcast(whole))
    return rows, counts.select("group_no", "n", F.round(F.col("n") / F.col("whole") * 100, 2).alias("percentage"))


def entries_for_mode(mode: str, state: DataFrame, batches: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(entries to report, entries of the section of new ones): incremental reports the new ones alone, current the newest batch, daily all."""
    if mode == "incremental":
        return new, None
    return (latest_entries(state, batches) if mode == "current" else state), new


def fresh_entries(entries: DataFrame, limits: DataFrame, now: Column, days: float) -> DataFrame:
    """Entries published within their feed's limit of days (feed_id, max_days), or the general one; 0 is no limit."""
    limit = F.coalesce(F.col("max_days").cast("double"), F.lit(float(days)))
    age = F.unix_timestamp(now) - F.unix_timestamp("published_at")
    rows = entries.join(limits.select("feed_id", "max_days"), "feed_id", "left")
    return rows.where((limit <= 0) | F.coalesce(age <= limit * 86400, F.lit(True))).drop("max_days")


def last_days(entries: DataFrame, today: Column, days: int = 1) -> DataFrame:
    """Entries of the last days (1 to 30) up to today, the last published first; of equal links the newest day's, then the first seen."""
    rows = entries.where((F.col("batch") <= today) & (F.col("batch") > F.date_sub(today, min(max(days, 1), 30)).cast("timestamp")))
    return newest_of_each_link(rows, "url", "batch").orderBy(F.desc("published_at"), "seq")
