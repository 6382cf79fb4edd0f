"""Small relations around reports: typed rows of a crawl, lists of ids, times, links, radar counts, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ranks import NO_RANK
from tidemark.functions.text import WHITE, trimmed

#: Line ends of any kind.
LINE_ENDS = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\x{2028}\x{2029}]"
#: Statuses by the section of the radar that they count in.
STATUS_SECTIONS = {
    "多层来源呼应": "cross_layer_verified",
    "单点高热，来源待补": "high_heat_unverified",
    "中文平台热度上升": "chinese_only_hot",
    "中文专业来源": "chinese_only_hot",
    "中文多源覆盖": "chinese_only_hot",
    "中文多平台覆盖": "chinese_only_hot",
    "中文源有呼应": "chinese_only_hot",
    "社交端响应偏弱": "silence_gap",
}
#: Sections of the radar by the name of their count.
RADAR = {"cross_layer": "cross_layer_verified", "high_heat": "high_heat_unverified", "chinese_only": "chinese_only_hot", "silence_gap": "silence_gap"}
#: Links that a report doesn't show, and links that a short text leaves out.
PUBLIC_URL, URL = r"(?i)https?://[^\s<>\"']+", r"(?i)https?://\S+"


def crawled_rows(results: DataFrame, names: DataFrame, crawl_time: Column) -> DataFrame:
    """Titles of a crawl (source_id, title, ranks, url, mobile_url) as rows to keep: the first rank, or 99 without any, the
    source's name (id, name), or else its id, the crawl as first and last time, and a count of one."""
    named = names.select(F.col("id").alias("source_id"), F.col("name").alias("source_name")).dropDuplicates(["source_id"])
    rows = results.join(named, "source_id", "left").withColumn("source_name", F.coalesce("source_name", "source_id"))
    rank = F.coalesce(F.get("ranks", F.lit(0)), F.lit(NO_RANK))
    return rows.withColumns({"rank": rank, "crawl_time": crawl_time, "first_time": crawl_time, "last_time": crawl_time, "count": F.lit(1).cast("long")})


def named_ids(items: DataFrame, names: DataFrame) -> DataFrame:
    """(id, title, source_id, source_name) of all items in order of id; a source without a name has its id."""
    named = names.select(F.col("id").alias("source_id"), F.col("name").alias("_name")).dropDuplicates(["source_id"])
    rows = items.select("id", "title", "source_id").join(named, "source_id", "left")
    return rows.select("id", "title", "source_id", F.coalesce(F.nullif("_name", F.lit("")), "source_id").alias("source_name")).orderBy("id")


def crawl_epochs(records: DataFrame, now: Column) -> DataFrame:
    """Records (crawl_time, created_at) as (name, epoch): when each crawl was kept, in seconds; now where that is no time."""
    at = F.try_to_timestamp("created_at", F.lit("yyyy-MM-dd HH:mm:ss"))
    return records.select(F.concat("crawl_time", F.lit(".db")).alias("name"), F.unix_timestamp(F.coalesce(at, now)).alias("epoch"))


def interests_hash(content: Column, name: Column) -> Column:
    """Name and digest of a file of interests; blank lines, comments and white space at the ends of lines don't matter."""
    lines = F.transform(F.split(F.coalesce(content, F.lit("")), LINE_ENDS), trimmed)
    kept = F.filter(lines, lambda x: (x != "") & ~x.startswith("#"))
    return F.concat(name, F.lit(":"), F.md5(F.array_join(kept, "\n")))


def public_text(text: Column) -> Column:
    """text without absolute links, and without white space at its ends; null is empty."""
    return trimmed(F.regexp_replace(F.coalesce(text, F.lit("")), PUBLIC_URL, ""))


def shortened(text: Column, most: int) -> Column:
    """text without links, cut to most characters, with three dots if anything was cut."""
    whole = trimmed(F.regexp_replace(F.coalesce(text, F.lit("")), URL, ""))
    return F.when(F.length(whole) <= most, whole).otherwise(F.concat(F.regexp_replace(F.substring(whole, 1, most), rf"{WHITE}+$", ""), F.lit("...")))


def source_links(links: DataFrame, excluded: Column, most: int = 5) -> DataFrame:
    """The first most links (topic, seq, url, title, ...) of each topic that have a link and a title and aren't excluded."""
    rows = links.withColumn("url", trimmed(F.col("url"))).withColumn("title", trimmed(F.col("title"))).where("url <> '' AND title <> ''").where(~excluded)
    place = F.row_number().over(Window.partitionBy("topic").orderBy("seq"))
    return rows.withColumn("place", place).where(F.col("place") <= most)


def radar(items: DataFrame, suppressed: Column) -> DataFrame:
    """One row that counts the items a report shows (status, section): all, and those of each section, which the status
    decides or else where they stand; suppressed is passed through."""
    section = F.col("section")
    for status, name in STATUS_SECTIONS.items():
        section = F.when(F.col("status") == status, name).otherwise(section)
    rows = items.withColumn("_section", section)
    return rows.agg(F.count("*").alias("anomaly"), *[F.count_if(F.col("_section") == s).alias(n) for n, s in RADAR.items()]).withColumn("suppressed", suppressed)


def may_send(runs: DataFrame, executed: DataFrame) -> DataFrame:
    """Runs (run_id, day, period, once, analyzed) that may send the day's brief.

    Outside a period that is analyzed once, any may; inside, one with an analysis if no run before it (day, period in
    executed) has sent.
    """
    done = executed.select("day", "period").distinct().withColumn("_done", F.lit(True))
    gated = F.coalesce("once", F.lit(False)) & (F.coalesce("period", F.lit("")) != "")
    rows = runs.join(done, ["day", "period"], "left").where(~gated | (F.coalesce("analyzed", F.lit(False)) & F.col("_done").isNull()))
    return rows.select(*runs.columns)


def titles_left(count: Column, listed: Column, visible: Column) -> Column:
    """How many titles a group has when some of those listed aren't shown; a list that was cut off isn't the whole count."""
    return F.greatest(visible, F.coalesce(count, listed) - (listed - visible))


def storage_status(partitions: DataFrame) -> DataFrame:
    """One row about daily partitions (day, kind, rows, bytes): days, the first and last one, rows and bytes, and how many
    days of those between have none."""
    out = partitions.agg(F.countDistinct("day").alias("days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))
    return out.withColumn("missing_days", F.datediff("last_day", "first_day") + 1 - F.col("days"))
