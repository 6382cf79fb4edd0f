"""Two periods, platforms or lists against each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def shift(before: DataFrame, after: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Counts of two periods side by side: change, and percent of the first, 100 for what is new."""
    both = before.select(key, F.col(n).alias("n_before")).join(after.select(key, F.col(n).alias("n_after")), key, "full_outer").na.fill(0, ["n_before", "n_after"])
    change = F.col("n_after") - F.col("n_before")
    percent = F.when(F.col("n_before") > 0, change * 100.0 / F.col("n_before")).when(F.col("n_after") > 0, 100.0).otherwise(0.0)
    return both.select(key, "n_before", "n_after", change.alias("change"), percent.alias("percent"))


def kinds_of_change(before: DataFrame, after: DataFrame, key: str, most: int = 5) -> DataFrame:
    """new, gone and persistent members of two ranked lists (key, place), each kind's first few in list order."""
    both = before.select(key, F.col("place").alias("place_before")).join(after.select(key, F.col("place").alias("place_after")), key, "full_outer")
    kind = F.when(F.col("place_before").isNull(), "new").when(F.col("place_after").isNull(), "gone").otherwise("persistent")
    rows = both.select(key, kind.alias("kind"), F.coalesce("place_after", "place_before").alias("place"))
    ranked = rows.withColumn("at", F.row_number().over(Window.partitionBy("kind").orderBy("place", key)))
    return ranked.where(F.col("at") <= most).select(key, "kind", F.col("at").cast("long").alias("at"))


def platforms(titles: DataFrame, topic: str) -> DataFrame:
    """Per source: titles, distinct titles, mentions of a topic and the share of titles that mention it."""
    hit = F.lower("title").contains(topic.lower())
    return titles.groupBy("source_id").agg(
        F.count("*").alias("n"), F.countDistinct("title").alias("distinct_titles"), F.count_if(hit).alias("mentions"), (F.count_if(hit) * 100.0 / F.count("*")).alias("coverage")
    )


def activity(titles: DataFrame) -> DataFrame:
    """Per source: titles, days with any, titles an active day, and their share of all days."""
    days = titles.agg(F.countDistinct("day").alias("all_days"))
    rows = titles.groupBy("source_id").agg(F.count("*").alias("n"), F.countDistinct("day").alias("days_active"))
    out = rows.join(F.broadcast(days))
    return out.select("source_id", "n", "days_active", (F.col("n") / F.col("days_active")).alias("per_day"), (F.col("days_active") * 100.0 / F.col("all_days")).alias("activity_score"))


def set_difference(one: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Each key with where it is: one, other or both."""
    a, b = one.select(key).distinct().withColumn("_a", F.lit(True)), other.select(key).distinct().withColumn("_b", F.lit(True))
    both = a.join(b, key, "full_outer")
    return both.select(key, F.when(F.col("_b").isNull(), "one").when(F.col("_a").isNull(), "other").otherwise("both").alias("where_is"))
