"""Titles by keyword rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ranks import is_visible
from tidemark.operators.adapters import titles_for_mode
from tidemark.plans.rules import Rules


def names_of(rules: Rules) -> Column:
    pairs = [F.lit(x) for g in rules.groups for x in (g.position, g.name)]
    return F.create_map(*pairs)


def assigned(titles: DataFrame, rules: Rules, title: str = "title") -> DataFrame:
    """Titles with group_no, the first group that matches."""
    return titles.withColumn("group_no", rules.first_group(F.col(title)))


def group_counts(titles: DataFrame, rules: Rules, title: str = "title") -> DataFrame:
    """Titles in each group, and their share of all titles, those without group included."""
    rows = assigned(titles, rules, title)
    whole = rows.agg(F.count("*").alias("whole"))
    counts = rows.where("group_no IS NOT NULL").groupBy("group_no").agg(F.count("*").alias("n"))
    out = counts.join(F.broadcast(whole))
    return out.select("group_no", F.element_at(names_of(rules), F.col("group_no")).alias("group_name"), "n", (F.col("n") * 100.0 / F.col("whole")).alias("percentage"))


def counts_for_mode(folded: DataFrame, new: DataFrame, rules: Rules, mode: str, first_crawl: bool = False, title: str = "title") -> DataFrame:
    """group_counts of the titles that a run mode looks at (adapters.titles_for_mode), with how many are new and the best rank.

    folded are titles with their ranks over the day (source_id, item_id, title, ranks, last_time, ...). Without groups
    all titles are one, and only global filters rule any out. The share is of all titles that the mode looks at; on a
    mode's empty titles there are no groups.
    """
    rows = titles_for_mode(folded, new, mode, first_crawl)
    group = rules.first_group(F.col(title)) if rules.groups else F.when(rules.passes(F.col(title)), F.lit(0))
    best = F.array_min(F.filter("ranks", is_visible))
    rows = rows.select(group.alias("group_no"), "is_new", best.alias("best"))
    whole = rows.agg(F.count("*").alias("whole"))
    counts = rows.where("group_no IS NOT NULL").groupBy("group_no").agg(F.count("*").alias("n"), F.count_if("is_new").alias("n_new"), F.min("best").alias("best"))
    return counts.join(F.broadcast(whole)).select("group_no", "n", "n_new", "best", (F.col("n") * 100.0 / F.col("whole")).alias("percentage"))


def capped(titles: DataFrame, rules: Rules, order: list[Column], cap: int = 0, title: str = "title") -> DataFrame:
    """The first titles of each group in an order that ends in a sequence number; @N of a group before the general cap.

    Where every group has a cap, the largest is a plain limit on the window, which Spark then applies to each
    partition before it shuffles, so a hot group doesn't meet in one task.
    """
    rows = assigned(titles, rules, title).where("group_no IS NOT NULL")
    caps = F.create_map(*[F.lit(x) for g in rules.groups for x in (g.position, g.most or cap)])
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy("group_no").orderBy(*order)))
    most, limits = F.element_at(caps, F.col("group_no")), [g.most or cap for g in rules.groups]
    if limits and min(limits) > 0:
        ranked = ranked.where(F.col("place") <= max(limits))
    return ranked.where((most == 0) | (F.col("place") <= most))


def catch_all(titles: DataFrame, rules: Rules, worst_rank: int = 5, most: int = 5, title: str = "title") -> DataFrame:
    """High-ranked titles in no group: deduplicated by title, the first seen stays even where a later one is higher."""
    rows = titles.where(rules.passes(F.col(title)) & rules.first_group(F.col(title)).isNull())
    first = rows.groupBy(title).agg(F.min(F.struct("seq", "source_id", "rank")).alias("first")).select(title, "first.*")
    return first.where(F.col("rank") <= worst_rank).orderBy("rank", title).limit(most).select(F.substring(title, 1, 30).alias("group_name"), title, "source_id", "rank")


def swallowed(titles: DataFrame, rules: Rules, title: str = "title") -> DataFrame:
    """(winner, other, n): titles that the winner took and another group matched too."""
    rows = titles.select(rules.all_groups(F.col(title)).alias("hits")).where("size(hits) > 1")
    pairs = rows.select(F.col("hits")[0].alias("winner"), F.explode(F.expr("slice(hits, 2, size(hits))")).alias("other"))
    return pairs.groupBy("winner", "other").agg(F.count("*").alias("n"))


def matched_any(text: Column, words: list[str]) -> Column:
    return reduce(Column.__or__, [F.lower(text).contains(w.lower()) for w in words], F.lit(False))
