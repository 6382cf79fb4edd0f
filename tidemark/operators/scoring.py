"""Scores and decisions of candidates from items with all that is known, or not known, of their ranks, times and sources."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scores

ITEM_SCORES = ("movement", "burst", "burst_alone", "recency", "persistence")


@dataclass(frozen=True)
class Coverage:
    """Sources that were asked and those that answered; below least their share lowers scores by factor."""

    configured: int = 0
    successful: int = 0
    penalise: bool = False
    least: float = 0.67
    factor: float = 0.85

    @property
    def ratio(self) -> float | None:
        return min(self.successful, self.configured) / self.configured if self.configured else None

    @property
    def multiplier(self) -> float:
        low = self.penalise and self.ratio is not None and self.ratio < self.least
        return max(0.0, min(1.0, self.factor)) if low else 1.0

    @property
    def warning(self) -> str | None:
        good = min(self.successful, self.configured)
        if good == self.configured:
            return None
        return f"Collection coverage: {good}/{self.configured} ({self.configured - good} failed); scores may be based on incomplete data."


def item_scores(items: DataFrame, trusted: bool = True, first_crawl: bool = False) -> DataFrame:
    """Items from adapters.list_items and feed_items, and after_gap, with the four growth rules' scores.

    movement needs a ranked list's item with a reliable timeline; burst one that is new by detection, not on a day's first
    crawl, with its source not just back from a gap (after_gap), and nothing at all if the record of failures can't be
    trusted; burst_alone is what it is worth as a candidate's only item. recency needs times, and counts at most 3 where
    they are made up. persistence goes by the timeline, or else by the count.
    """
    listed, rank, count = F.col("kind") == "hotlist", F.col("rank"), F.col("count")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    moved = scores.movement(rank, rank + F.col("rank_delta"), yes("has_before"), yes("before_visible"), F.col("times_visible"), count, yes("reliable"))
    fresh = listed & F.lit(trusted and not first_crawl) & yes("is_new") & (F.col("new_meaning") == "new_titles_detection") & ~yes("after_gap")
    first, last = (F.coalesce(F.col(c).cast("string"), F.lit("")) != "" for c in ("first_time", "last_time"))
    lasting = scores.persistence(F.when(yes("reliable"), F.col("times_visible")), rank, F.when(~yes("reliable") & yes("has_count"), count))
    return items.withColumns(
        {
            "movement": F.when(listed, moved).otherwise(0.0),
            "burst": scores.burst(rank, fresh, F.lit(2)),
            "burst_alone": scores.burst(rank, fresh, F.lit(1)),
            "recency": F.when(yes("has_times"), scores.recency(yes("is_new") & F.lit(not first_crawl), first, last, yes("times_made_up"))).otherwise(0.0),
            "persistence": F.when(listed & rank.isNotNull(), lasting).otherwise(0.0),
        }
    )


def source_identity() -> Column:
    """One name for an item's source, by kind: its id, or else its name; null without both."""
    kind, ids = F.col("kind"), F.when(F.col("kind") == "rss", F.col("feed_id")).when(F.col("kind") == "hotlist", F.col("source_id")).otherwise(F.coalesce(F.nullif(F.col("source_id"), F.lit("")), F.col("feed_id")))
    name = F.coalesce(F.nullif(ids, F.lit("")), F.nullif(F.col("source_name"), F.lit("")))
    return F.concat(F.when(kind.isin("hotlist", "rss"), kind).otherwise("unknown"), F.lit(":"), name)


def cross_layer_by_kind(both: Column, one: Column, sources: Column) -> Column:
    """Support of a candidate none of whose sources has a known tier: by kinds of source, and their number."""
    value = F.when(both, 11.0).when(one, 1.0).otherwise(0.0)
    return scores.clamp(value + F.when(sources >= 4, 4.0).when(sources == 3, 2.0).when(sources == 2, 1.0).otherwise(0.0), 15)


def strength_by_kind(both: Column, sources: Column) -> Column:
    return F.when(both | (sources >= 3), "strong").when(sources >= 2, "moderate").otherwise("weak")


def candidate_scores(items: DataFrame, by: str, coverage: Coverage | None = None, trusted: bool = True, first_crawl: bool = False) -> DataFrame:
    """One row for each candidate (column by) of items with kind, source_id, feed_id, source_name, tier and what item_scores needs.

    Of each growth rule the best item counts. Ranks are those of ranked lists: the best current one, or else the best
    known. Support is by tiers where a source has one (A to D), or else by kinds. Coverage that is too low lowers heat
    and support. All is one aggregation; sources are counted by what source_identity gives.
    """
    coverage = coverage or Coverage()
    listed = F.col("kind") == "hotlist"
    rows = item_scores(items, trusted, first_crawl).withColumn("_source", source_identity())
    has = lambda t: F.coalesce(F.bool_or(F.col("tier") == t), F.lit(False)).alias(t.lower())
    out = rows.groupBy(by).agg(
        *[F.max(x).alias(x) for x in ITEM_SCORES],
        F.count("*").alias("items"),
        F.countDistinct("_source").alias("sources"),
        F.min(F.when(listed, F.col("rank"))).alias("best_rank"),
        F.min(F.when(listed, F.col("best_rank"))).alias("best_known"),
        F.bool_or(listed).alias("has_hotlist"),
        F.bool_or(F.col("kind") == "rss").alias("has_rss"),
        *map(has, "ABCD"),
    )
    tiers, both = [F.col(x) for x in "abcd"], F.col("has_hotlist") & F.col("has_rss")
    tiered, burst = tiers[0] | tiers[1] | tiers[2] | tiers[3], F.when(F.col("items") == 1, F.col("burst_alone")).otherwise(F.col("burst"))
    growth = scores.clamp(F.col("movement") + burst + F.col("recency") + F.col("persistence"), 60)
    heat = scores.heat(F.coalesce("best_rank", "best_known"), F.col("sources"), F.col("items"))
    cross = F.when(tiered, scores.cross_layer(*tiers)).otherwise(cross_layer_by_kind(both, F.col("has_hotlist") | F.col("has_rss"), F.col("sources")))
    how = F.when(tiered, scores.strength(*tiers)).otherwise(strength_by_kind(both, F.col("sources")))
    by_coverage = F.lit(coverage.multiplier)
    main = F.least(growth + heat, F.lit(80.0)) * by_coverage
    support = F.least(cross, F.lit(20.0)) * by_coverage
    weight = F.when(how == "strong", 1.10).when(how == "moderate", 1.00).otherwise(0.88)
    score = scores.clamp(main * weight + F.least(support * 0.25, F.lit(5.0)), 100)
    return out.withColumns({"burst": burst, "growth": growth, "heat": heat, "cross": cross, "strength": how, "by_tiers": tiered, "score": score}).drop("burst_alone")


def decided(candidates: DataFrame, suppressed: Column | None = None, alert: float = 60.0, urgent: float = 80.0) -> DataFrame:
    """Candidates (score) with level, push (may be sent) and past_quiet (also in quiet hours); suppressed ones are never sent."""
    score = F.col("score")
    level = F.when(suppressed if suppressed is not None else F.lit(False), "suppress").when(score >= urgent, "urgent").when(score >= alert, "alert").otherwise("watch")
    return candidates.withColumn("level", level).withColumn("push", F.col("level").isin("alert", "urgent")).withColumn("past_quiet", F.col("level") == "urgent")


def high_but_suppressed(decisions: DataFrame, urgent: float = 80.0) -> DataFrame:
    """One row: candidates suppressed for another reason than the reader's wish (by_wish) although their score is urgent."""
    return decisions.agg(F.count_if((F.col("level") == "suppress") & (F.col("score") >= urgent) & ~F.coalesce("by_wish", F.lit(False))).alias("suppressed"))
