"""A run's sources: what was asked, what answered, what came back after a failure, and what that means for its decisions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scoring import Coverage
from tidemark.plans.state_folder import StateFolder

#: What is kept between runs.
SOURCES = "kind string, source_id string, succeeded boolean"


def clean_sources(rows: DataFrame) -> DataFrame:
    """Sources (kind, source_id, succeeded) trimmed, without blank ones, one row each; one that both answered and failed answered."""
    named = rows.select("kind", F.trim("source_id").alias("source_id"), "succeeded").where("source_id <> ''")
    return named.groupBy("kind", "source_id").agg(F.coalesce(F.bool_or("succeeded"), F.lit(False)).alias("succeeded"))


@dataclass(frozen=True)
class Health:
    """status: healthy, degraded or fail_closed, with the reasons; trusted: whether newness can be told from a source's return."""

    status: str
    reasons: tuple[str, ...]
    coverage: Coverage
    trusted: bool
    recovered: DataFrame


def run_health(sources: DataFrame, state: StateFolder, age_minutes: float | None, stale: float = 120, least_ratio: float = 0.67, penalise: bool = False) -> Health:
    """Health of a run whose sources (kind, source_id, succeeded) were all asked, by the state that the run before left.

    It fails closed where ranked lists were asked and none answered, or the input is older than stale minutes; it is
    degraded where fewer lists than least_ratio, or no feed that was asked, answered. Recovered are sources that failed
    the last time and answered now. Counts are all that comes to the driver.
    """
    rows = clean_sources(sources)
    n = {r["kind"]: (r["asked"], r["good"]) for r in rows.groupBy("kind").agg(F.count("*").alias("asked"), F.count_if("succeeded").alias("good")).where(F.col("kind").isin("hotlist", "rss")).collect()}
    (lists, good_lists), (feeds, good_feeds) = n.get("hotlist", (0, 0)), n.get("rss", (0, 0))
    closed = [why for why, so in (("hotlist_all_failed", lists > 0 and not good_lists), ("stale_input", age_minutes is not None and age_minutes > stale)) if so]
    low = [why for why, so in (("hotlist_success_ratio_low", good_lists > 0 and good_lists / lists < least_ratio), ("rss_all_failed", feeds > 0 and not good_feeds)) if so]
    before = state.load()
    recovered = clean_sources(before.rows).where("NOT succeeded").join(rows.where("succeeded"), ["kind", "source_id"], "left_semi").select("kind", "source_id")
    status = "fail_closed" if closed else "degraded" if low else "healthy"
    return Health(status, (*closed, *low), Coverage(lists + feeds, good_lists + good_feeds, penalise), before.trusted, recovered)


def end_run(sources: DataFrame, state: StateFolder, recorded_at: str) -> str:
    """Keep which sources answered, for the next run."""
    return state.save(clean_sources(sources), recorded_at)


def marked(items: DataFrame, health: Health, source: Column) -> DataFrame:
    """Items with after_gap: their source (of their kind) has just come back."""
    back = health.recovered.select(F.col("kind").alias("_kind"), F.col("source_id").alias("_back"), F.lit(True).alias("_gap"))
    rows = items.withColumn("_owner", F.trim(source)).join(back, (F.col("kind") == F.col("_kind")) & (F.col("_owner") == F.col("_back")), "left")
    return rows.withColumn("after_gap", F.coalesce("_gap", F.lit(False))).drop("_owner", "_kind", "_back", "_gap")
