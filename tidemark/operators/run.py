"""One run from items to what is sent: health, decisions, cooldown, quiet hours, and state kept once at the end."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.moments import in_window
from tidemark.functions.text import event_key
from tidemark.operators.candidates import Settings, decide
from tidemark.operators.runs import Health, end_run, marked, run_health
from tidemark.operators.state import cooldowns, deferred, merged_state, removed, time_to_live, unexpired
from tidemark.plans.scratch import cut
from tidemark.plans.state_folder import StateFolder

EVENTS = "event_key STRING, level STRING, seen_at TIMESTAMP, seq LONG"
QUEUE = "event_key STRING, entry_id STRING, level STRING, deferred_at TIMESTAMP"


@dataclass(frozen=True)
class States:
    """What is kept between runs: events that were sent (EVENTS), the queue of deferred ones (QUEUE), how sources did (runs.SOURCES)."""

    events: StateFolder
    queue: StateFolder
    sources: StateFolder


@dataclass(frozen=True)
class Run:
    """outcomes: a row for each candidate; reason: ready, or why nothing is sent."""

    outcomes: DataFrame
    health: Health
    sent: int
    high_suppressed: int
    reason: str


def _live(events: DataFrame, now: datetime, cooldown: int) -> DataFrame:
    """Events whose time to live isn't over; those of unknown levels or from the future stay."""
    seconds = F.lit(None).cast("long")
    for level, live in time_to_live(cooldown).items():
        seconds = F.when(F.col("level") == level, F.lit(live)).otherwise(seconds)
    age = F.unix_timestamp(F.lit(now)) - F.unix_timestamp("seen_at")
    return events.where(F.coalesce(age <= seconds, F.lit(True)))


def outcomes(decisions: DataFrame, events: DataFrame, now: datetime, open_: bool, quiet: tuple[str, str] | None = None, most: int = 3, cooldown: int = 240) -> DataFrame:
    """decisions (event_key, level, push, fresh, score, display_title, candidate_id) with repeat_status, action and outcome.

    The first reason counts: not_eligible (no alert), closed (the run may send nothing), not_fresh (nothing of it was
    observed now), cooldown (by the events sent before), deferred (quiet hours, which urgent ones pass), over_limit (past
    the most best ones, by level, score, title and id), and else sent.
    """
    at = F.lit(now)
    rows = cooldowns(decisions, _live(events, now, cooldown), at, cooldown)
    is_quiet = in_window(F.date_format(at, "HH:mm"), *quiet) if quiet else F.lit(False)
    why = (
        F.when(~F.col("push"), "not_eligible")
        .when(F.lit(not open_), "closed")
        .when(~F.col("fresh"), "not_fresh")
        .when(~F.col("dispatch"), "cooldown")
        .when(is_quiet & ~F.col("past_quiet"), "deferred")
    )
    rows = rows.withColumn("outcome", why).drop("dispatch")
    order = [F.when(F.col("level") == "urgent", 0).otherwise(1), F.desc("score"), F.lower("display_title"), F.col("candidate_id")]
    best = rows.where("outcome IS NULL").withColumn("place", F.row_number().over(Window.partitionBy(F.col("push")).orderBy(*order))).where(F.col("place") <= most)
    best = best.select("candidate_id", F.lit(True).alias("_sent"))
    named = F.coalesce("outcome", F.when(F.coalesce("_sent", F.lit(False)), "sent").otherwise("over_limit"))
    return rows.join(best, "candidate_id", "left").withColumn("outcome", named).drop("_sent")


def run_once(
    items: DataFrame,
    sources: DataFrame,
    states: States,
    now: datetime,
    sink: Callable[[DataFrame], bool],
    settings: Settings | None = None,
    age_minutes: float | None = None,
    quiet: tuple[str, str] | None = None,
    most: int = 3,
    cooldown: int = 240,
) -> Run:
    """A run over items (as candidates.decide takes them, and observed) whose sources (kind, source_id, succeeded) were asked.

    Items are read once: their clusters are one table that all else comes from, and outcomes another, which sink gets the
    sent rows of. Only if sink returns true are sent events kept; deferred ones are kept in any case, and what was sent
    leaves the queue. A state that can't be trusted, or an input that fails closed, sends nothing and keeps the event
    state as it is. What sources did is kept last, so a run that dies before is as if it had not been.
    """
    health = run_health(sources, states.sources, age_minutes)
    seen, queue = states.events.load(), states.queue.load()
    open_ = seen.trusted and queue.trusted and health.status != "fail_closed"
    settings = replace(settings or Settings(), coverage=health.coverage, trusted=health.trusted)
    rows = marked(items, health, F.when(F.col("kind") == "rss", F.col("feed_id")).otherwise(F.col("source_id")))
    decisions = decide(rows, settings).withColumn("event_key", event_key(F.col("display_title")))
    out = cut(outcomes(decisions, seen.rows, now, open_, quiet, most, cooldown), "outcomes")
    counts = out.agg(F.count_if(F.col("outcome") == "sent").alias("sent"), F.count_if(F.col("outcome") == "deferred").alias("deferred"), F.count_if((F.col("level") == "suppress") & (F.col("score") >= settings.urgent) & ~F.col("by_wish")).alias("high")).first()
    reason = "ready" if counts["sent"] else "ready_suppressed_only" if open_ and counts["high"] else "deferred_quiet_hours" if counts["deferred"] else "no_selected_candidates"
    reason = reason if open_ else "state_error" if health.status != "fail_closed" else health.reasons[0]
    sent = out.where("outcome = 'sent'")
    accepted = bool(counts["sent"]) and bool(sink(sent))
    stamp, at = now.isoformat(), F.lit(now)
    if accepted:
        new = sent.select("event_key", "level", at.alias("seen_at"), F.lit(0).cast("long").alias("seq"))
        states.events.save(merged_state(_live(seen.rows, now, cooldown), new), stamp)
    if open_ and (accepted or counts["deferred"]):
        kept = unexpired(queue.rows, at)
        kept = removed(kept, sent.select("event_key")) if accepted else kept
        waiting = out.where("outcome = 'deferred'").select("event_key", F.col("candidate_id").alias("entry_id"), "level", at.alias("deferred_at"), F.lit(0).cast("long").alias("seq"))
        states.queue.save(deferred(kept, waiting), stamp)
    end_run(sources, states.sources, stamp)
    return Run(out, health, counts["sent"] if accepted else 0, counts["high"], reason)
