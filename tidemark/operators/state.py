"""Keyed state between batches, as joins on state tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scores import LEVELS, cooldown_action, level_number, phase, repeat_status
from tidemark.plans.prefix_sums import positions


def highest_of_each(updates: DataFrame) -> DataFrame:
    """Of updates (event_key, level, seen_at, seq) one a key: the highest level, then the latest, then the last."""
    order = F.struct(F.coalesce(level_number(F.col("level")), F.lit(-1)).alias("n"), F.col("seen_at"), F.col("seq"))
    columns = [c for c in updates.columns if c != "event_key"]
    best = F.max_by(F.struct(*columns), order).alias("best")
    return updates.groupBy("event_key").agg(best).select("event_key", "best.*")


def merged_state(prior: DataFrame, updates: DataFrame) -> DataFrame:
    """State after a batch: the batch's row where it has the key, else the prior one."""
    new = highest_of_each(updates)
    return prior.join(new.select("event_key"), "event_key", "left_anti").unionByName(new)


def cooldowns(candidates: DataFrame, state: DataFrame, now: Column, minutes: int = 240, snapshot_ok: bool = True) -> DataFrame:
    """Candidates (event_key, level) with repeat_status, action and dispatch; a broken state lets nothing through."""
    seen = state.select("event_key", F.col("level").alias("seen_level"), F.col("seen_at").alias("seen_before"))
    rows = candidates.join(seen, "event_key", "left").withColumn("repeat_status", repeat_status(F.lit(True), F.col("seen_level"), F.col("level")))
    age = (F.unix_timestamp(now) - F.unix_timestamp("seen_before")) / 60
    rows = rows.withColumn("action", cooldown_action(F.col("repeat_status"), age, minutes))
    allowed = F.col("action").isin("allow_new", "allow_escalation") & F.col("level").isin("alert", "urgent")
    return rows.withColumn("dispatch", allowed & F.lit(snapshot_ok)).drop("seen_before")


def phases(state: DataFrame, now: Column, ttl_days: int = 7) -> DataFrame:
    """State rows (event_key, level, seen_text) with their phase."""
    seen = F.try_to_timestamp(F.col("seen_text"))
    return state.withColumn("phase", phase(F.col("seen_text"), seen, now, F.col("level"), ttl_days))


def deferred(queue: DataFrame, incoming: DataFrame) -> DataFrame:
    """A queue (event_key, entry_id, level, deferred_at) with entries put in.

    A key keeps its first entry_id and time; a lower level than the one it has is skipped.
    """
    new = highest_of_each(incoming.withColumnsRenamed({"deferred_at": "seen_at"})).withColumnsRenamed({"seen_at": "new_at", "level": "new_level", "entry_id": "new_id"}).drop("seq")
    both = queue.join(new, "event_key", "full_outer")
    higher = F.coalesce(level_number(F.col("new_level")) >= level_number(F.col("level")), F.col("level").isNull())
    return both.select(
        "event_key", F.coalesce("entry_id", "new_id").alias("entry_id"), F.when(higher, F.col("new_level")).otherwise(F.col("level")).alias("level"), F.coalesce("deferred_at", "new_at").alias("deferred_at")
    )


def unexpired(queue: DataFrame, now: Column, hours: int = 12) -> DataFrame:
    """Entries within their time to live; those without a time stay."""
    age = F.unix_timestamp(now) - F.unix_timestamp("deferred_at")
    return queue.where(F.coalesce(age <= hours * 3600, F.lit(True)))


def flush_order(queue: DataFrame) -> DataFrame:
    return queue.orderBy(F.col("level") != "urgent", "deferred_at", "event_key")


def inserted(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """INSERT OR IGNORE: rows whose key the table hasn't yet; of equal keys in rows, one."""
    return table.unionByName(rows.dropDuplicates(key).join(table.select(*key), key, "left_anti"))


def replaced(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """INSERT OR REPLACE."""
    return table.join(rows.select(*key).distinct(), key, "left_anti").unionByName(rows)


def deprecated(tags: DataFrame, results: DataFrame, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Tags (tag_id, status), all or those of ids, and their results set to deprecated."""
    hit = (tags.select("tag_id") if ids is None else ids.select("tag_id")).distinct().withColumn("_hit", F.lit(True))
    mark = lambda t: t.join(hit, "tag_id", "left").withColumn("status", F.when(F.col("_hit"), "deprecated").otherwise(F.col("status"))).drop("_hit")
    return mark(tags), mark(results)


def health(sources: DataFrame, last_minutes: Column, stale: int = 120, least_ratio: float = 0.67) -> DataFrame:
    """One row from (source_id, kind, succeeded, recovered): ratios and a status; a stale or empty input fails closed."""
    counts = sources.agg(F.count("*").alias("configured"), F.count_if("succeeded").alias("successful"), F.count_if(F.col("recovered") & F.col("succeeded")).alias("recovered"))
    ratio = F.when(F.col("configured") > 0, F.col("successful") / F.col("configured")).otherwise(0.0)
    out = counts.withColumn("ratio", ratio).withColumn("minutes", last_minutes)
    closed = (F.col("minutes") > stale) | (F.col("successful") == 0)
    return out.withColumn("status", F.when(closed, "fail_closed").when(F.col("ratio") < least_ratio, "degraded").otherwise("healthy"))


def budgeted(rows: DataFrame, order: list[Column], size: str, budget: int, block: str) -> DataFrame:
    """Rows of each block while the sum of size in order stays within the budget."""
    so_far = F.sum(size).over(Window.partitionBy(block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("so_far", so_far).where(F.col("so_far") <= budget)


def chunked(rows: DataFrame, order: list[Column], most: int, block: str) -> DataFrame:
    """Rows of each block in chunks of at most so many, numbered from 0, in an order that ends in a unique column.

    Places come from one range sort by block and order, so a block may hold most of the rows.
    """
    placed = positions(rows, [F.col(block), *order], "_place")
    first = placed.groupBy(block).agg(F.min("_place").alias("_first")).withColumnRenamed(block, "_block")
    at = F.col("_place") - F.col("_first")
    return placed.join(first, F.col(block).eqNullSafe(F.col("_block"))).withColumn("chunk", F.floor(at / most).cast("long")).drop("_place", "_first", "_block")


def active_tags(tags: DataFrame, interests: str) -> DataFrame:
    """Active tags (tag_id, interests, status, priority, version, prompt_hash, ...) of a file of interests, by priority."""
    return tags.where((F.col("status") == "active") & (F.col("interests") == interests)).orderBy("priority", "tag_id")


def newest_prompt(tags: DataFrame, interests: str) -> DataFrame:
    """One row: the prompt_hash of the newest active version of a file of interests, of equal versions that of the least tag_id; null without any."""
    rows = tags.where((F.col("status") == "active") & (F.col("interests") == interests))
    return rows.agg(F.max_by("prompt_hash", F.struct("version", (-F.col("tag_id")).alias("before"))).alias("prompt_hash"))


def newest_version(tags: DataFrame) -> DataFrame:
    """One row: the highest version of all tags, 0 without any."""
    return tags.agg(F.coalesce(F.max("version"), F.lit(0)).alias("version"))


def to_be_tried_again(analyzed: DataFrame, interests: str) -> DataFrame:
    """What is analyzed (news_id, interests, matched) without the rows of a file of interests that matched nothing."""
    return analyzed.where(~F.coalesce((F.col("interests") == interests) & ~F.col("matched"), F.lit(False)))


def removed(queue: DataFrame, keys: DataFrame) -> DataFrame:
    """A queue without the entries of keys (event_key)."""
    return queue.join(keys, "event_key", "left_anti")


def time_to_live(cooldown_minutes: int = 240, floor_seconds: int = 7 * 86400) -> dict[str, int]:
    """Seconds that state of each level lives: never less than its cooldown."""
    return dict.fromkeys(LEVELS, max(cooldown_minutes * 60, int(floor_seconds)))
