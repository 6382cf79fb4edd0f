"""Score, decision and label tables as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def steps(value: Column, table: list[tuple[int, float]], otherwise: float, up: bool = True) -> Column:
    """The first entry whose bound value doesn't pass (up) or doesn't stay under; null for null."""
    out = F.when(value.isNull(), F.lit(None).cast("double"))
    for bound, score in table:
        out = out.when((value <= bound) if up else (value >= bound), F.lit(float(score)))
    return out.otherwise(F.lit(float(otherwise)))


def clamp(value: Column, most: float) -> Column:
    """value within 0 and most; not a number or infinite is an error."""
    bad = F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(bad, F.raise_error(F.lit("score isn't finite")).cast("double")).otherwise(F.least(F.greatest(value, F.lit(0.0)), F.lit(float(most))))


FIRST_ENTRY = [(3, 30), (10, 27), (20, 23), (50, 15), (100, 8)]


def movement(rank: Column, previous: Column, had_before: Column, visible_before: Column, observations: Column, count: Column, reliable: Column) -> Column:
    """Rank movement of an item: first entry, re-entry, improvement since the row just before, or a stable top place."""
    entry, delta = steps(rank, FIRST_ENTRY, 3), previous - rank
    better = (
        F.when((delta >= 50) & (rank <= 20), 28.0).when((delta >= 30) & (rank <= 20), 25.0).when(delta >= 20, 21.0).when(delta >= 10, 15.0).when(delta >= 5, 9.0).otherwise(0.0)
    )
    better = F.when(rank > 100, F.least(better, F.lit(6.0))).when(rank > 50, F.least(better, F.lit(12.0))).otherwise(better)
    stable = F.when(rank <= 10, 3.0).when(rank <= 20, 2.0).otherwise(0.0)
    damped = F.when((observations <= 1) & (count <= 1), entry * 0.7).otherwise(entry)
    return F.when(~reliable | rank.isNull(), 0.0).when(~had_before, damped).when(~visible_before, entry).when(delta > 0, better).otherwise(stable)


def burst(rank: Column, is_new: Column, sources: Column) -> Column:
    value = steps(rank, [(3, 13), (10, 12), (20, 10), (50, 7), (100, 4)], 2)
    value = F.when((sources <= 1) & (rank > 100), value * 0.65).when((sources <= 1) & (rank > 50), value * 0.8).otherwise(value)
    return F.when(~is_new | rank.isNull(), 0.0).otherwise(value)


def recency(is_new: Column, has_first: Column, has_last: Column, synthetic: Column) -> Column:
    value = F.when(is_new, 8.0).when(has_first & has_last, 4.0).when(has_first | has_last, 2.0).otherwise(0.0)
    return F.when(synthetic, F.least(value, F.lit(3.0))).otherwise(F.least(value, F.lit(10.0)))


def persistence(visible: Column, rank: Column, count: Column) -> Column:
    seen = F.when((visible >= 3) & (rank <= 20), 5.0).when((visible >= 3) & (rank <= 50), 4.0).when((visible >= 2) & (rank <= 50), 3.0).when((visible >= 2) & (rank <= 100), 2.0)
    return F.coalesce(seen, F.when(count >= 5, 3.0).when(count >= 3, 2.0).when(count >= 2, 1.0).otherwise(0.0))


def heat(best: Column, sources: Column, items: Column) -> Column:
    a = F.coalesce(steps(best, [(3, 30), (10, 26), (20, 22), (50, 16), (100, 10)], 4), F.lit(0.0))
    b = steps(sources, [(4, 12), (3, 8), (2, 5), (1, 2)], 0, up=False)
    c = steps(items, [(4, 8), (3, 5), (2, 3), (1, 1)], 0, up=False)
    return clamp(a + b + c, 50)


def strength(a: Column, b: Column, c: Column, d: Column) -> Column:
    n = sum((x.cast("int") for x in (b, c, d)), a.cast("int"))
    return F.when(((a | b) & (c | d)) | (n >= 3), "strong").when(n == 2, "moderate").otherwise("weak")


def cross_layer(a: Column, b: Column, c: Column, d: Column) -> Column:
    n = sum((x.cast("int") for x in (b, c, d)), a.cast("int"))
    how = strength(a, b, c, d)
    value = F.when(how == "strong", 7.0).when(how == "moderate", 4.0).otherwise(0.0) + F.when(n >= 2, 4.0).otherwise(0.0)
    return clamp(value + F.when(n >= 4, 4.0).when(n == 3, 2.0).when(n == 2, 1.0).otherwise(0.0), 15)


def total(growth: Column, warm: Column, cross: Column, how: Column) -> Column:
    by = F.when(how == "strong", 1.10).when(how == "moderate", 1.00).otherwise(0.88)
    main = F.least(growth + warm, F.lit(80.0)) * by
    return clamp(main + F.least(F.least(cross, F.lit(20.0)) * 0.25, F.lit(5.0)), 100)


def decision(score: Column, suppressed: Column) -> Column:
    return F.when(suppressed, "suppress").when(score >= 80, "urgent").when(score >= 60, "alert").otherwise("watch")


LEVELS = {"suppress": 0, "watch": 1, "alert": 2, "urgent": 3}


def level_number(level: Column) -> Column:
    out = F.when(level == "suppress", 0)
    for name, n in list(LEVELS.items())[1:]:
        out = out.when(level == name, n)
    return out


def evidence_label(a: Column, b: Column, c: Column, d: Column, high_d: Column, feeling: Column) -> Column:
    """cross_layer_verified, chinese_only_hot, high_heat_unverified, sentiment_heavy, silence_gap or null."""
    alone = F.when(high_d, "high_heat_unverified").when(feeling, "sentiment_heavy")
    return F.when(d & (a | b), "cross_layer_verified").when(d & c, "chinese_only_hot").when(d, alone).when(a | b, "silence_gap")


def repeat_status(snapshot: Column, seen_level: Column, level: Column) -> Column:
    old, new = level_number(seen_level), level_number(level)
    known = F.when(old.isNull() | new.isNull(), "same_event_repeat").when(old == new, "same_level_repeat").when(new > old, "meaningful_escalation").otherwise("deescalation")
    return F.when(~snapshot, "not_evaluated").when(seen_level.isNull(), "new").otherwise(known)


def cooldown_action(status: Column, minutes: Column, cooldown: int = 240) -> Column:
    """What a repeat status asks for; a cooldown that is over lets an event in again, an error lets none."""
    action = F.when(status == "new", "allow_new").when(status == "meaningful_escalation", "allow_escalation").when(status == "not_evaluated", "not_evaluated").otherwise("cooldown")
    return F.when((action == "cooldown") & (minutes >= cooldown), "allow_new").otherwise(action)


def phase(seen_text: Column, seen: Column, now: Column, level: Column, ttl_days: int = 7) -> Column:
    age = F.unix_timestamp(now) - F.unix_timestamp(seen)
    return (
        F.when(F.coalesce(F.trim(seen_text), F.lit("")) == "", "missing_seen_at")
        .when(seen.isNull(), "invalid_seen_at")
        .when(age < 0, "future_seen_at")
        .when(level_number(level).isNull(), "unknown_level")
        .when(age > ttl_days * 86400, "evictable")
        .otherwise("active")
    )


def domestic_confidence(platforms: Column, d_platforms: Column, a: Column, b: Column, c: Column, d: Column) -> Column:
    value = F.when((d_platforms >= 3) | (platforms >= 5), "confirmed").when((d_platforms >= 2) | (platforms >= 3), "high").otherwise("public")
    return F.when(c & d & ~a & ~b, value)
