"""Columns over ranks: 0 means off the list, 99 means that no rank was given."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OFF_LIST, NO_RANK = 0, 99


def is_visible(rank: Column) -> Column:
    return (rank > OFF_LIST) & (rank != NO_RANK)


def rank_kind(rank: Column) -> Column:
    """visible, off_list, no_rank or missing."""
    return F.when(rank.isNull(), "missing").when(rank == OFF_LIST, "off_list").when(rank == NO_RANK, "no_rank").when(rank > 0, "visible").otherwise("invalid")


def best_rank(ranks: Column) -> Column:
    return F.array_min(F.filter(ranks, lambda r: r > 0))


def rank_trend(ranks: Column, least: int = 3) -> Column:
    """升温 (the last rank is better by at least 3), 降温 (worse) or 稳定."""
    moved = F.get(ranks, F.lit(0)) - F.element_at(ranks, -1)
    return F.when(F.size(ranks) < 2, "稳定").when(moved >= least, "升温").when(moved <= -least, "降温").otherwise("稳定")


def news_weight(ranks: Column, count: Column, threshold: int = 5, weights: tuple[float, float, float] = (0.6, 0.3, 0.1)) -> Column:
    """Weight of a title: by how high, how often, and how often at least at the threshold it was ranked."""
    n = F.size(ranks)
    height = F.aggregate(ranks, F.lit(0).cast("long"), lambda t, r: t + (11 - F.least(r, F.lit(10))).cast("long"))
    high = F.size(F.filter(ranks, lambda r: r <= threshold))
    a, b, c = weights
    value = F.lit(a * 10.0) * height / n + F.lit(b * 10.0) * F.least(count, F.lit(10)) + F.lit(c * 100.0) * high / n
    return F.when(n > 0, value).otherwise(F.lit(0.0))
