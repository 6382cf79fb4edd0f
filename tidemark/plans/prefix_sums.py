"""Distributed running totals and gapless ranks inside groups of any size."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.scratch import cut

HASH_SPACE = 1 << 60


def hash_key(*cols: Column | str) -> Column:
    """A hash-random key in [0, 2**60)."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 4)


def running_totals(df: DataFrame, group: str, key: str, ties: list[str], amount: Column, out: str) -> DataFrame:
    """Add out: the sum of amount over the rows of the same group that come earlier in (key, ties).

    key is uniform in [0, 2**60). Its range is cut into sqrt(n) equal buckets, so no task orders more than about
    sqrt(n) buckets or the rows of one bucket, also where one group holds most of the rows. df is read three times
    and should be a table. Rows equal in key and all ties are interchangeable. The amount must not be null.
    """
    n = df.count()
    buckets = max(1, math.isqrt(n))
    width = HASH_SPACE // buckets + 1
    df = df.withColumn("_bucket", F.expr(f"{key} div {width}"))
    earlier = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        df.groupBy(group, "_bucket")
        .agg(F.sum(amount).alias("_sum"))
        .select(F.col(group).alias("_g"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    )
    inside = Window.partitionBy(group, "_bucket").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("_local", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    joined = local.join(bases, (local[group] == bases["_g"]) & (local["_bucket"] == bases["_b"]))
    return joined.withColumn(out, (F.col("_base") + F.col("_local")).cast("long")).drop("_bucket", "_local", "_g", "_b", "_base")


def positions(df: DataFrame, order: list[Column], out: str, per_task: int = 200_000) -> DataFrame:
    """Add out: the row's place, from 0, in an order of all rows; the order should end in a unique column.

    The rows are parted by ranges of that order and written once, so places inside a part come from one sort of at
    most some multiple of per_task rows, and the parts' sizes from a prefix sum over one row a part.
    """
    parts = max(1, -(-df.count() // per_task))
    table = cut(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = table.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return table.withColumn("_at", inside).join(bases, "_part").withColumn(out, (F.col("_base") + F.col("_at")).cast("long")).drop("_part", "_at", "_base")
