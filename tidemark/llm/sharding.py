"""Sharding by jump consistent hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.prefix_sums import hash_key, running_totals
from tidemark.plans.scratch import cut

OVERHEAD_BYTES = 16
CHUNK = 1_000_000


def _mixed(keys: np.ndarray) -> np.ndarray:
    """Finalize integer keys, so that consecutive ones give independent jump sequences."""
    x = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each integer key: 0 .. shards - 1, from the key and the number of shards alone.

    Each key walks its own pseudo-random sequence of jumps; the last jump below shards is its shard. With one more
    shard, a key either stays or moves into the new one, which takes 1 / (shards + 1) of the keys.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state = _mixed(np.asarray(keys, dtype=np.int64).view(np.uint64))
    shard, ahead = np.zeros(len(state), np.int64), np.zeros(len(state), np.int64)
    walking = np.arange(len(state))
    while walking.size:
        shard[walking] = ahead[walking]
        state[walking] = state[walking] * np.uint64(2862933555777941757) + np.uint64(1)
        draw = ((state[walking] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        ahead[walking] = ((shard[walking] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        walking = walking[ahead[walking] < shards]
    return shard


def shard_documents(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Deal documents to shards 0 .. shards - 1 by their key alone; one row for each row of docs.

    Returns key, size (UTF-8 bytes of the text plus 16), text_crc32, law ('key'), shard, slot (place in the shard,
    gapless from 0) and grown_shard (the shard if there is one more). Null keys count as key -1 for the hash and stay
    null in the result; a null text has no bytes; repeated rows get a slot each. Other columns are not read.
    """

    @F.pandas_udf("shard int, grown_shard int")
    def dealt(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for keys in batches:
            ids = keys.fillna(-1).to_numpy(np.int64)
            yield pd.DataFrame({"shard": jump_hash(ids, shards).astype("int32"), "grown_shard": jump_hash(ids, shards + 1).astype("int32")})

    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        (F.octet_length(body) + OVERHEAD_BYTES).cast("long").alias("size"),
        F.crc32(body.cast("binary")).cast("long").alias("text_crc32"),
    )
    # equal rows are counted before the shuffle, so that a key of many rows stays one row until the end
    equal = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("_rows"))
    place = dealt(F.coalesce("doc_id", F.lit(-1).cast("long")))
    equal = equal.withColumn("_place", place).select("*", "_place.shard", "_place.grown_shard").drop("_place")
    equal = cut(equal.withColumn("_key", hash_key("doc_id", "size", "text_crc32")), "shards")
    first = running_totals(equal, "shard", "_key", ["doc_id", "size", "text_crc32"], F.col("_rows"), "_first")
    chunks = first.withColumn("_chunk", F.explode(F.expr(f"sequence(0L, (_rows - 1) div {CHUNK})")))
    each = chunks.withColumn("_at", F.explode(F.expr(f"sequence(_chunk * {CHUNK}, least(_rows, (_chunk + 1) * {CHUNK}) - 1)")))
    return each.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_first") + F.col("_at")).alias("slot"), "grown_shard"
    )
