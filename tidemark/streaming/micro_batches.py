"""The state operators over streams, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidemark.operators.history import upserted
from tidemark.operators.state import cooldowns, merged_state

STATE = "source_id STRING, item_id LONG, title STRING, url STRING, first_time TIMESTAMP, last_time TIMESTAMP, crawl_count LONG"
EVENT_STATE = "event_key STRING, level STRING, seen_at TIMESTAMP, seq LONG"


class Versions:
    """A state table in folders by batch number. A batch that runs again reads the one before it and replaces its own."""

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root, schema

    def _numbers(self) -> list[int]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not fs.exists(p):
            return []
        done = [s.getPath().getName() for s in fs.listStatus(p) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(int(n[6:]) for n in done if n.startswith("batch="))

    def before(self, batch: int) -> DataFrame:
        older = [n for n in self._numbers() if n < batch]
        if not older:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/batch={older[-1]}")

    def put(self, batch: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/batch={batch}")

    def latest(self) -> DataFrame:
        return self.before(1 << 62)


def upserting(stream: DataFrame, root: str) -> DataStreamWriter:
    """A stream of (source_id, item_id, batch, seq, title, url) into a state table, exactly once for each batch."""
    store = Versions(stream.sparkSession, root, STATE)

    def each(batch: DataFrame, number: int) -> None:
        store.put(number, upserted(store.before(number), batch).select("source_id", "item_id", "title", "url", "first_time", "last_time", F.col("crawl_count").cast("long").alias("crawl_count")))

    return stream.writeStream.foreachBatch(each)


def alerting(stream: DataFrame, root: str, sink: Callable[[DataFrame, int], None], stale_minutes: int = 120, cooldown: int = 240) -> DataStreamWriter:
    """A stream of (event_key, level, seen_at, seq): what may be dispatched goes to sink, and state is kept.

    The batch's own latest event is its time, so a replay decides alike. Rows more than stale_minutes behind it are
    late and dispatch nothing. State takes in a batch after the sink has it; the sink gets the batch's number, with
    which it can tell a repeated batch.
    """
    store = Versions(stream.sparkSession, root, EVENT_STATE)

    def each(batch: DataFrame, number: int) -> None:
        now = batch.agg(F.max("seen_at").alias("now"))
        before = store.before(number)
        fresh = batch.join(F.broadcast(now)).where(F.unix_timestamp("now") - F.unix_timestamp("seen_at") <= stale_minutes * 60)
        best = merged_state(before.limit(0), fresh.drop("now"))
        decided = cooldowns(best.join(F.broadcast(now)), before, F.col("now"), cooldown).where("dispatch")
        sink(decided.select("event_key", "level", "repeat_status", "action"), number)
        store.put(number, merged_state(before, batch.select("event_key", "level", "seen_at", "seq")))

    return stream.writeStream.foreachBatch(each)


def daily_counts(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Observations of each source and day of a stream with (ts, source_id); days close when the watermark passes."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("day"), "source_id").agg(F.count("*").alias("n"), F.min("rank").alias("best"))
