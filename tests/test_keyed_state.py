import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators.state import cooldowns, merged_state, time_to_live
from tidemark.streaming.keyed_state import cooling, deferring
from tidemark.streaming.micro_batches import EVENT_STATE

T0 = datetime(2024, 1, 1)
EVENTS = "event_key string, level string, seen_at timestamp, seq long"


def run_batches(spark, tmp_path, batches, schema, build):
    """Each batch as a micro-batch of its own; the rows that came out of each, and the state's rows after each."""
    src, log, out, sizes = tmp_path / "in", str(tmp_path / "log"), [], []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        got = []
        stream = build(spark.readStream.schema(schema).parquet(str(src)))
        q = stream.writeStream.foreachBatch(lambda df, n, got=got: got.extend(df.collect())).option("checkpointLocation", log).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        out.append(got)
        sizes.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    return out, sizes


def test_cooldowns_equal_the_batch_operator(spark, tmp_path):
    rnd, batches, seq = random.Random(7), [], 0
    for k in range(5):
        rows = []
        for _ in range(12):
            seq += 1
            rows.append((f"e{rnd.randrange(5)}", rnd.choice(["watch", "alert", "urgent", "odd"]), T0 + timedelta(minutes=130 * k + rnd.randrange(60)), seq))
        batches.append(rows + rows[:2])
    got, _ = run_batches(spark, tmp_path, batches, EVENTS, lambda s: cooling(s, "1 day"))
    state = spark.createDataFrame([], EVENT_STATE)
    for rows, out in zip(batches, got, strict=True):
        batch = spark.createDataFrame(rows, EVENTS)
        best = merged_state(state.limit(0), batch)
        want = cooldowns(best, state, F.col("seen_at")).select("event_key", "seq", "level", "seen_level", "repeat_status", "action", "dispatch").collect()
        assert sorted(map(tuple, out)) == sorted(map(tuple, want)) and want
        state = spark.createDataFrame(merged_state(state, batch).collect(), EVENT_STATE)


def test_expired_events_leave_the_state_and_late_ones_are_dropped(spark, tmp_path):
    day = timedelta(days=1)
    batches = [[(f"old{i}", "alert", T0, i) for i in range(20)], [("x", "alert", T0 + 9 * day, 30)], [("y", "alert", T0 + 9 * day, 31), ("old3", "alert", T0 + 1 * day, 32)], [("old5", "alert", T0 + 9 * day, 33)]]
    got, sizes = run_batches(spark, tmp_path, batches, EVENTS, lambda s: cooling(s, "1 hour", 240, time_to_live(240)))
    assert sizes[0] >= 20 and sizes[-1] < 10
    assert [r["event_key"] for r in got[2]] == ["y"]
    assert [(r["event_key"], r["repeat_status"], r["seen_level"]) for r in got[3]] == [("old5", "new", None)]


def test_deferred_entries_flush_or_expire(spark, tmp_path):
    schema = "event_key string, entry_id string, level string, seen_at timestamp, seq long, flush boolean"
    hour = timedelta(hours=1)
    batches = [
        [("a", "a1", "alert", T0, 1, False), ("b", "b1", "alert", T0, 2, False), ("c", "c1", "urgent", T0, 3, False)],
        [("a", "a2", "urgent", T0 + hour, 4, False), ("c", "c2", "alert", T0 + hour, 5, False), ("d", "d1", "alert", T0 + hour, 6, True)],
        [("a", None, None, T0 + 2 * hour, 7, True), ("b", "b2", "alert", T0 + 13 * hour, 8, False)],
        [("z", "z1", "alert", T0 + 14 * hour, 9, False)],
        [("z", None, None, T0 + 15 * hour, 10, True)],
    ]
    got, _ = run_batches(spark, tmp_path, batches, schema, lambda s: deferring(s, "1 minute"))
    left = sorted((r["event_key"], r["entry_id"], r["level"], r["outcome"]) for rows in got for r in rows)
    assert left == [("a", "a1", "urgent", "flushed"), ("b", "b1", "alert", "expired"), ("c", "c1", "urgent", "expired"), ("z", "z1", "alert", "flushed")]
