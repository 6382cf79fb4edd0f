from datetime import datetime, timedelta
from itertools import product

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scores as S
from tidemark.operators import state as K

T0 = datetime(2024, 1, 1)


def test_label_matrix(spark):
    cases = [(*t, h, f) for t in product([False, True], repeat=4) for h, f in product([False, True], repeat=2)]
    df = spark.createDataFrame(cases, "a boolean, b boolean, c boolean, d boolean, h boolean, f boolean")
    got = df.select("*", S.evidence_label(*[F.col(x) for x in "abcdhf"]).alias("label")).collect()
    assert len(got) == 64
    for r in got:
        if r["d"] and (r["a"] or r["b"]):
            want = "cross_layer_verified"
        elif r["d"] and r["c"]:
            want = "chinese_only_hot"
        elif r["d"]:
            want = "high_heat_unverified" if r["h"] else "sentiment_heavy" if r["f"] else None
        else:
            want = "silence_gap" if r["a"] or r["b"] else None
        assert r["label"] == want


def test_score_of_a_new_item_at_rank_two(spark):
    one = spark.range(1)
    lit, no = F.lit, F.lit(False)
    moved = S.movement(lit(2), lit(None).cast("int"), no, no, lit(1), lit(1), lit(True))
    burst = S.burst(lit(2), lit(True), lit(1))
    warm = S.heat(lit(2), lit(1), lit(1))
    cross = lit(1.0)
    row = one.select(moved, burst, warm, S.total(lit(34.0), lit(33.0), cross, lit("weak"))).first()
    assert [round(x, 6) for x in row] == [21.0, 13.0, 33.0, 59.21]


def test_scores_that_are_no_numbers_are_errors(spark):
    with pytest.raises(Exception, match="finite"):
        spark.createDataFrame([(float("nan"),)], "x double").select(S.clamp(F.col("x"), 10)).collect()


def test_cooldown_ends_after_240_minutes(spark):
    state = spark.createDataFrame([("k", "alert", T0)], "event_key string, level string, seen_at timestamp")
    cases = [("alert", 239, "cooldown", False), ("alert", 240, "allow_new", True), ("urgent", 10, "allow_escalation", True), ("watch", 10, "cooldown", False)]
    for level, minutes, action, dispatch in cases:
        now = F.lit(T0 + timedelta(minutes=minutes))
        row = K.cooldowns(spark.createDataFrame([("k", level)], "event_key string, level string"), state, now).first()
        assert (row["action"], row["dispatch"]) == (action, dispatch)
    broken = K.cooldowns(spark.createDataFrame([("new", "urgent")], "event_key string, level string"), state, F.lit(T0), snapshot_ok=False).first()
    assert not broken["dispatch"]


def test_phases(spark):
    rows = [("1", "alert", "2024-01-01 00:00:00"), ("2", "alert", "2023-12-31 23:59:59"), ("3", "alert", ""), ("4", "alert", "x"), ("5", "alert", "2024-01-09 00:00:00"), ("6", "loud", "2024-01-02 00:00:00")]
    df = spark.createDataFrame(rows, "event_key string, level string, seen_text string")
    got = [r["phase"] for r in K.phases(df, F.lit("2024-01-08").cast("timestamp")).orderBy("event_key").collect()]
    assert got == ["active", "evictable", "missing_seen_at", "invalid_seen_at", "future_seen_at", "unknown_level"]


def test_state_keeps_the_highest_and_merging_twice_changes_nothing(spark):
    schema = "event_key string, level string, seen_at timestamp, seq long"
    up = spark.createDataFrame([("a", "watch", T0, 1), ("a", "alert", T0, 2), ("a", "alert", None, 3), ("b", "watch", T0, 4)], schema)
    prior = spark.createDataFrame([("a", "urgent", T0, 0), ("c", "watch", T0, 0)], schema)
    once = K.merged_state(prior, up)
    assert {(r["event_key"], r["level"], r["seq"]) for r in once.collect()} == {("a", "alert", 2), ("b", "watch", 4), ("c", "watch", 0)}
    assert sorted(once.collect()) == sorted(K.merged_state(once, up).collect())


def test_queue_keeps_first_entry_and_expires(spark):
    queue = spark.createDataFrame([("a", "1", "alert", T0), ("b", "2", "watch", None)], "event_key string, entry_id string, level string, deferred_at timestamp")
    new = spark.createDataFrame([("a", "9", "watch", T0 + timedelta(hours=1), 1), ("c", "8", "urgent", T0, 2)], "event_key string, entry_id string, level string, deferred_at timestamp, seq long")
    got = {r["event_key"]: (r["entry_id"], r["level"]) for r in K.deferred(queue, new).collect()}
    assert got == {"a": ("1", "alert"), "b": ("2", "watch"), "c": ("8", "urgent")}
    left = K.unexpired(K.deferred(queue, new), F.lit(T0 + timedelta(hours=13)))
    assert [r["event_key"] for r in left.collect()] == ["b"]


def test_ledgers(spark):
    table = spark.createDataFrame([(1, "x")], "id int, v string")
    rows = spark.createDataFrame([(1, "y"), (2, "z"), (2, "z")], "id int, v string")
    assert sorted(map(tuple, K.inserted(table, rows, ["id"]).collect())) == [(1, "x"), (2, "z")]
    assert sorted(map(tuple, K.replaced(table, rows.distinct(), ["id"]).collect())) == [(1, "y"), (2, "z")]
