"""Items to score, their sources' gaps, related titles of past days, and lives of states."""

from difflib import SequenceMatcher

from pyspark.sql import functions as F

from tidemark.operators import adapters as A
from tidemark.operators import search as S
from tidemark.operators.state import time_to_live


def test_observations_after_a_gap(spark):
    items = spark.createDataFrame([(1, "a", "x"), (2, " b ", "y"), (3, "b", "z"), (4, None, "y"), (5, "", None)], "no int, source_id string, title string")
    observed = spark.createDataFrame([("x",), ("y",), ("y",), (None,)], "identity string")
    failed, now = (spark.createDataFrame(r, "source_id string") for r in ([("b",), ("c",), ("b",)], [("a",), ("b",)]))
    back = A.recovered_sources(failed, now)
    assert [r.source_id for r in back.collect()] == ["b"]
    rows = A.with_observations(items, F.col("title"), observed, back, "source_id")
    assert sorted((r.no, r.observed, r.after_gap) for r in rows.collect()) == [(1, True, False), (2, True, True), (3, False, False), (4, True, False), (5, False, False)]
    assert rows.columns == ["no", "source_id", "title", "observed", "after_gap"]


def test_background_groups(spark):
    groups = spark.createDataFrame([("背景-a",), ("b",), (None,)], "group_name string")
    assert [r.group_name for r in A.without_background(groups).collect()] == ["b", None]
    assert A.without_background(groups, "").count() == 3


def test_modes_without_titles(spark):
    none = spark.createDataFrame([], "source_id string, item_id long, last_time timestamp")
    assert [A.titles_for_mode(none, none, m).count() for m in ("daily", "current", "incremental")] == [0, 0, 0]


def test_related_titles_of_days(spark):
    texts = ["markets rise on rates", "Markets fall on rates", "rates", "", "something else entirely", None, "markets rise on rates"]
    rows = spark.createDataFrame([(i, t, "s", f"2024-01-0{i + 1}") for i, t in enumerate(texts)], "seq long, title string, source_id string, day string").withColumn("day", F.to_date("day"))
    found, counts = S.related_in_days(rows, "markets rise on rates", "2024-01-01", "2024-01-06", 0.4)
    words = {"markets", "rise", "rates"}
    want = []
    for i, t in enumerate(texts[:6]):
        own = {w for w in (t or "").lower().split() if w != "on"}
        overlap = len(own & words) / max(1, len(own | words))
        score = 0.7 * overlap + 0.3 * SequenceMatcher(None, "markets rise on rates", t or "").ratio()
        if t is not None and score >= 0.4:
            want.append((i, round(score, 9)))
    assert sorted((r.seq, round(r.score, 9)) for r in found.collect()) == want and len(want) >= 2
    assert counts.agg(F.sum("n")).first()[0] == len(want)


def test_lives_of_states():
    assert time_to_live() == dict.fromkeys(["suppress", "watch", "alert", "urgent"], 604800)
    assert time_to_live(240, 60)["urgent"] == 14400
