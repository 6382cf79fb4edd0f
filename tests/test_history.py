from datetime import datetime

from pyspark.sql import functions as F

from tidemark.functions import ranks as R
from tidemark.operators import history as H

OBS = "source_id string, item_id long, batch string, rank long, seq long"


def rows(spark, data, schema=OBS):
    return spark.createDataFrame(data, schema)


def test_fold_ends_at_the_last_batch_that_saw_the_item(spark):
    h = rows(spark, [("s", 1, "09-00", 3, 1), ("s", 1, "09-30", 1, 2), ("s", 1, "10-00", 3, 3), ("s", 1, "10-30", 0, 4)])
    one = H.fold_ranks(h).first()
    assert (one["ranks"], one["timeline"], one["crawl_count"], one["last_time"]) == ([3, 1], [3, 1, 3], 3, "10-00")
    again = H.fold_ranks(h.unionByName(rows(spark, [("s", 1, "11-00", 5, 5)]))).first()
    assert (again["ranks"], again["timeline"]) == ([3, 1, 5], [3, 1, 3, None, 5])


def test_off_list_spares_sources_that_failed(spark):
    h = rows(spark, [("s1", 1, "1", 1, 1), ("s1", 2, "1", 2, 2), ("s2", 3, "1", 1, 3), ("s1", 1, "2", 1, 4)])
    assert [(r["source_id"], r["item_id"], r["batch"], r["rank"]) for r in H.off_list(h).collect()] == [("s1", 2, "2", 0)]


def test_new_items_and_what_is_new_without_history(spark):
    h = rows(spark, [("s1", 1, "1", 1, 1), ("s1", 1, "2", 1, 2), ("s1", 2, "2", 2, 3)])
    assert [r["item_id"] for r in H.new_items(h).collect()] == [2]
    first = h.where("batch = '1'")
    assert H.new_items(first).count() == 1
    assert H.new_items(first, "none").count() == 0
    assert H.new_items(h.limit(0)).count() == 0


def test_weight_and_trend(spark):
    df = spark.createDataFrame([([1, 3], 2), ([], 0), ([9, 2], 2), ([2, 9], 2)], "ranks array<int>, n int")
    out = df.select(R.news_weight(F.col("ranks"), F.col("n")).alias("w"), R.rank_trend(F.col("ranks")).alias("t")).collect()
    assert [round(r["w"], 6) for r in out][:2] == [70.0, 0.0]
    assert [r["t"] for r in out] == ["稳定", "稳定", "升温", "降温"]


def test_upsert_folds_rows_of_one_key_and_keeps_real_titles(spark):
    t = lambda h: datetime(2024, 1, 1, h)
    state = spark.createDataFrame([("s", 1, "A title", "u", t(1), t(1), 1)], "source_id string, item_id long, title string, url string, first_time timestamp, last_time timestamp, crawl_count long")
    batch = spark.createDataFrame([("s", 1, "https://x", "u", t(2), 1), ("s", 1, "", "u2", t(2), 2), ("s", 2, "New", "v", t(2), 3)], "source_id string, item_id long, title string, url string, batch timestamp, seq long")
    got = {r["item_id"]: (r["title"], r["url"], r["crawl_count"], r["first_time"]) for r in H.upserted(state, batch).collect()}
    assert got == {1: ("A title", "u2", 3, t(1)), 2: ("New", "v", 1, t(2))}


def test_previous_observation(spark):
    h = rows(spark, [("s", 1, "1", 9, 1), ("s", 1, "2", 0, 2), ("s", 1, "3", 4, 3)])
    got = [(r["row_before"], r["visible_before"], r["times_visible"], r["delta"]) for r in H.with_previous(h).orderBy("batch").collect()]
    assert got == [(None, None, 1, None), (9, 9, 1, 9), (0, 9, 2, None)]
