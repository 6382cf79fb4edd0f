"""Queries that do their whole job in bounded tables: what they give, and how their rows travel."""

import random
import re
from datetime import datetime

from pyspark.sql import functions as F

from tidemark.operators import cluster, topics, trends
from tidemark.operators.components import connected_components
from tidemark.plans.scratch import tables_read
from tidemark.queries import QUERIES


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_new_items_looks_at_all_days(spark, tmp_path):
    rows = [(k, day, user, datetime(2024, 1, day)) for k, (day, user) in enumerate([(1, 1), (2, 1), (4, 2), (6, 1), (6, 2), (6, 3)])]
    events = spark.createDataFrame([(k, ts, user, "click", 1.0, "t") for k, _, user, ts in rows], "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    events.write.parquet(str(tmp_path / "events.parquet"))
    assert [(r["item_id"], r["batch"]) for r in QUERIES["new_items"](spark, str(tmp_path)).collect()] == [(3, datetime(2024, 1, 6))]


def test_tiers_go_to_the_items(spark):
    """Items by source would be as many partitions as there are sources, however small the table of tiers is believed to be."""
    items = spark.range(100).select((F.col("id") % 3).cast("string").alias("source_id"), "id")
    tiers = spark.createDataFrame([("0", "N0", "A", "lead"), ("1", "2", "B", "follow")], "id string, name string, tier string, role string")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = topics.with_tier(items, tiers)
        assert "SortMergeJoin" not in plan_of(out)
        assert {(r["source_id"], r["tier"]) for r in out.collect()} == {("0", "A"), ("1", "B"), ("2", "B")}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_samples_meet_by_topic_without_their_titles(spark):
    items = spark.createDataFrame([("s", "a b a", 5, 1), ("s", "a b a", 2, 2), ("t", "a b a", 2, 3), ("s", "a", 1, 4), ("s", "a c", 9, 5)], "source_id string, title string, rank long, seq long")
    out = topics.samples(items, F.split("title", " "), [F.col("rank"), F.col("seq")], 3, ["source_id", "title"])
    got = {(r["topic"], r["place"]): (r["source_id"], r["title"]) for r in out.collect()}
    assert got == {("a", 1): ("s", "a"), ("a", 2): ("s", "a b a"), ("a", 3): ("t", "a b a"), ("b", 1): ("s", "a b a"), ("b", 2): ("t", "a b a"), ("c", 1): ("s", "a c")}
    assert any(name.startswith("first-items") for name in tables_read(out))


def test_words_of_equal_titles_are_counted_once_and_multiplied(spark):
    titles = spark.createDataFrame([("long word long",), ("long word long",), ("word of",)], "title string")
    out = trends.words_of_titles(titles, F.split("title", " "), 4)
    assert {tuple(r) for r in out.collect()} == {("long", 4, 1), ("word", 3, 2)}
    assert not re.search(r"Exchange hashpartitioning\(word#\d+L?, title", plan_of(out))


def test_sets_outside_the_largest_component_meet_all_sets_in_parts(spark, monkeypatch):
    monkeypatch.setattr(cluster, "PART", 4)
    monkeypatch.setattr(cluster, "HUBS", 2)
    draw = random.Random(5)
    sets = {k: sorted(draw.sample("abcdefghijklmnop", draw.randint(1, 9))) for k in range(60)}
    pairs = [(x, y) for x in sets for y in sets if x < y and (n := len({*sets[x]} & {*sets[y]})) >= 2 and 100 * n >= 55 * min(len(sets[x]), len(sets[y]))]
    links = cluster.token_links(spark.createDataFrame(list(sets.items()), "set_id long, tokens array<string>"))
    groups = lambda df: {tuple(r) for r in connected_components(df).collect()}
    assert groups(links) == groups(spark.createDataFrame(pairs, "a long, b long"))


def test_clusters_are_made_without_moving_titles(spark, monkeypatch):
    """Copies, sets of equal tokens, titles of one token, links and blanks; only a table of nodes holds tokens, and links are few."""
    monkeypatch.setattr(cluster, "PART", 4)
    made, cut = {}, cluster.cut
    monkeypatch.setattr(cluster, "cut", lambda df, name, *codec: made.setdefault(name, cut(df, name, *codec)))
    monkeypatch.setattr(cluster, "release", lambda *tables: None)
    words = [f"w{k}" for k in range(6)]
    titles = [*(" ".join(words[:k]) for k in range(2, 7)), "w1 W0!", "w0, w1", "lone", "lone lone", "Lone", "far away", "", None, "one two", "two three"]
    urls = {7: "u", 10: "u", 13: "v", 14: "v"}
    items = [(k, urls.get(k, ""), title) for k, title in enumerate(titles)]
    got = {r["seq"]: r["cluster"] for r in cluster.clustered(spark.createDataFrame(items, "seq long, url string, title string")).collect()}
    assert got == {**dict.fromkeys(range(7), 0), 7: 7, 8: 8, 9: 7, 10: 7, 11: 11, 12: 12, 13: 13, 14: 13}
    assert "title" not in {c for df in made.values() for c in df.columns} and "norm" not in {c for df in made.values() for c in df.columns}
    assert made["nodes"].where("text IS NOT NULL").count() == 8  # copies and orders of tokens are one
