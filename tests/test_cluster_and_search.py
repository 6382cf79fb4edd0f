import random

import pytest

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.operators import cluster, search
from tidemark.operators.components import connected_components


def roots(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, edges):
    links = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(links).collect()}
    assert got == roots([e for e in edges if e[0] != e[1]])


def test_a_long_chain_is_one_component(spark):
    ids = list(range(40))
    random.Random(3).shuffle(ids)
    links = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "a long, b long")
    assert {r["component"] for r in connected_components(links).collect()} == {0}


@pytest.mark.parametrize("letters", ["abcdefghijkl", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"])
def test_token_links_connect_what_all_pairs_would(spark, letters):
    r = random.Random(5)
    sets = [(i, r.sample(letters, r.randint(1, 7))) for i in range(90)]
    df = spark.createDataFrame(sets, "set_id long, tokens array<string>")
    got = {(x["a"], x["b"]) for x in cluster.token_links(df).collect()}
    want = {(i, j) for i, a in sets for j, b in sets if i < j and len({*a} & {*b}) >= 2 and 100 * len({*a} & {*b}) >= 55 * min(len(a), len(b))}
    assert {(min(p), max(p)) for p in got} <= want and roots(list(got)) == roots(list(want))


def test_clusters_are_transitive(spark):
    rows = [(1, "", "red green blue"), (2, "", "green blue white black"), (3, "", "white black grey"), (4, "u", "other thing"), (5, "u", "something else"), (6, "", ""), (7, "", "RED, green blue!")]
    got = {r["seq"]: r["cluster"] for r in cluster.clustered(spark.createDataFrame(rows, "seq long, url string, title string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 1}


def test_merging_reports_is_by_representative_only(spark):
    rows = [("d", "abcdefghij", 3.0, "s1"), ("d", "abcdefghzz", 2.0, "s2"), ("d", "abcdefzzzz", 1.0, "s3"), ("d", "abcdefghij", 1.0, "s4")]
    got = search.merged_reports(spark.createDataFrame(rows, "day string, title string, weight double, source_id string"), ["day"], 0.7).collect()
    assert {(r["title"], r["n"], tuple(r["sources"])) for r in got} == {("abcdefghij", 3, ("s1", "s2", "s4")), ("abcdefzzzz", 1, ("s3",))}


def test_links_are_kept_once_by_the_newest_day(spark):
    rows = [("u", "1", 1), ("u", "2", 2), ("u", "2", 3), ("", "1", 4), (None, "1", 5)]
    got = search.newest_of_each_link(spark.createDataFrame(rows, "url string, day string, seq int"))
    assert sorted(r["seq"] for r in got.collect()) == [2, 4, 5]


def test_batched_callable(spark):
    out = search.batched(spark.range(5), lambda rows: [{"id": r["id"], "tag": "x"} for r in rows], "id long, tag string", 2)
    assert out.count() == 5


def test_ratios_only_where_they_may_meet_the_threshold(spark):
    """Searches equal plain ratios of all titles, and most titles never meet a ratio."""
    from difflib import SequenceMatcher

    from pyspark.sql import functions as F

    from tidemark.functions.text import ratio_bound

    rnd = random.Random(8)
    query = "quake hits northern coast"
    titles = ["".join(rnd.choice("abcdefghij klmn") for _ in range(rnd.randrange(0, 60))) for _ in range(300)]
    titles += [query, query.upper() + " again", "quakes hit the northern coasts", "northern", "coast quake", "x" * 250, (query + " ") * 12, "", None]
    df = spark.createDataFrame(list(enumerate(titles)), "seq long, title string")
    ratio = lambda a, b: SequenceMatcher(None, a, b).ratio()
    bounds = {r["seq"]: r["b"] for r in df.where("title IS NOT NULL").select("seq", ratio_bound(F.col("title"), query).alias("b")).collect()}
    assert all(bounds[i] >= ratio(query, t) - 1e-12 for i, t in enumerate(titles) if t is not None)
    assert sum(b >= 0.6 for b in bounds.values()) < 60
    found = {r["seq"]: r["score"] for r in search.by_fuzzy(df, query, 0.6).collect()}
    for i, t in enumerate(titles):
        if t is None:
            assert i not in found
        elif query in t.lower():
            assert found[i] == 1.0
        elif ratio(query, t.lower()) >= 0.6:
            assert found[i] == pytest.approx(ratio(query, t.lower()))
    related = {r["seq"]: r["score"] for r in search.related_by_text(df, query, 0.45).collect()}
    want = {}
    for i, t in enumerate(titles):
        if t is not None and t != query:
            words = lambda x: {w for w in x.lower().split() if len(w) >= 2 and w not in {"the", "at", "in", "on", "by", "of", "an", "and"}}
            whole = words(t) | words(query)
            score = 0.3 * len(words(t) & words(query)) / len(whole) + 0.7 * ratio(query, t)
            if score >= 0.45:
                want[i] = score
    assert set(related) >= {i for i in want if i >= 300} and all(related[i] == pytest.approx(want[i]) for i in want if i in related)
