"""Entries put in one by one: equal to a loop over rows with unique keys, rejected batches included."""

import random

from pyspark.sql import functions as F

from tests.test_entries import batch_of
from tidemark.operators.replay import committed, replayed_entries
from tidemark.queries.entries import no_state


def one_by_one(state, rows, day):
    """The state after rows, or None where a key would belong to two entries."""
    link = lambda t: (t or "").strip().startswith(("http://", "https://", "//"))
    state = [dict(s) for s in state]
    for feed, guid, url, title in rows:
        guid, url = guid or "", url or ""
        hit = next((s for s in state if guid and (s["feed"], s["guid"]) == (feed, guid)), None)
        hit = hit or next((s for s in state if url and (s["feed"], s["url"]) == (feed, url)), None)
        if hit:
            keep = link(title) and hit["title"] and not link(hit["title"])
            hit.update(title=hit["title"] if keep else title, url=url or hit["url"], guid=guid or hit["guid"], last=day, n=hit["n"] + 1)
        elif guid or url:
            hit = dict(feed=feed, guid=guid, url=url, title=title, first=day, last=day, n=1)
            state.append(hit)
        else:
            continue
        for kind in ("guid", "url"):
            if (hit[kind] or kind == "url") and sum(s["feed"] == feed and s[kind] == hit[kind] for s in state) > 1:
                return None
    return state


def plain(state):
    return sorted((s["feed"], s["guid"], s["url"], s["title"], s["first"], s["last"], s["n"]) for s in state)


def of_rows(df):
    return sorted((r.feed_id, r.guid, r.url, r.title, r.first_batch.day, r.last_batch.day, r.crawl_count) for r in df.collect())


def test_random_batches_equal_entries_one_by_one(spark):
    """Any guid with any link: entries change keys by which later ones are found, and some batches are rejected."""
    rng, state, want, outcomes = random.Random(11), no_state(spark), [], []
    for day in range(1, 13):
        rows = []
        for _ in range(rng.choice([3, 6, 9])):
            title = rng.choice(["http://t", " //t", "A", "B", "", None])
            rows.append((rng.choice("ab"), rng.choice(["", None, *[f"g{k}" for k in range(12)]]), rng.choice(["", *[f"u{k}" for k in range(12)]]), title))
        rows += [("a", "", None, "no key"), (None, "g", "u", "no feed")]
        state, ok = committed(state, batch_of(spark, rows, day))
        after = one_by_one(want, [r for r in rows if r[0]], day)
        outcomes.append(ok)
        assert ok == (after is not None), rows
        want = want if after is None else after
        state = spark.createDataFrame(state.collect(), no_state(spark).schema)
        assert of_rows(state.fillna("~", ["title"])) == plain([s | {"title": "~" if s["title"] is None else s["title"]} for s in want])
    assert len(set(outcomes)) == 2 and len(want) > 5


def test_an_entry_that_changes_the_key_of_the_next(spark):
    first = [("a", "g1", "u1", "one"), ("a", "g2", "u2", "two")]
    state, ok = committed(no_state(spark), batch_of(spark, first, 1))
    assert ok
    moved = [("a", "g1", "u3", "moved"), ("a", "g4", "u1", "new under the old link"), ("a", "", "u3", "again"), ("a", "g5", "u2", "renamed"), ("a", "g2", "u6", "back")]
    state, ok = committed(state, batch_of(spark, moved, 2))
    assert ok and [(r.guid, r.url, r.title, r.crawl_count) for r in state.orderBy("guid").collect()] == [
        ("g1", "u3", "again", 3), ("g2", "u6", "back", 1), ("g4", "u1", "new under the old link", 1), ("g5", "u2", "renamed", 2),
    ]


def test_blank_links_are_a_key(spark):
    both = batch_of(spark, [("a", "g1", "", "one"), ("a", "g2", "", "two")], 1)
    assert [r.feed_id for r in replayed_entries(no_state(spark), both)[1].collect()] == ["a"]
    filled = batch_of(spark, [("a", "g1", "", "one"), ("a", "g1", "u1", "one"), ("a", "g2", "", "two"), ("b", "g2", "", "two")], 1)
    state, ok = committed(no_state(spark), filled)
    assert ok and state.count() == 3


def test_one_key_with_most_of_the_batch_and_empty_inputs(spark):
    hot = spark.range(5000).select(F.col("id").alias("seq"), F.lit("a").alias("feed_id"), F.lit("g").alias("guid"), F.lit("u").alias("url"), F.concat(F.lit("t"), "id").alias("title"), F.lit("s").alias("summary"), F.lit(None).cast("string").alias("author"), F.lit(None).cast("timestamp").alias("published_at"), F.lit("2024-01-01").cast("timestamp").alias("batch"))
    state, ok = committed(no_state(spark), hot)
    assert ok and [(r.title, r.crawl_count) for r in state.collect()] == [("t4999", 5000)]
    assert committed(no_state(spark), hot.limit(0))[0].count() == 0
    kept, ok = committed(state, hot.limit(0))
    assert ok and kept.count() == 1
