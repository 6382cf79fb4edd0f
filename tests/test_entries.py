"""Feed entries: upserts as if entries came one by one, positions, modes."""

import random

from pyspark.sql import functions as F
from tidemark.operators import entries as E
from tidemark.operators.state import chunked
from tidemark.plans.prefix_sums import positions
from tidemark.plans.rules import parse_rules
from tidemark.queries.entries import no_state


def batch_of(spark, rows, day):
    out = spark.createDataFrame([(i, *r, "s", None, None) for i, r in enumerate(rows)], "seq long, feed_id string, guid string, url string, title string, summary string, author string, published_at timestamp")
    return out.withColumn("batch", F.lit(f"2024-01-{day:02}").cast("timestamp"))


def one_by_one(state, rows, day):
    link = lambda t: (t or "").strip().startswith(("http://", "https://", "//"))
    for feed, guid, url, title in rows:
        guid, url = guid or "", url or ""
        hit = next((s for s in state if guid and (s["feed"], s["guid"]) == (feed, guid)), None)
        hit = hit or next((s for s in state if url and (s["feed"], s["url"]) == (feed, url)), None)
        if hit:
            keep = link(title) and hit["title"] and not link(hit["title"])
            hit.update(title=hit["title"] if keep else title, url=url or hit["url"], guid=guid or hit["guid"], last=day, n=hit["n"] + 1)
        elif guid or url:
            state.append(dict(feed=feed, guid=guid, url=url, title=title, first=day, last=day, n=1))
    return state


def test_upserts_equal_entries_one_by_one(spark):
    """Each thing has its own guid and link, and shows itself by either or both, by the link first."""
    rng, state, want = random.Random(4), no_state(spark), []
    for day in range(1, 4):
        rows = []
        for _ in range(60):
            k, feed = rng.randrange(12), rng.choice("ab")
            known = any(s["feed"] == feed and s["url"] == f"u{k}" and s["guid"] for s in want)
            how = rng.choice("gub" if known else "ub")
            title = rng.choice(["http://t", "//t", "A", "B", ""])
            rows.append((feed, f"g{k}" if how in "gb" else rng.choice(["", None]), f"u{k}" if how in "ub" else "", title))
        rows.append(("a", None, "", "no key"))
        state = E.upserted_entries(state, batch_of(spark, rows, day))
        want = one_by_one(want, rows, day)
    got = sorted((r.feed_id, r.guid, r.url, r.title, r.first_batch.day, r.last_batch.day, r.crawl_count) for r in state.collect())
    assert got == sorted((s["feed"], s["guid"], s["url"], s["title"], s["first"], s["last"], s["n"]) for s in want)


def test_empty_batches_and_states(spark):
    empty = batch_of(spark, [("a", "g", "u", "t")], 1).limit(0)
    assert E.upserted_entries(no_state(spark), empty).count() == 0
    state = E.upserted_entries(no_state(spark), batch_of(spark, [("a", "g", "u", "t")], 1))
    assert [tuple(r) for r in E.upserted_entries(state, empty).collect()] == [tuple(r) for r in state.collect()]


def test_new_entries(spark):
    now = F.lit("2024-01-02").cast("timestamp")
    batch = batch_of(spark, [("a", "", "u", "t"), ("a", "", "v", "t"), ("b", "", "u", "t"), ("b", "g", "", "t")], 2)
    state = E.upserted_entries(no_state(spark), batch_of(spark, [("a", "", "u", "t")], 1))
    assert sorted(r.seq for r in E.new_entries(batch, state, now).collect()) == [1, 2]
    assert E.new_entries(batch, no_state(spark), now).count() == 4
    assert E.new_entries(batch, E.upserted_entries(no_state(spark), batch), now).count() == 4


def test_frequencies_without_groups_and_by_mode(spark):
    rows = batch_of(spark, [("a", "", "u", "one"), ("b", "", "u", "two"), ("b", "", "", "three"), ("b", "", "w", " ")], 2)
    named, counts = E.frequencies(rows, parse_rules(""))
    assert sorted((r.seq, r.group_no, r.position, r.is_new) for r in named.collect()) == [(0, 0, 2, False), (2, 0, 99, False)]
    assert [tuple(r) for r in counts.collect()] == [(0, 2, 50.0)]
    state = E.upserted_entries(no_state(spark), rows)
    batches = spark.createDataFrame([("2024-01-02",), ("2024-01-03",)], "batch string").select(F.col("batch").cast("timestamp"))
    shown = {m: [x if x is None else x.count() for x in E.entries_for_mode(m, state, batches, rows)] for m in ("daily", "current", "incremental")}
    assert shown == {"daily": [3, 4], "current": [0, 4], "incremental": [4, None]}


def test_positions_over_many_parts(spark):
    rows = spark.range(1000).select((F.col("id") * 617 % 1000).alias("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise("b").alias("block"))
    got = positions(rows, [F.desc("id")], "place", per_task=90).collect()
    assert all(r.place == 999 - r.id for r in got) and len(got) == 1000
    assert positions(rows.limit(0), [F.col("id")], "place").count() == 0
    most = chunked(rows, [F.col("id")], 12, "block").groupBy("block", "chunk").count()
    assert most.agg(F.max("count"), F.count("*")).first() == (12, 28 + 56)


def test_chunks_of_a_null_block(spark):
    rows = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "block string, id int")
    assert sorted((r.id, r.chunk) for r in chunked(rows, [F.col("id")], 1, "block").collect()) == [(1, 0), (2, 1), (3, 0)]
