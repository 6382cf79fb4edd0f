"""Answers are kept once for each title, also when a batch dies in the middle and runs again."""

import pytest

from tidemark.streaming.ledger import Ledger, classify_pending, classifying

ITEMS = "kind string, news_id long, title string"


def asker(log, fail_on=None):
    """Logs every title; tag 1 for even ids, 2 too for those divisible by four; dies once at fail_on."""
    flag = log / "died"

    def classify(titles):
        import pathlib
        import uuid

        if fail_on is not None and any(n == fail_on for n, _ in titles) and not pathlib.Path(flag).exists():
            pathlib.Path(flag).touch()
            raise RuntimeError("killed")
        (pathlib.Path(log) / f"call-{uuid.uuid4().hex}").write_text("\n".join(str(n) for n, _ in titles))
        return [(n, t, 0.5 + t) for n, _ in titles for t in (1, 2) if n % (2 * t) == 0] + [(10**9, 1, 1.0)]

    return classify


def calls(log):
    return sorted(sorted(map(int, p.read_text().split())) for p in log.glob("call-*"))


def kept(spark, root):
    return sorted((r["news_id"], r["tag_id"] or 0, r["score"] or 0.0, r["matched"]) for r in Ledger(spark, root).answers().collect())


def wanted(ids):
    return sorted([(n, t, min(0.5 + t, 1.0), True) for n in ids for t in (1, 2) if n % (2 * t) == 0] + [(n, 0, 0.0, False) for n in ids if n % 2])


def test_a_killed_run_asks_only_for_what_was_not_kept(spark, tmp_path):
    log, root = tmp_path / "log", str(tmp_path / "ledger")
    log.mkdir()
    items = spark.createDataFrame([("hotlist", i, f"t{i}") for i in range(60)], ITEMS)
    ask = lambda rows, fail=None: classify_pending(Ledger(spark, root), rows, asker(log, fail), "file", 1, per_call=5, per_round=3)
    with pytest.raises(Exception, match="killed"):
        ask(items, 37)
    assert kept(spark, root) == wanted(range(30))
    assert ask(items, 37) == 30
    assert kept(spark, root) == wanted(range(60))
    of_kept = [c for c in calls(log) if c[0] < 30]
    assert sorted(n for c in of_kept for n in c) == list(range(30)) and all(len(c) <= 5 for c in calls(log))
    assert ask(items.unionByName(items)) == 0 and ask(items.limit(0)) == 0


def test_kinds_versions_repeats_and_active_tags(spark, tmp_path):
    log, root = tmp_path / "log", str(tmp_path / "ledger")
    log.mkdir()
    rows = [("hotlist", 1, "a"), ("hotlist", 1, "b"), ("rss", 1, "a"), (None, 4, "c"), ("rss", None, "x"), ("hotlist", 8, None)]
    items, ledger = spark.createDataFrame(rows, ITEMS), Ledger(spark, root)
    assert classify_pending(ledger, items, asker(log), "file", 1, per_call=10) == 4
    assert all(len(c) <= 2 for c in calls(log))
    assert classify_pending(ledger, items, asker(log), "other", 1) == 4 and classify_pending(ledger, items, asker(log), "file", 2) == 4
    tags = spark.createDataFrame([(1, "active"), (2, "deprecated")], "tag_id long, status string")
    assert sorted((r["news_id"], r["tag_id"]) for r in ledger.results(tags, "file", 1).collect()) == [(4, 1), (8, 1)]
    assert classify_pending(ledger, items.where("kind IS NOT NULL"), asker(log), "file", 1, again=True) == 2


def test_a_stream_repeats_its_batch(spark, tmp_path):
    log, root, src = tmp_path / "log", str(tmp_path / "ledger"), tmp_path / "in"
    log.mkdir()
    spark.createDataFrame([("hotlist", i, f"t{i}") for i in range(20)], ITEMS).coalesce(1).write.parquet(str(src))

    def run():
        stream = spark.readStream.schema(ITEMS).parquet(str(src))
        classifying(stream, root, asker(log, 13), "file", 1, per_call=4, per_round=1).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception, match="killed"):
        run()
    half = kept(spark, root)
    run()
    assert half == wanted(range(12)) and kept(spark, root) == wanted(range(20))
    assert sorted(n for c in calls(log) for n in c) == list(range(20))
