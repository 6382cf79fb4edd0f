"""State folders, health of runs, and whole runs with their state."""

from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import adapters as A
from tidemark.operators import candidates as C
from tidemark.operators import runs as R
from tidemark.operators.run import EVENTS, QUEUE, States, run_once
from tidemark.operators.scoring import Coverage, candidate_scores
from tidemark.plans.state_folder import POINTER, StateFolder

T0 = datetime(2024, 3, 1, 12)


def test_state_folder(spark, tmp_path):
    folder = StateFolder(spark, str(tmp_path / "s"), "k string, n long")
    assert folder.load().status == "missing" and folder.load().trusted
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    folder.save(rows, "t1")
    got = folder.load()
    assert (got.status, got.recorded_at, sorted(map(tuple, got.rows.collect()))) == ("loaded", "t1", [("a", 1), ("b", 2)])
    folder.save(got.rows.where("k = 'b'"), "t2")
    folder.save(folder.load().rows, "t3")
    assert [tuple(r) for r in folder.load().rows.collect()] == [("b", 2)]
    assert len(list((tmp_path / "s").glob("version-*"))) == 2
    with pytest.raises(ValueError, match="recorded_at"):
        folder.save(rows, " ")
    assert StateFolder(spark, str(tmp_path / "s"), "k string, n int").load().status == "untrusted"


def test_a_crash_before_the_pointer_leaves_the_old_state(spark, tmp_path, monkeypatch):
    folder = StateFolder(spark, str(tmp_path / "s"), "k string")
    folder.save(spark.createDataFrame([("old",)], "k string"), "t1")

    def dies(self, to):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(StateFolder, "_point", dies)
        with pytest.raises(RuntimeError, match="killed"):
            folder.save(spark.createDataFrame([("new",)], "k string"), "t2")
    assert [r["k"] for r in folder.load().rows.collect()] == ["old"]
    folder.save(spark.createDataFrame([("newer",)], "k string"), "t3")
    assert [r["k"] for r in folder.load().rows.collect()] == ["newer"]


@pytest.mark.parametrize("damage", ["{", "[]", '{"format": 9}', "gone", "short"])
def test_a_damaged_state_is_untrusted(spark, tmp_path, damage):
    folder = StateFolder(spark, str(tmp_path / "s"), "k string")
    name = folder.save(spark.createDataFrame([("a",), ("b",)], "k string"), "t")
    if damage in ("gone", "short"):
        for p in (tmp_path / "s" / name).glob("part-*"):
            p.unlink()
        if damage == "gone":
            for p in sorted((tmp_path / "s" / name).iterdir()):
                p.unlink()
            (tmp_path / "s" / name).rmdir()
    else:
        for p in (tmp_path / "s").glob(f".{POINTER}*.crc"):
            p.unlink()
        (tmp_path / "s" / POINTER).write_text(damage)
    got = folder.load()
    assert got.status == "untrusted" and not got.trusted and got.why and got.rows.count() == 0
    assert folder.set_aside("x") and folder.load().status == "missing" and not folder.set_aside("x")


SOURCES = "kind string, source_id string, succeeded boolean"


def test_health_of_runs(spark, tmp_path):
    state = StateFolder(spark, str(tmp_path / "s"), R.SOURCES)
    of = lambda rows, age=None: R.run_health(spark.createDataFrame(rows, SOURCES), state, age)
    good = [("hotlist", f"h{i}", True) for i in range(3)] + [("rss", "f", True), ("rss", " ", False), ("hotlist", " h0 ", False)]
    first = of(good)
    assert (first.status, first.coverage.configured, first.coverage.successful, first.trusted) == ("healthy", 4, 4, True)
    assert of([("hotlist", "a", False), ("rss", "f", True)]).reasons == ("hotlist_all_failed",)
    assert of(good, 121).reasons == ("stale_input",) and of(good, 120).status == "healthy"
    low = of([("hotlist", "a", True), ("hotlist", "b", False), ("rss", "f", False)])
    assert (low.status, low.reasons) == ("degraded", ("hotlist_success_ratio_low", "rss_all_failed"))
    R.end_run(spark.createDataFrame([("hotlist", "a", False), ("hotlist", "b", True), ("rss", "a", True)], SOURCES), state, "t")
    back = of([("hotlist", "a", True), ("hotlist", "b", True), ("rss", "a", True)])
    assert [tuple(r) for r in back.recovered.collect()] == [("hotlist", "a")]
    items = spark.createDataFrame([("hotlist", " a", 1), ("rss", "a", 2), ("hotlist", None, 3)], "kind string, owner string, n int")
    assert {r["n"]: r["after_gap"] for r in R.marked(items, back, F.col("owner")).collect()} == {1: True, 2: False, 3: False}


ROWS = "seq long, source_id string, title string, url string, ranks array<long>, timeline array<long>, count long, is_new boolean, first_time string, last_time string, tier string"


def items_of(spark, rows, observed=True):
    listed = A.list_items(spark.createDataFrame(rows, ROWS))
    none = F.lit(None).cast("string")
    return listed.withColumns({"feed_id": none, "source_name": none, "keyword_group": none, "observed": F.lit(observed), "cross_admitted": F.lit(False)})


HOT = [(i, f"s{i}", "Great storm hits the northern coast", "", [1], [1], 1, True, "t", "t", "ABCD"[i]) for i in range(4)]
COLD = [(9, "s9", "Quiet village market opens", "", [90], [90], 1, False, "t", "t", None)]


def test_runs_send_once_and_keep_their_state(spark, tmp_path):
    folder = lambda name, schema: StateFolder(spark, str(tmp_path / name), schema)
    states, sent = States(folder("events", EVENTS), folder("queue", QUEUE), folder("sources", R.SOURCES)), []
    sources = spark.createDataFrame([("hotlist", f"s{i}", True) for i in (0, 1, 2, 3, 9)], SOURCES)

    def run(at, accept=True, rows=(*HOT, *COLD), observed=True, **how):
        sink = lambda df: sent.append([r["display_title"] for r in df.collect()]) or accept
        out = run_once(items_of(spark, list(rows), observed), sources, states, at, sink, **how)
        return out, {r["display_title"].split()[0]: r["outcome"] for r in out.outcomes.collect()}

    first, how = run(T0, accept=False)
    assert how == {"Great": "sent", "Quiet": "not_eligible"} and first.sent == 0 and states.events.load().status == "missing"
    assert run(T0)[0].sent == 1 and states.events.load().rows.count() == 1
    assert run(T0 + timedelta(minutes=239))[1]["Great"] == "cooldown"
    assert run(T0 + timedelta(hours=5), observed=False)[1]["Great"] == "not_fresh"
    assert run(T0 + timedelta(hours=5), most=0)[1]["Great"] == "over_limit"
    quiet, how = run(T0 + timedelta(hours=5), quiet=("16:00", "18:00"), settings=C.Settings(urgent=101.0))
    assert how["Great"] == "deferred" and quiet.reason == "deferred_quiet_hours" and states.queue.load().rows.count() == 1
    late, how = run(T0 + timedelta(hours=6), settings=C.Settings(urgent=101.0))
    assert how["Great"] == "sent" and late.reason == "ready" and states.queue.load().rows.count() == 0
    (tmp_path / "events" / POINTER).write_text("{")
    for p in (tmp_path / "events").glob(f".{POINTER}*.crc"):
        p.unlink()
    broken, how = run(T0 + timedelta(days=2))
    assert how["Great"] == "closed" and broken.reason == "state_error" and broken.sent == 0
    assert len(sent) == 3


def test_feed_items_attach_to_one_list_item(spark):
    """By two specific entities; a feed item never joins two lists' clusters, and a cluster of feed items has one place."""
    rows = [
        (1, 1, "hotlist", 5, "GLM-5.2 beats F-35"), (2, 2, "hotlist", 3, "GLM-5.2 and F-35 again"), (3, 3, "hotlist", 1, "Paris F-35"),
        (4, 4, "rss", None, "new GLM-5.2 with F-35 and Paris"), (5, 5, "rss", None, "Paris only"), (6, 3, "rss", None, "in a cluster with a list: GLM-5.2 F-35"), (7, 4, "rss", None, "F-35 Paris"),
    ]
    items = spark.createDataFrame([(*r[:4], r[3], r[4]) for r in rows], "seq long, cluster long, kind string, rank long, best_rank long, title string")
    got = {r["seq"]: r["cluster"] for r in C.with_feed_items(items, ["china"]).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 3, 5: 5, 6: 3, 7: 3}
    common = {r["seq"]: r["cluster"] for r in C.with_feed_items(items, ["paris"]).collect()}
    assert common[4] == 2 and common[7] == 2


def test_identity_of_clusters(spark):
    import hashlib

    rows = [(1, "B b!", "u2", "hotlist", "s"), (1, "a", "u1", "rss", "f"), (1, "b B", None, "hotlist", "s"), (2, "", "", "hotlist", "s"), (2, None, None, "hotlist", "s"), (3, None, "u", "rss", "f"), (4, "!", None, "rss", None)]
    items = spark.createDataFrame([(c, t, u, k, s, None, s, None) for c, t, u, k, s in rows], "cluster long, title string, url string, kind string, source_id string, feed_id string, source_name string, keyword_group string")
    name = lambda key: hashlib.sha1(f"pr9c:{key}".encode()).hexdigest()[:12]
    got = {r["cluster"]: (r["candidate_id"], r["key_parts"]) for r in C.identities(items).collect()}
    assert got == {1: (name("a||b b||u1||u2"), 4), 2: (name("hotlist:s:s||hotlist:s:s"), 2), 3: (name("u"), 1), 4: (name(""), 1)}
    listed = {r["cluster"]: r["candidate_id"] for r in C.identities(items, listed_first=True).collect()}
    assert listed[1] == name("b b||u2") and listed[3] == name("u")


def test_gates_of_scores(spark):
    scores = lambda rows, **how: candidate_scores(items_of(spark, rows).withColumns({"after_gap": F.col("seq") > 90, "cand": F.lit(1)}), "cand", **how).first()
    one = [(1, "s", "t", "", [2], [2], 1, True, "t", "t", None)]
    base = scores(one)
    assert (base["movement"], base["burst"], base["recency"], base["persistence"], base["heat"], base["cross"]) == (21.0, 13.0, 8.0, 0.0, 33.0, 1.0)
    assert base["score"] == pytest.approx((42 + 33) * 0.88 + 0.25)
    assert scores(one, trusted=False)["burst"] == 0 and scores(one, first_crawl=True)["burst"] == 0 and scores(one, first_crawl=True)["recency"] == 4
    assert scores([(91, *one[0][1:])])["burst"] == 0
    unsure = [(1, "s", "t", "", [2], None, 3, True, None, None, None)]
    assert [scores(unsure)[c] for c in ("movement", "recency", "persistence")] == [0.0, 0.0, 2.0]
    low = Coverage(configured=10, successful=6, penalise=True)
    assert scores(one, coverage=low)["score"] == pytest.approx((42 + 33) * 0.85 * 0.88 + 0.25 * 0.85) and "6/10 (4 failed)" in low.warning
    assert scores(one, coverage=replace(low, penalise=False))["score"] == base["score"]
    far = [(1, "s", "t", "", [60], [60], 1, True, "t", "t", None)]
    assert scores(far)["burst"] == pytest.approx(3.2) and scores(far * 2)["burst"] == 4.0
