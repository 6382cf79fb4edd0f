import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions.entities import admitted_feed_items, attached, entities
from tidemark.operators import reports as P
from tidemark.plans import arguments as A

TODAY = date(2024, 3, 13)  # a Wednesday


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("today", TODAY), ("昨天", date(2024, 3, 12)), ("3 days ago", date(2024, 3, 10)), ("10天前", date(2024, 3, 3)), ("last monday", date(2024, 3, 4)),
        ("上周日", date(2024, 3, 10)), ("friday", date(2024, 3, 8)), ("this friday", date(2024, 3, 15)), ("2024-2-9", date(2024, 2, 9)), ("12月5日", date(2023, 12, 5)), ("3/1", date(2024, 3, 1)),
    ],
)
def test_days(text, want):
    assert A.day_of(text, TODAY) == want


def test_ranges_and_other_arguments():
    assert A.range_of('{"start": "2024-03-01", "end": "today"}', TODAY) == (date(2024, 3, 1), TODAY)
    assert A.range_of("last week", TODAY) == (date(2024, 3, 4), date(2024, 3, 10))
    for bad in ({"start": "today", "end": "yesterday"}, {"start": "2024-03-20"}, "whenever", "400 days ago"):
        with pytest.raises(ValueError, match=r"."):
            A.range_of(bad, TODAY)
    with pytest.raises(ValueError, match="31"):
        A.range_of({"start": "2024-01-01", "end": "today"}, TODAY, 31)
    assert (A.limit_of("20"), A.limit_of(None), A.word_of(" x "), A.threshold_of("0.5", 1)) == (20, 50, "x", 0.5)
    assert A.sources_of("a, b", ["a", "b", "c"]) == ["a", "b"] and A.sources_of('["c"]', ["c"]) == ["c"] and A.sources_of(None, ["c"]) == ["c"]
    for call in (lambda: A.limit_of(0), lambda: A.word_of(" "), lambda: A.sources_of("z", ["a"]), lambda: A.threshold_of(2, 1)):
        with pytest.raises(ValueError, match=r"."):
            call()


def test_periods():
    night, noon = A.Period("night", "22:00", "06:00"), A.Period("noon", "11:00", "13:00")
    assert night.holds("23:00") and night.holds("05:59") and not night.holds("06:00")
    assert not night.overlaps(noon) and night.overlaps(A.Period("x", "05:00", "07:00"))
    plans, week, own = {"day": [night, noon]}, {2: "day"}, {"noon": {"push": False}}
    at = lambda h: A.settings_at(datetime(2024, 3, 13, h), {"push": True}, plans, week, own)
    assert at(12) == {"push": False, "period": "noon"} and at(15) == {"push": True, "period": None} and at(23)["period"] == "night"
    with pytest.raises(ValueError, match="overlap"):
        A.settings_at(datetime(2024, 3, 13, 12), {}, {"day": [noon, noon]}, week, {})
    beats = [(None, "missing"), ("x", "invalid"), ("2000", "future"), ("5", "before_start"), ("100", "stale"), ("990", "fresh")]
    assert [A.heartbeat(t, 1000, 50, 60) for t, _ in beats] == [w for _, w in beats]


@pytest.mark.parametrize(
    ("title", "want"),
    [
        ("GDP up 5% as AI bets $1,200 million", "$1200 5% gdp"),
        ("GLM-5.2 beats F-35, G7 and HBM4E", "glm-5.2 f-35 g7 hbm4e"),
        ("NO deal: US up", ""),
        ("City 4-2 Rovers, 1% and 49% of 12,345 in 1999 or 2101", "4-2 city rovers 49% 345 2101"),
        ("Breaking: Monday News from Paris about 苹果", "paris Apple"),
        ("", ""),
        (None, ""),
    ],
)
def test_entities_by_kind(spark, title, want):
    got = spark.createDataFrame([(title,)], "t string").select(entities(F.col("t"), {"苹果": "Apple"}).alias("e")).first()["e"]
    assert got == sorted(want.split())


def test_feed_items_join_the_topic_with_most_entities(spark):
    feed = spark.createDataFrame([(1, ["a", "b"], None), (2, ["a"], datetime(2024, 1, 1)), (3, ["z"], None), (4, ["b"], datetime(2024, 1, 9, 12))], "seq long, entities array<string>, published_at timestamp")
    topics = spark.createDataFrame([(0, ["a"]), (1, ["a", "b"])], "topic_no long, entities array<string>")
    got = {r["seq"]: r["topic_no"] for r in admitted_feed_items(feed, topics, F.lit("2024-01-10").cast("timestamp")).collect()}
    assert got == {1: 1, 4: 1}
    hot = spark.createDataFrame([(10, 5, ["a"]), (11, 2, ["a"]), (12, 1, ["common"])], "seq long, rank int, entities array<string>")
    assert [(r["feed"], r["item"]) for r in attached(feed.unionByName(spark.createDataFrame([(5, ["common"], None)], feed.schema)), hot, ["common"]).orderBy("feed").collect()] == [(1, 11), (2, 11)]


def test_digest_leaves_out_what_is_alike(spark):
    rows = [("market crash in europe", 400), ("Market crash in Europe today", 390), ("new phone", 300), ("quake hits coast", 200), ("!!", 999)]
    topics = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq long, topic string, score int")
    assert [(r["place"], r["topic"]) for r in P.digest(topics, 2).collect()] == [(1, "market crash in europe"), (2, "new phone")]
    assert P.digest(topics.limit(0)).columns == ["place", "seq", "topic", "score"] and P.digest(topics.limit(0)).count() == 0


def test_digest_looks_at_all_topics(spark):
    """Hundreds alike before the second that isn't, and ties, as a greedy loop over all has it."""
    rnd = random.Random(5)
    names = [f"market crash in europe {i}" for i in range(400)] + ["".join(rnd.choice("abcdef") for _ in range(rnd.randrange(1, 14))) for _ in range(60)]
    rows = [(i, t, 500 - i // 3) for i, t in enumerate(names)]

    def share(x, y):
        if x in y or y in x:
            return 1.0
        a, b = ({z[i : i + 2] for i in range(max(1, len(z) - 1))} for z in (x, y))
        return len(a & b) / min(len(a), len(b)) if min(len(x), len(y)) >= 8 else 0.0

    want = []
    for _, t, _ in sorted(rows, key=lambda r: (-r[2], r[0])):
        if len(want) < 5 and all(share(t.replace(" ", ""), w.replace(" ", "")) < 0.72 for w in want):
            want.append(t)
    assert [r["topic"] for r in P.digest(spark.createDataFrame(rows, "seq long, topic string, score int")).orderBy("place").collect()] == want


def test_answers_of_a_classifier(spark):
    body = '```json\n[{"id": 1, "tag": "a", "score": 0.2}, {"id": 1, "tag": "b", "score": 7}, {"id": 2, "tag": "c"}, {"id": 9, "tag": "x"}]\n```'
    answers = spark.createDataFrame([(1, body), (2, "no json")], "batch int, body string")
    ids = spark.createDataFrame([(1,), (2,)], "id long")
    assert {(r["id"], r["tag"], r["score"]) for r in P.best_tags(answers, ids).collect()} == {(1, "b", 1.0), (2, "c", 0.5)}
    want = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "batch int, id string")
    got = spark.createDataFrame([(1, "x"), (1, "x"), (1, "q"), (2, "z")], "batch int, id string")
    assert {tuple(r) for r in P.returned_ids(want, got).collect()} == {(1, 1, 1, 1, False), (2, 0, 0, 0, True)}


def test_presented_bound_and_dashboard(spark):
    c = spark.createDataFrame([("1", "b", "alert", 70.0), ("2", "a", "alert", 70.0), ("3", "c", "urgent", 90.0), ("4", "d", "watch", 10.0)], "candidate_id string, title string, level string, score double")
    assert [r["candidate_id"] for r in P.presented(c).collect()] == ["3", "2", "1"]
    ids, s, d = c.select("candidate_id"), c.select("candidate_id", "score"), c.select("candidate_id", "level")
    assert P.bound(ids, s, d).count() == 4
    with pytest.raises(ValueError, match="together"):
        P.bound(ids, s.unionByName(s), d)
    doc = P.dashboard(levels=c.groupBy("level").count(), top=c.select("title")).collect()
    assert len(doc) == 1 and '"title":"a"' in doc[0]["document"]
