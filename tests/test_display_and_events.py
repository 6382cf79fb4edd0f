import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import display as D
from tidemark.functions import reader as R
from tidemark.functions import records as J
from tidemark.operators import events as E
from tidemark.operators import reports as P
from tidemark.sources import feeds


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}").orderBy("i").select(column).collect()]


def test_reasons(spark):
    rows = [
        (["rank_movement=21.0(delta=20)", "new_burst=12", "best_rank_heat=26(rank=7)", "source_coverage_heat=8(n=3)", "weak_persistence=5"],),
        (["new_burst=4", "recency_momentum=4.0", "odd=9", "best_rank_heat=9"],), (["new_burst=0", "new_burst=1.2.3"],), ([],), (None,),
    ]
    want = ["#7; rank↑21.0; burst+12.0; src 3", "burst+4.0; momentum+4.0; src 1"] + ["score threshold"] * 3
    assert values(spark, D.trigger_summary(F.col("x")), rows, "x array<string>") == want


def test_statuses(spark):
    status = D.reader_status(*map(F.col, ("section", "status", "tiers", "d", "n")))
    rows = [("silence_gap", "高热待核实", ["C", "D"], 3, 3), ("silence_gap", "高热待核实", ["C", "D"], 1, 3), ("x", "高热待核实", ["A", "C", "D"], 3, 3), ("silence_gap", None, None, None, None), ("x", "own", [], 0, 0), (None, None, None, None, None)]
    assert values(spark, status, rows, "section string, status string, tiers array<string>, d int, n int") == ["中文多源覆盖", "中文多平台覆盖", "单点高热，来源待补", "社交端响应偏弱", "own", ""]
    section = D.event_section(F.col("a"), F.col("b"))
    assert values(spark, section, [("x", "沉默温差"), ("x", "other"), ("x", None)], "a string, b string") == ["silence_gap", "x", "x"]


def test_notes_and_summaries(spark):
    note = D.evidence_note(*map(F.col, "abcd"))
    assert values(spark, note, [("A/D", 3, "第1名", True), ("-", 0, None, None)], "a string, b int, c string, d boolean") == ["层级 A/D · 3 个来源 · 第1名 · 情绪聚集", ""]
    day = D.overview_sentence(*map(F.col, "abcdef"))
    assert values(spark, day, [(3, 1, 2, 0, 0, 4), (None, 0, 0, 0, 0, 0)], "a int, b int, c int, d int, e int, f int") == [
        "今日识别 3 个异常信号：1 个多层来源呼应、2 个中文源内部升温；另有 4 个非重点项已折叠。", "今日识别 0 个异常信号：未发现达到异常阈值的主信号。",
    ]
    made = D.sample_summary(*map(F.col, "abcdef"))
    got = values(spark, made, [("t", "s", "D", 3, "08:00", None), ("t", None, "A", None, None, "said so"), (None, "s", None, None, None, None)], "a string, b string, c string, d int, e string, f string")
    assert got == ["“t”相关内容进入s榜单第3名，观测时间为08:00。采集记录未附来源正文，因此无法补充标题之外的信息。", "未知来源的来源摘录显示，said so。", "s出现一条未提供标题的来源记录。采集记录未附正文摘录。"]
    topic = D.topic_summary(*map(F.col, "abcd"), F.col("e"))
    got = values(spark, topic, [("high_heat_unverified", None, "未归类·x", "榜1", ["y"]), ("x", None, "t", None, ["a", "a https://u.v", "b", "c"]), ("x", None, "t", None, None)], "a string, b string, c string, d string, e array<string>")
    assert got == ["“x”进入榜1；目前只能确认传播热度，不能据此确认标题中的说法。", "当前可核对的标题包括“a”；“b”；它们可能指向不同事件。", ""]


def test_boilerplate_and_lengths(spark):
    rows = [("该事件存在传播风险。",), ("本组都是",), ("某公司宣布停产，事实仍待核验",), ("",), (None,), ("fixed",)]
    assert values(spark, D.is_boilerplate(F.col("x"), ["fixed"]), rows, "x string") == [True, True, False, True, True, True]
    assert values(spark, D.visible_length(F.col("x")), [("<b>a &amp; b</b>",), (None,)], "x string") == [5, 0]


@pytest.mark.parametrize(
    ("text", "want"),
    [("LPL 春季赛", True), ("ＢＬＧ赢了", True), ("T1-2 轮", False), ("T1 vs Gen", True), ("AL 战胜对手", True), ("AL is a state", False), ("Viper 开播", True), ("Viper snake", False), ("NS 2:1", True), ("股市", False), (None, False)],
)
def test_games(spark, text, want):
    assert values(spark, R.about_games(F.col("x")), [(text,)], "x string") == [want]


def test_noise(spark):
    noise = R.is_noise(F.col("t"), F.col("s"), F.col("g"), no_games=True)
    rows = [("明星恋情", [], False), ("明星恋情被监管通报", [], False), ("股市", ["LPL 决赛"], False), ("股市", ["LPL 决赛"], True), ("未归类·股市", ["电影票房"], True), (None, None, False), ("LPL 被处罚", [], False)]
    assert values(spark, noise, rows, "t string, s array<string>, g boolean") == [True, False, True, False, True, False, True]
    assert values(spark, R.first_word(F.col("x"), R.STRUCTURAL), [("警方调查 下架",), ("",), (None,)], "x string") == ["下架", None, None]


def test_records(spark):
    records = [
        {"payload": {"type": "user_message", "message": "hello there"}}, {"payload": {"type": "function_call", "arguments": "rm"}}, {"type": "assistant", "message": {"role": "assistant", "content": [{"text": "hi you"}]}},
        {"message": {"role": "user", "content": "inner"}}, {"role": "human", "x": {"y": "deep text"}}, ["bare"],
    ]
    lines = [(json.dumps(r),) for r in records] + [("no json",), (None,)]
    role = J.role_of(F.col("x"))
    assert values(spark, role, lines, "x string") == ["user", "tool", "assistant", "user", "user", "unknown", "unknown", "unknown"]
    said = values(spark, J.spoken(F.col("x"), role), lines, "x string")
    assert said == [["hello there"], [], ["hi you", "hi you"], ["inner"], ["human", "human", "deep text"], ["bare"], ["no json"], []]
    nest = {"content": "a!"}
    for _ in range(60):
        nest = {"content": {"text": []}, "z": nest}
    assert J.texts_of(nest) == ["a!", "a!"]
    for _ in range(200):
        nest = {"content": nest}
    assert len(J.texts_of(nest)) == 12


def test_moments(spark):
    rows = [('{"timestamp": 1700000000000}',), ('{"x": {"time": 1700000000}}',), ('{"date": "soon", "y": {"created_at": "2024-01-05T10:00:00Z"}}',), ("{}",), ("no",), (None,)]
    other = F.lit("2000-01-01 00:00:00").cast("timestamp")
    got = values(spark, F.date_format(F.to_utc_timestamp(J.moment_of(F.col("x"), other), F.current_timezone()), "yyyy-MM-dd HH:mm:ss"), rows, "x string")
    assert got[:3] == ["2023-11-14 22:13:20", "2023-11-14 22:13:20", "2024-01-05 10:00:00"] and len(set(got[3:])) == 1 and got[3].startswith(("2000-01-01", "1999-12-31"))


def test_pattern_totals(spark):
    files = spark.createDataFrame([("f", "Alpha alphabet beta"), ("g", "beta"), ("h", None)], "file string, text string")
    rows = E.pattern_stats(files, {"one": ["alpha", "ALPHABET"], "two": ["alpha"], "none": ["zz"]}).collect()
    assert {r["name"]: (r["matches"], r["files"]) for r in rows} == {"one": (2, 1), "two": (1, 1), "none": (0, 0)}


def greedy(events, known):
    ids, titles, taken = set(), set(), []
    for place, topic, title, claimed in sorted(events):
        claimed = {c for c in claimed if c}
        if title and claimed and claimed <= known and not claimed & ids and (topic, title) not in titles:
            taken.append(place)
            ids |= claimed
            titles.add((topic, title))
    return taken


@pytest.mark.parametrize("seed", [1, 2])
def test_bound_events_as_one_by_one(spark, seed):
    rng = random.Random(seed)
    known = {f"k{i}" for i in range(40)}
    events = [(i, rng.choice("ab"), rng.choice(["", "x", f"t{i}", f"t{i % 7}"]), [f"k{rng.randrange(42)}" for _ in range(rng.randrange(4))]) for i in range(60)]
    frame = spark.createDataFrame(events, "place long, topic string, title string, evidence_ids array<string>")
    got = E.bound_events(frame, spark.createDataFrame([(k,) for k in known] + [(None,)], "evidence_id string"))
    assert sorted(r["place"] for r in got.collect()) == greedy(events, known)
    assert E.bound_events(frame.limit(0), spark.createDataFrame([], "evidence_id string")).count() == 0


def test_events_of_unclaimed(spark):
    evidence = spark.createDataFrame([("e1", "t", "h", "s", "D", 2, None, None), ("e2", "t", None, None, "A", None, None, "quote!"), ("", "t", "h", "s", "D", 2, None, None)], "evidence_id string, topic string, title string, source string, tier string, rank int, seen_at string, excerpt string")
    taken = spark.createDataFrame([(["e1"],)], "evidence_ids array<string>")
    rows = E.events_of_unclaimed(evidence, taken).collect()
    assert [(r["evidence_id"], r["title"], r["summary"], r["analysis"]) for r in rows] == [("e2", "未知来源收录未提供标题的来源记录", "未知来源的来源摘录显示，quote!", "单一A层来源，覆盖平台为未知来源。")]
    assert sorted(r["title"] for r in E.events_of_unclaimed(evidence, taken.limit(0)).collect())[0] == "s出现“h”相关传播"


def test_feeds_merge(spark):
    schema = "seq long, word string, url string, feed string, title string, published_at string, entities array<string>"
    grouped = spark.createDataFrame([(1, "w", "u1", "f", "a", None, None), (2, "v", "u1", "f", "a", None, None), (3, "w", "", "f", "b", "d", ["k"])], schema)
    admitted = spark.createDataFrame([(7, None, "u1", "g", "a", None, ["x"]), (8, None, None, "f", "b", "d", ["y"]), (9, None, "u2", "f", "c", None, None), (10, None, "u2", "f", "c", None, ["z"])], schema).drop("word")
    got = sorted((r["seq"], r["word"], r["entities"]) for r in E.merged_feed_items(grouped, admitted).collect())
    assert got == [(1, "w", None), (2, "v", ["x"]), (3, "w", ["k"]), (9, None, ["z"])]


def test_levels_and_tags(spark):
    rows = spark.createDataFrame([("alert", 70.0), ("suppress", 90.0)], "level string, score double")
    assert [(r["level"], r["n"], r["high"]) for r in E.level_sections(rows).orderBy("section").collect()] == [("urgent", 0, 0), ("alert", 1, 0), ("watch", 0, 0), ("suppress", 1, 1)]
    tags = spark.createDataFrame([(1, " a "), (2, " "), (3, None), (4, "b")], "i int, tag string")
    assert sorted((r["tag"], r["priority"]) for r in E.numbered_tags(tags, "i", 5).collect()) == [("a", 5), ("b", 6)]


def test_digest_order(spark):
    names = ["silence_gap", "high_heat_unverified", "chinese_only_hot", "cross_layer_verified"]
    score = P.digest_score(F.col("x"), F.lit(True), F.lit(20))
    assert values(spark, score, [(n,) for n in names], "x string") == [180, 260, 340, 420]


def post(i, owner, text, **more):
    return {"tweet_results": {"result": {"rest_id": i, "core": {"user_results": {"result": {"legacy": {"screen_name": owner}}}}, "legacy": {"full_text": text, **more}}}}


def test_embedded_posts(spark):
    held = {"entries": [post("1", "Me", "first", created_at="Wed Mar 13 08:00:00 +0000 2024"), post("2", "other", "no", created_at="Wed Mar 13 08:00:00 +0000 2024"), post("x", "me", "no", created_at_ms=1), post("3", "me", "ms", created_at_ms="1700000000000"), post("4", "me", "undated", created_at="soon"), {"quoted_tweet_results": post("5", "me", "quoted", created_at_ms=1)}, post("1", "me", "again", created_at="Wed, 13 Mar 2024 10:00:00 +0200")]}
    html = f"<p>value: \"x\"</p><script nonce=1>push({{kind:1, value: {json.dumps(json.dumps(held))}}}); value: 3; value: \"bad\"</script>"
    pages = spark.createDataFrame([(1, "https://x.com/me", html), (2, "https://y.com/me", html), (3, "https://x.com/me", None), (4, None, html)], "page_id long, url string, html string")
    rows = feeds.embedded_posts(pages).select("page_id", "url", "text", F.unix_timestamp("published_at").alias("t")).orderBy("url").collect()
    assert [tuple(r) for r in rows] == [(1, "https://x.com/me/status/1", "again", 1710316800), (1, "https://x.com/me/status/3", "ms", 1700000000)]
