"""Columns over literal rows whose results are stated as rows too."""

import hashlib

from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions.entities import entities, is_specific
from tidemark.functions.moments import time_for_reader
from tidemark.operators import adapters as A
from tidemark.plans.rules import parse_rules


def _numbered(spark, inputs: list[tuple], schema: str):
    return spark.createDataFrame([(i, *x) for i, x in enumerate(inputs)], f"no int, {schema}")


ENTITIES = [
    ("GDP up 5% as AI bets $1,200 million", "$1200 5% gdp"),
    ("GLM-5.2 beats F-35, G7 and HBM4E", "f-35 g7 glm-5.2 hbm4e"),
    ("NO deal: US up", ""),
    ("City 4-2 Rovers, 1% and 49% of 12,345 in 1999 or 2101", "2101 345 4-2 49% city rovers"),
    ("Breaking: Monday News from Paris about \u82f9\u679c", "Apple paris"),
    (None, ""),
]


def test_entity_cases(spark):
    rows = _numbered(spark, [(t,) for t, _ in ENTITIES], "title string")
    got = rows.select("no", F.array_join(entities(F.col("title"), {"\u82f9\u679c": "Apple"}), " ").alias("entities"))
    assert sorted(tuple(r) for r in got.collect()) == sorted([(i, e) for i, (_, e) in enumerate(ENTITIES)])


SPECIFIC = [("glm-5.2", True), ("$5", True), ("49%", True), ("paris", True), ("china", False), ("", False)]


def test_specific_entity_cases(spark):
    got = _numbered(spark, [(e,) for e, _ in SPECIFIC], "entity string").select("no", is_specific(F.col("entity"), ["china", "trump"]).alias("telling"))
    assert sorted(tuple(r) for r in got.collect()) == sorted([(i, w) for i, (_, w) in enumerate(SPECIFIC)])


URLS = [
    ("https://s.weibo.com/weibo?q=test&band_rank=6&Refer=top", "weibo", "https://s.weibo.com/weibo?q=test"),
    ("https://s.weibo.com/weibo?q=test&t=31", None, "https://s.weibo.com/weibo?q=test&t=31"),
    ("https://example.com/page?id=1&utm_source=twitter", "", "https://example.com/page?id=1"),
    ("https://h/p?a-b=1&a=2", "", "https://h/p?a=2&a-b=1"),
    ("https://h/p?k=2&k=1&flag", "", "https://h/p?flag=&k=2&k=1"),
    ("https://h/p?q=%e4%b8%ad+x", "", "https://h/p?q=%E4%B8%AD+x"),
    ("https://h/p#f?x=1", "", "https://h/p#f?x=1"),
    ("https://h/p?ref=1#z", "", "https://h/p"),
    ("https://h/p?q=%zz%41&a=%4", "", "https://h/p?a=%254&q=%25zzA"),
]


def test_platform_url_cases(spark):
    got = _numbered(spark, [x[:2] for x in URLS], "url string, platform string").select("no", X.normal_url(F.col("url"), F.col("platform")).alias("normal"))
    assert sorted(tuple(r) for r in got.collect()) == sorted([(i, w) for i, (_, _, w) in enumerate(URLS)])


EVENT_URLS = [(" HTTPS://Host.COM/Path?Q=A#frag ", "https://host.com/Path?Q=A"), ("bare Token", "bare Token"), ("", ""), (None, "")]


def test_event_url_cases(spark):
    got = _numbered(spark, [(u,) for u, _ in EVENT_URLS], "url string").select("no", X.event_url(F.col("url")).alias("normal"))
    assert sorted(tuple(r) for r in got.collect()) == sorted([(i, w) for i, (_, w) in enumerate(EVENT_URLS)])


def test_url_fingerprint_cases(spark):
    rows = spark.createDataFrame([(["https://B/y#1", "https://a/x", "https://A/x"], [" ", None])], "a array<string>, b array<string>")
    got = rows.select(X.url_fingerprint(F.col("a")).alias("one"), X.url_fingerprint(F.col("b")).alias("none"))
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()[:16]
    assert tuple(got.first()) == (digest("https://a/x\nhttps://b/y"), digest(""))


TITLES = [
    ("\uff21\uff29\u3000Chip\uff0c\tnews ", "ai chip, news", "ai chip news"),
    ("Snake_Case  Title!", "snake_case title!", "snake_case title"),
    ("\u4e2d\u6587AI\u70ed\u641c x1", "\u4e2d\u6587ai\u70ed\u641c x1", "\u4e2d\u6587ai\u70ed\u641c x1"),
    (None, "", None),
]


def test_folded_title_cases(spark):
    rows = _numbered(spark, [(t,) for t, *_ in TITLES], "title string")
    got = rows.select("no", X.event_title(F.col("title")).alias("event_title"), X.normal_title(F.col("title")).alias("topic_title"))
    assert sorted(tuple(r) for r in got.collect()) == sorted([(i, *w) for i, (_, *w) in enumerate(TITLES)])


TOKENS = [("\u4e2d\u6587AI\u70ed\u641c x1", "ai x1 \u4e2d\u6587 \u70ed\u641c"), ("\u70ed a", "a \u70ed"), ("\U00020000\U00020001\U00020002", "\U00020000\U00020001 \U00020001\U00020002"), ("a_b a_b", "a_b")]


def test_topic_token_cases(spark):
    rows = _numbered(spark, [(t,) for t, _ in TOKENS], "title string")
    got = rows.select("no", F.array_join(F.array_sort(X.topic_tokens(F.col("title"))), " ").alias("tokens"))
    assert sorted(tuple(r) for r in got.collect()) == sorted([(i, w) for i, (_, w) in enumerate(TOKENS)])


IDENTITIES = [
    ((" HotList ", " s1 ", "f", " T ", "u"), "hotlist\x1fs1\x1fT"),
    (("rss", "s", "f1", "T", "http://u"), "rss\x1ff1\x1fhttp://u"),
    (("rss", "s", None, "T", None), "rss\x1f\x1fT"),
    ((None, "s", "f", None, "u"), "unknown\x1ff\x1f"),
]


def test_item_identity_cases(spark):
    rows = _numbered(spark, [x for x, _ in IDENTITIES], "kind string, source_id string, feed_id string, title string, url string")
    got = rows.select("no", X.item_identity(*[F.col(c) for c in ("kind", "source_id", "feed_id", "title", "url")]).alias("identity"))
    assert sorted(tuple(r) for r in got.collect()) == sorted([(i, w) for i, (_, w) in enumerate(IDENTITIES)])


ACCOUNTS = [
    ("https://t.me/s/some_channel/", "some_channel", None),
    ("https://t.me/some_channel", None, None),
    ("https://www.x.com/name1", None, "name1"),
    ("https://twitter.com/name1?lang=en", None, None),
    ("http://x.com/name1", None, None),
    ("https://x.com:443/name1", None, None),
]


def test_account_name_cases(spark):
    rows = _numbered(spark, [(u,) for u, *_ in ACCOUNTS], "url string")
    got = rows.select("no", X.account_name(F.col("url"), "telegram_html").alias("telegram"), X.account_name(F.col("url"), "x_public").alias("x"))
    assert sorted(tuple(r) for r in got.collect()) == sorted([(i, *w) for i, (_, *w) in enumerate(ACCOUNTS)])


RUNS = [("[Live] GPT4 \u4eba\u5de5\u667a\u80fd\u300a\u62a5\u544a\u300b the News http://a/b", "GPT4|\u4eba\u5de5\u667a\u80fd\u62a5\u544a|News"), ("a \u4e2d x1 OK ok", "OK|ok")]


def test_word_run_cases(spark):
    rows = _numbered(spark, [(t,) for t, _ in RUNS], "title string")
    got = rows.select("no", F.array_join(X.word_runs(F.col("title"), ["the"]), "|").alias("words"))
    assert sorted(tuple(r) for r in got.collect()) == sorted([(i, w) for i, (_, w) in enumerate(RUNS)])


FILE = "[global_filter]\nspam\n/x.*y/\n+not\n\n[Word_Groups]\n[Cars]\n/(?P<n>aud)i/ => Audi\n+red\n@2\n\nplain => Shown\nother\n[late]\n+need\n!bad"
MATCHES = [("red AUDI", "Cars"), ("need other", "Shown / other / [late] / need"), ("need other bad", None), ("/x.*y/ red audi", None), ("xay red audi", "Cars")]


def test_rule_file_cases(spark):
    rules = parse_rules(FILE)
    names = F.array(*[F.lit(g.name) for g in rules.groups])
    rows = _numbered(spark, [(t,) for t, _ in MATCHES], "title string")
    got = rows.select("no", F.get(names, rules.first_group(F.col("title"))).alias("group_name"))
    assert sorted(tuple(r) for r in got.collect()) == sorted([(i, w) for i, (_, w) in enumerate(MATCHES)])


SECRETS = [
    ("sk-abcdefgh Authorization: Bearer-xyz passwd='q w", "sk-abcdefgh [redacted] [redacted] w"),
    ("see\n\thttps://a.b/c  and 1234567 x12345678", "see [redacted] and 1234567 x12345678"),
    ("word " * 60, ("word " * 60)[:177].rstrip() + "..."),
    (None, ""),
]


def test_redaction_cases(spark):
    got = _numbered(spark, [(t,) for t, _ in SECRETS], "text string").select("no", X.redacted(F.col("text")).alias("redacted"))
    assert sorted(tuple(r) for r in got.collect()) == sorted([(i, w) for i, (_, w) in enumerate(SECRETS)])


TIMES = [
    ("2025-12-29T00:20:00", "12-29 08:20"),
    ("2025-12-29T00:20:00+00:00", "12-29 08:20"),
    ("2025-12-29T20:20:00Z", "12-30 04:20"),
    ("2025-12-29T00:20:00.123", "12-29 08:20"),
    ("2025-12-29 10:00:00", "12-29 18:00"),
    ("2025-12-29T10:00:00+08:00", "12-29 10:00"),
    ("2025-99-29T10:00:00", "99-29 10:00"),
    ("soon", "soon"),
    ("", ""),
    (None, ""),
]


def test_reader_time_cases(spark):
    got = _numbered(spark, [(t,) for t, _ in TIMES], "at string").select("no", time_for_reader(F.col("at")).alias("shown"))
    assert sorted(tuple(r) for r in got.collect()) == sorted([(i, s) for i, (_, s) in enumerate(TIMES)])


CASES = [
    ([], None, None, None, "missing", None, False, 0, False, None, "unknown", "unknown"),
    ([0, 99], [], 0, False, "off_list", None, False, 0, False, None, "unknown", "unknown"),
    ([99], [None], 2, True, "no_rank", None, False, 0, False, None, "crawl_count", "incremental_first_crawl"),
    ([50, 10], [50, None, 10], 2, True, "visible", 10, True, 2, False, None, "crawl_count", "incremental_first_crawl"),
    ([30, 10], [30, 10], 2, False, "visible", 10, True, 2, True, 20, "crawl_count", "unknown"),
    ([7], [7, None], 1, None, "visible", None, True, 1, True, None, "crawl_count", "unknown"),
    ([5, 3], [5, 99], 1, None, "visible", None, True, 1, True, None, "crawl_count", "unknown"),
    ([4], None, 1, None, "visible", 4, False, 0, False, None, "crawl_count", "unknown"),
]
OUT = "kind_of_rank, rank, reliable, times_visible, before_visible, rank_delta, count_meaning, new_meaning"


def test_list_item_cases(spark):
    schema = "no int, ranks array<long>, timeline array<long>, count int, is_new boolean, first_time string, last_time string"
    rows = spark.createDataFrame([(i, *r[:4], None, None) for i, r in enumerate(CASES)], schema)
    got = A.list_items(rows, "daily", True).selectExpr("no", *OUT.split(", "))
    assert sorted(tuple(r) for r in got.collect()) == [(i, *r[4:]) for i, r in enumerate(CASES)]


FEED_CASES = [
    ("2024-01-01", None, None, 1, True, True, False, "rss_item_count", "new_titles_detection"),
    (None, None, None, 0, None, False, False, "unknown", "unknown"),
    (None, "09-00", "09-00", 1, True, True, True, "rss_item_count", "new_titles_detection"),
]


def test_feed_item_cases(spark):
    rows = spark.createDataFrame([(i, *r[:5]) for i, r in enumerate(FEED_CASES)], "no int, published_at string, first_time string, last_time string, count int, is_new boolean")
    got = A.feed_items(rows, "incremental", False).select("no", "has_times", "times_made_up", "count_meaning", "new_meaning")
    assert sorted(tuple(r) for r in got.collect()) == [(i, *r[5:]) for i, r in enumerate(FEED_CASES)]
