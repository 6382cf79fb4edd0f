from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.functions import moments as M
from tidemark.functions import text as X
from tidemark.operators import grouping as G
from tidemark.plans.rules import parse_rules

RULES = """
[GLOBAL_FILTER]
spam

[WORD_GROUPS]
# first
[A]
x

[B]
+y
x
z

[C]
!bad
/q+w/ => Qs
@2
"""


def titles(spark, *texts):
    return spark.createDataFrame([(i, f"s{i}", t, i + 1) for i, t in enumerate(texts)], "seq int, source_id string, title string, rank int")


def test_first_group_in_file_order_wins_and_filters_hold_for_all(spark):
    r = parse_rules(RULES)
    df = titles(spark, "x y", "y z", "y", "X bad", "spam x", "qqw", " ", None, "none")
    got = {row["seq"]: row["g"] for row in df.select("seq", r.first_group(F.col("title")).alias("g")).collect()}
    assert got == {0: 0, 1: 1, 2: None, 3: None, 4: None, 5: 2, 6: None, 7: None, 8: None}
    assert [g.name for g in r.groups] == ["A", "B", "C"] and r.groups[2].most == 2
    pair = G.swallowed(df, r).collect()
    assert [(p["winner"], p["other"], p["n"]) for p in pair] == [(0, 1, 1)]


def test_no_groups_match_all_that_pass(spark):
    r = parse_rules("[GLOBAL_FILTER]\nspam")
    assert [x["m"] for x in titles(spark, "a", "spam", "").select(r.matches(F.col("title")).alias("m")).collect()] == [True, False, False]


def test_broken_pattern_is_plain_text(spark):
    r = parse_rules("/a(/")
    assert not r.groups[0].normal[0].is_pattern


def test_counts_share_and_catch_all(spark):
    r = parse_rules("x\n@1")
    df = spark.createDataFrame([(1, "s", "x a", 9), (2, "s", "x b", 3), (3, "s", "other", 5), (4, "t", "other", 1), (5, "s", "low", 6), (6, "s", "top", 2)], "seq int, source_id string, title string, rank int")
    one = G.group_counts(df, r).first()
    assert (one["n"], round(one["percentage"], 3)) == (2, 33.333)
    assert [x["seq"] for x in G.capped(df, r, [F.col("rank"), F.col("seq")]).collect()] == [2]
    # the first source of a title stays though a later one ranks higher
    assert [(x["title"], x["rank"]) for x in G.catch_all(df, r).collect()] == [("top", 2), ("other", 5)]


def test_tokens_of_chinese_runs_are_pairs(spark):
    df = spark.createDataFrame([("中文AI热搜 x1",), ("热 a",), ("",)], "t string")
    got = [set(r["x"]) for r in df.select(X.topic_tokens(F.col("t")).alias("x")).collect()]
    assert got == [{"中文", "ai", "热搜", "x1"}, {"热", "a"}, set()]


def test_overlap_is_by_the_smaller_set(spark):
    df = spark.createDataFrame([(["a", "b"], ["a", "b", "c", "d"]), ([], ["a"])], "a array<string>, b array<string>")
    got = df.select(X.overlap(F.col("a"), F.col("b")).alias("o"), X.jaccard(F.col("a"), F.col("b")).alias("j")).collect()
    assert [(r["o"], r["j"]) for r in got] == [(1.0, 0.5), (0.0, 0.0)]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://h/p?b=2&utm_source=x&a=1#f", "https://h/p?a=1&b=2"),
        ("https://h/p#f", "https://h/p#f"),
        ("https://h/p?ref=1", "https://h/p"),
        ("https://h/p?a-b=1&a=2", "https://h/p?a=2&a-b=1"),
        ("https://h/p?k=2&k=1&flag", "https://h/p?flag=&k=2&k=1"),
        ("https://h/p?q=%e4%b8%ad+x&~=*", "https://h/p?q=%E4%B8%AD+x&~=%2A"),
        ("https://h/p#f?x=1", "https://h/p#f?x=1"),
        ("HTTPS://H/p?x=1", "https://H/p?x=1"),
        ("https://h/p?UTM_Source=1#z", "https://h/p"),
        ("", ""),
        ("https://h/p?t=2", "https://h/p?t=2"),
    ],
)
def test_urls(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(X.normal_url(F.col("u"))).first()[0] == want


def test_a_platforms_own_parameters(spark):
    df = spark.createDataFrame([("https://s.weibo.com/w?q=test&band_rank=6&Refer=top&t=1", "weibo"), ("https://s.weibo.com/w?q=1&t=2", "other"), ("https://h/?t=1", None)], "u string, p string")
    got = [r[0] for r in df.select(X.normal_url(F.col("u"), F.col("p"))).collect()]
    assert got == ["https://s.weibo.com/w?q=test", "https://s.weibo.com/w?q=1&t=2", "https://h/?t=1"]


def test_titles_and_urls_of_events(spark):
    titles = [("ＡＩ　Chip，\tnews ", "ai chip,news"), ("Ａ_b  C", "a_b c"), (None, ""), ("  ", "")]
    df = spark.createDataFrame([(a,) for a, _ in titles], "t string")
    assert [r[0] for r in df.select(X.event_title(F.col("t"))).collect()] == ["ai chip, news", "a_b c", "", ""]
    assert [r[0] for r in df.select(X.normal_title(F.col("t"))).collect()][:2] == ["ai chip news", "a_b c"]
    urls = [(" HTTPS://Host.COM/Path?Q=A#frag ", "https://host.com/Path?Q=A"), ("bare Token", "bare Token"), ("", ""), (None, "")]
    df = spark.createDataFrame([(a,) for a, _ in urls], "u string")
    assert [r[0] for r in df.select(X.event_url(F.col("u"))).collect()] == [w for _, w in urls]
    both = spark.createDataFrame([(["https://A/x#1", "https://a/x"], ["https://a/x", " ", None])], "a array<string>, b array<string>")
    row = both.select(X.url_fingerprint(F.col("a")), X.url_fingerprint(F.col("b"))).first()
    assert row[0] == row[1] and len(row[0]) == 16


def test_secrets_go_and_long_texts_end_in_dots(spark):
    texts = ["sk-abcdefgh Authorization: Bearer-xyz passwd='q w", "see\n\thttps://a.b/c  and 1234567 x12345678", "word " * 60, None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.redacted(F.col("t"))).collect()]
    assert got[0] == "sk-abcdefgh [redacted] [redacted] w" and got[1] == "see [redacted] and 1234567 x12345678"
    assert got[2] == ("word " * 60)[:177].rstrip() + "..." and got[3] == ""


def test_rule_files(spark):
    r = parse_rules("[global_filter]\nspam\n/x.*y/\n+not\n!this\n\n[Word_Groups]\n[Cars]\n# note\n/(?P<n>aud)i/ => Audi\n+red\n@2\n@x\n\nplain => Shown\nother\n[late]\n+need\n!bad\n\n@5")
    assert [w.text for w in r.global_filters] == ["spam", "/x.*y/"] and [w.text for w in r.filters] == ["bad"]
    assert [(g.name, g.most, len(g.normal), len(g.required)) for g in r.groups] == [("Cars", 2, 1, 1), ("Shown / other / [late] / need", 0, 3, 1)]
    df = spark.createDataFrame([("red AUDI",), ("need other",), ("need other bad",), ("/x.*y/ red audi",), ("xay red audi",)], "t string")
    assert [x[0] for x in df.select(r.first_group(F.col("t"))).collect()] == [0, 1, None, None, 0]
    alone = parse_rules("[GLOBAL_FILTER]\nspam\n\n[WORD_GROUPS]\n!bad")
    assert [x[0] for x in spark.createDataFrame([("bad",), ("spam",), (" ",)], "t string").select(alone.matches(F.col("t"))).collect()] == [True, False, False]


def test_nfkc_ratio_and_redaction(spark):
    df = spark.createDataFrame([("ＡＢ①", "abcd", "bcde", "mail a.b@c.de and Jane Doe 123456789")], "a string, b string, c string, d string")
    row = df.select(X.nfkc(F.col("a")), X.sequence_ratio(F.col("b"), F.col("c")), X.redacted(F.col("d"))).first()
    assert (row[0], row[1], row[2]) == ("AB1", 0.75, "mail [redacted] and [name] [redacted]")


def test_keyword_borders(spark):
    df = spark.createDataFrame([("an ai tool",), ("said so",), ("电竞赛",)], "t string")
    assert [r[0] for r in df.select(X.contains_keyword(F.col("t"), "AI")).collect()] == [True, False, False]
    assert [r[0] for r in df.select(X.contains_keyword(F.col("t"), "电竞")).collect()] == [False, False, True]


def test_quiet_hours_over_midnight(spark):
    df = spark.createDataFrame([("22:59",), ("23:00",), ("07:59",), ("08:00",)], "c string")
    assert [r[0] for r in df.select(M.in_window(F.col("c"), "23:00", "08:00")).collect()] == [False, True, True, False]
    assert not any(r[0] for r in df.select(M.in_window(F.col("c"), "08:00", "08:00")).collect())


def test_unknown_dates_are_fresh(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:00Z",), ("2024-01-09T00:00:00+02:00",), ("2024-01-09 10:00:00",), (None,), ("soon",)], "t string")
    now = F.lit("2024-01-10").cast("timestamp")
    assert [r[0] for r in df.select(M.is_fresh(M.parsed(F.col("t")), now, 3)).collect()] == [False, True, True, True, True]


def test_named_ranges_differ_from_comparison_periods():
    today = date(2024, 1, 10)  # a Wednesday
    assert M.named_range("last_week", today) == (date(2024, 1, 1), date(2024, 1, 7))
    assert M.comparison_period("last_week", today) == (date(2024, 1, 3), date(2024, 1, 9))
    assert M.named_range("last_7_days", today) == (date(2024, 1, 4), today)
    assert M.named_range("last_month", today) == (date(2023, 12, 1), date(2023, 12, 31))
    with pytest.raises(ValueError, match="unknown"):
        M.named_range("someday", today)
