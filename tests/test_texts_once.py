"""Texts are read as few times as they need: what comes out, and how often the plan looks at them."""

from pyspark.sql import functions as F

from tidemark.functions import reader
from tidemark.functions import text as X
from tidemark.functions.entities import entities
from tidemark.operators import reports
from tidemark.operators import search as S


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_each_kind_of_entity_is_taken_out_once(spark):
    rows = spark.createDataFrame([("Paid $1,200 for GLM-5.2 after 4-2, up 45% to 777 in 2024 Paris",), ("Only Paris said",), (None,)], "t string")
    out = rows.select(entities(F.col("t")))
    assert [r[0] for r in out.collect()] == [["$1200", "4-2", "45%", "777", "glm-5.2", "paid", "paris"], ["only", "paris"], []]
    assert plan_of(out).count("regexp_replace") < 10  # those of one kind were repeated for each later kind


def test_digest_looks_at_more_topics_only_if_the_first_do_not_yield_enough(spark):
    rows = spark.createDataFrame([(t, s, k) for k, (t, s) in enumerate([("...", 9), ("river news", 8), ("river news!", 7), ("other thing", 6), ("River  news", 6), ("last one", 1)])], "topic string, score long, seq long")
    for first in (1, 2, 4, 1000):
        assert [(r["place"], r["topic"]) for r in reports.digest(rows, 3, first=first).collect()] == [(1, "river news"), (2, "other thing"), (3, "last one")]


REFERENCE = "The and attion to thanedble the, anea."


def related_rows(spark):
    titles = ["att[x]ion thanedble", "x" * 300, "attion " + "word " * 40, "thanehttp://a b", "anea", "Attion thanedble anea", "zzzz", REFERENCE]
    return spark.createDataFrame([(k, t, "s") for k, t in enumerate(titles)], "seq long, title string, source_id string").withColumn("day", F.lit("2024-01-06").cast("date"))


def score_of(rows, share):
    similar = X.jaccard(F.array_distinct(X.keywords(F.col("title"))), F.array_distinct(X.keywords(F.lit(REFERENCE))))
    return rows.withColumn("score", (1 - share) * similar + share * X.sequence_ratio(F.lit(REFERENCE), F.col("title")))


def test_titles_without_a_chance_are_not_taken_apart(spark):
    rows = related_rows(spark)
    for share, threshold in ((0.3, 0.2), (0.7, 0.3), (0.0, 0.1)):
        out = S.related_by_keywords(rows, REFERENCE, threshold, share)
        want = score_of(rows, share).where(F.col("score") >= threshold).where(F.col("title") != REFERENCE)
        assert sorted((r["seq"], round(r["score"], 9)) for r in out.collect()) == sorted((r["seq"], round(r["score"], 9)) for r in want.collect())
        assert "contains(lower" in plan_of(out).lower()


def test_ratios_of_days_are_only_taken_where_they_can_matter(spark):
    rows = related_rows(spark)
    out, _ = S.related_in_days(rows, REFERENCE, "2024-01-05", "2024-01-20", 0.2)
    want = score_of(rows, 0.3).where("score >= 0.2")
    assert sorted((r["seq"], round(r["score"], 9)) for r in out.collect()) == sorted((r["seq"], round(r["score"], 9)) for r in want.collect())
    assert "contains(lower" in plan_of(out).lower()


def test_noise_is_judged_by_few_patterns(spark):
    texts = ["Watch NBA tonight", "xNBA NBA2", "C罗 scores", "c罗", "steam夏促", "T1", "at1", "S赛", "T1 2-1 官方通报", "LPL", "aLPL", "LPLx", "VCTLPL", "CS  major", "Ig vs x", "IG vs x", "xIG vs y", "XIG vs y", "viper", "viper 状态", "ＬＰＬ", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    words = [w for ws in reader.CATEGORIES.values() for w in ws] + ["a-b"]
    got = rows.select(X.any_keyword(F.col("t"), words), F.array(*[X.contains_keyword(F.col("t"), w) for w in words])).collect()
    assert [r[0] for r in got] == [None if t is None else any(r[1]) for t, r in zip(texts, got, strict=True)]
    out = rows.select("t", reader.about_games(F.col("t")).alias("games"), reader.is_noise(F.col("t"), F.array("t"), F.lit(False), no_games=True).alias("noise"))
    assert {r["t"] for r in out.collect() if r["games"]} == {"T1", "S赛", "T1 2-1 官方通报", "LPL", "VCTLPL", "CS  major", "IG vs x", "XIG vs y", "viper 状态", "ＬＰＬ"} - {"VCTLPL"}
    assert plan_of(out.select("noise")).count("RLIKE") < 30


def test_normal_titles_and_tokens_take_one_pass(spark):
    texts = ["  A,  b C_d! ", "x\x1cy\x85z", " \t", "AI热搜 中 x1", "É-é  ﬁ", "a b", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    out = rows.select(X.normal_title(F.col("t")).alias("n"), X.event_title(F.col("t")).alias("e"), F.array_sort(X.topic_tokens(F.col("t"))).alias("k"))
    assert [r["n"] for r in out.collect()] == ["a b c_d", "x y z", "", "ai热搜 中 x1", "é é fi", "a b", "", None]
    assert [r["e"] for r in out.collect()] == ["a, b c_d!", "x y z", "", "ai热搜 中 x1", "é-é fi", "a b", "", ""]
    assert [r["k"] for r in out.collect()] == [["a", "b", "c_d"], ["x", "y", "z"], [], ["ai", "x1", "中", "热搜"], ["fi", "é"], ["a", "b"], [], None]
    assert plan_of(rows.select(X.normal_title(F.col("t")).alias("n"))).count("regexp_replace(") == 1
