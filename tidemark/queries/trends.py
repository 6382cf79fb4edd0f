"""Queries of keywords, topics and comparisons."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import compare as C
from tidemark.operators import trends as T
from tidemark.queries.base import TITLES, query, titles, words_of

DAYS = "sp AS (SELECT unnest(generate_series((SELECT min(day) FROM ti), (SELECT max(day) FROM ti), INTERVAL 1 DAY)) AS d), dc AS (SELECT CAST(d AS DATE) AS day, (SELECT count(*) FROM ti WHERE ti.day = CAST(d AS DATE) AND contains(lower(title), 'the')) AS n FROM sp)"


@query(f"WITH {TITLES} SELECT word, count(*) AS n, count(DISTINCT seq) AS titles FROM ws GROUP BY 1")
def keyword_counts(spark, sf_dir):
    return T.keyword_counts(titles(spark, sf_dir))


@query(f"WITH {TITLES} SELECT word, count(*) AS n, count(DISTINCT title) AS matched_news FROM ws WHERE length(word) >= 4 GROUP BY 1 ORDER BY n DESC, word LIMIT 20")
def trending_auto_extract(spark, sf_dir):
    return T.words_of_titles(titles(spark, sf_dir), words_of(F.col("title")), 4).orderBy(F.desc("n"), "word").limit(20)


@query(f"WITH {TITLES}, {DAYS} SELECT * FROM dc")
def topic_daily_counts(spark, sf_dir):
    return T.daily_counts(titles(spark, sf_dir), "the")


@query(f"""WITH {TITLES}, {DAYS}, l AS (SELECT list(n ORDER BY day) AS ns, arg_max(day, (n, -date_diff('day', DATE '1970-01-01', day))) AS peak_day FROM dc),
c AS (SELECT *, list_filter(ns, lambda x: x > 0)[1] AS f FROM l),
o AS (SELECT list_sum(ns) AS total, list_sum(ns) / CAST(len(ns) AS DOUBLE) AS mean, peak_day, list_max(ns) AS peak, CASE WHEN f > 0 THEN (ns[-1] - f) * 100.0::DOUBLE / f ELSE 0.0 END AS change FROM c)
SELECT CAST(total AS BIGINT) AS total, mean, peak_day, peak, change, CASE WHEN change > 10 THEN 'rising' WHEN change < -10 THEN 'falling' ELSE 'stable' END AS direction FROM o""")
def topic_trend(spark, sf_dir):
    return T.trend(T.daily_counts(titles(spark, sf_dir), "the"))


@query(f"""WITH {TITLES}, {DAYS}, l AS (SELECT list(n ORDER BY day) AS ns FROM dc),
v AS (SELECT ns, list_sum(ns[1:3]) AS f, list_sum(ns[greatest(len(ns) - 2, 1):]) AS la, list_max(ns) AS m, len(list_filter(ns, lambda x: x > 0)) AS act, list_sum(ns) AS s FROM l)
SELECT CAST(s AS BIGINT) AS total, m AS peak, act AS active_days, CASE WHEN la > f THEN 'rising' WHEN la < 0.5 * f THEN 'declining' WHEN list_position(ns, m) > len(ns) - 3 THEN 'bursting' ELSE 'stable' END AS stage,
CASE WHEN act <= 2 AND m > 2.0 * s / len(ns) THEN 'flash' WHEN act >= 0.6 * len(ns) THEN 'sustained' ELSE 'periodic' END AS kind FROM v""")
def topic_lifecycle(spark, sf_dir):
    return T.lifecycle(T.daily_counts(titles(spark, sf_dir), "the"))


TWO = "b AS (SELECT word, count(*) AS n FROM ws WHERE day < DATE '2024-01-11' GROUP BY 1), c AS (SELECT word, count(*) AS n FROM ws WHERE day >= DATE '2024-01-11' GROUP BY 1)"


def two_periods(spark, sf_dir):
    rows = titles(spark, sf_dir)
    return T.keyword_counts(rows.where("day < '2024-01-11'")), T.keyword_counts(rows.where("day >= '2024-01-11'"))


@query(f"""WITH {TITLES}, {TWO}, j AS (SELECT c.word, c.n AS current, coalesce(b.n, 0) AS previous, c.n / CAST(b.n AS DOUBLE) AS growth FROM c LEFT JOIN b USING (word))
SELECT word, current, previous, growth, CASE WHEN previous = 0 OR growth > 6 THEN 'high' ELSE 'medium' END AS level, coalesce(growth, CAST(current AS DOUBLE)) AS sort_key FROM j WHERE (previous = 0 AND current >= 5) OR growth >= 3""")
def viral_topics(spark, sf_dir):
    before, after = two_periods(spark, sf_dir)
    return T.viral(after, before)


@query(f"""WITH {TITLES}, d AS (SELECT word, day, count(*) AS n FROM ws WHERE day >= DATE '2024-01-27' GROUP BY 1, 2), l AS (SELECT word, list(n ORDER BY day) AS ns FROM d GROUP BY 1 HAVING count(*) >= 2),
v AS (SELECT word, ns, ns[-1] AS current, list_sum(ns[:-2]) / CAST(len(ns) - 1 AS DOUBLE) AS mean FROM l),
o AS (SELECT word, current, (current - mean) / mean AS growth, CASE WHEN list_bool_and(list_transform(range(1, len(ns)), lambda i: ns[i + 1] >= ns[i])) THEN 0.9 WHEN ns[-1] > ns[-2] THEN 0.7 ELSE 0.6 END AS confidence FROM v)
SELECT word, current, growth, CAST(confidence AS DOUBLE) AS confidence, current * (1 + growth * 6.0 / 24) AS projected FROM o WHERE growth > 0.3 ORDER BY growth DESC, current DESC, word LIMIT 20""".replace("ns[:-2]", "ns[1:len(ns)-1]"))
def predict_topics(spark, sf_dir):
    return T.predicted(T.keyword_counts(titles(spark, sf_dir).where("day >= '2024-01-27'"), "day").drop("titles"))


@query(f"WITH {TITLES} SELECT source_id, count(*) AS n, count(DISTINCT title) AS distinct_titles, count(*) FILTER (contains(lower(title), 'the')) AS mentions, count(*) FILTER (contains(lower(title), 'the')) * 100.0::DOUBLE / count(*) AS coverage FROM ti GROUP BY 1")
def compare_platforms(spark, sf_dir):
    return C.platforms(titles(spark, sf_dir), "the")


TOP = "sc AS (SELECT source_id, word, count(*) AS n FROM ws GROUP BY 1, 2), tp AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY n DESC, word) AS place FROM sc)"


@query(f"WITH {TITLES}, {TOP} SELECT source_id, word, n, place FROM tp WHERE place <= 5")
def platform_top_keywords(spark, sf_dir):
    rows = T.top_by(T.keyword_counts(titles(spark, sf_dir), "source_id"), ["source_id"], 5)
    return rows.select("source_id", "word", "n", F.col("place").cast("long").alias("place"))


@query(f"""WITH {TITLES}, {TOP}, t AS (SELECT * FROM tp WHERE place <= 10), o AS (SELECT word FROM t GROUP BY 1 HAVING count(*) = 1),
u AS (SELECT source_id, word, n, row_number() OVER (PARTITION BY source_id ORDER BY n DESC, word) AS place FROM t WHERE word IN (SELECT word FROM o)) SELECT * FROM u WHERE place <= 5""")
def unique_topics(spark, sf_dir):
    rows = T.unique_words(T.keyword_counts(titles(spark, sf_dir), "source_id"))
    return rows.select("source_id", "word", "n", F.col("place").cast("long").alias("place"))


@query(f"""WITH {TITLES}, nw AS (SELECT seq, unnest(w) AS word, unnest(range(len(w))) AS i FROM (SELECT seq, list_filter(regexp_extract_all(lower(title), '\\p{{L}}+'), lambda x: length(x) >= 2) AS w FROM ti))
SELECT least(a.word, b.word) AS one, greatest(a.word, b.word) AS other, count(*) AS n FROM nw a JOIN nw b ON a.seq = b.seq AND a.i < b.i WHERE a.word <> b.word GROUP BY 1, 2 HAVING count(*) >= 3""")
def cooccurrence(spark, sf_dir):
    return T.cooccurrence(titles(spark, sf_dir))


@query(f"WITH {TITLES}, {TWO} SELECT word, coalesce(b.n, 0) AS n_before, coalesce(c.n, 0) AS n_after, coalesce(c.n, 0) - coalesce(b.n, 0) AS change, CASE WHEN b.n > 0 THEN (coalesce(c.n, 0) - b.n) * 100.0::DOUBLE / b.n ELSE 100.0 END AS percent FROM b FULL JOIN c USING (word)")
def topic_shift(spark, sf_dir):
    return C.shift(*two_periods(spark, sf_dir), "word")


@query(f"""WITH {TITLES}, b AS (SELECT source_id, count(*) AS n FROM ti WHERE day < DATE '2024-01-11' GROUP BY 1), c AS (SELECT source_id, count(*) AS n FROM ti WHERE day >= DATE '2024-01-11' GROUP BY 1)
SELECT source_id, coalesce(b.n, 0) AS n_before, coalesce(c.n, 0) AS n_after, coalesce(c.n, 0) - coalesce(b.n, 0) AS change, CASE WHEN b.n > 0 THEN (coalesce(c.n, 0) - b.n) * 100.0::DOUBLE / b.n ELSE 100.0 END AS percent FROM b FULL JOIN c USING (source_id)""")
def platform_shift(spark, sf_dir):
    rows = titles(spark, sf_dir)
    count = lambda x: rows.where(x).groupBy("source_id").agg(F.count("*").alias("n"))
    return C.shift(count("day < '2024-01-11'"), count("day >= '2024-01-11'"), "source_id")


LISTS = "lb AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) AS place FROM b ORDER BY n DESC, word LIMIT 20), lc AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) AS place FROM c ORDER BY n DESC, word LIMIT 20)"


@query(f"""WITH {TITLES}, {TWO}, {LISTS}, k AS (SELECT word, CASE WHEN lb.place IS NULL THEN 'new' WHEN lc.place IS NULL THEN 'gone' ELSE 'persistent' END AS kind, coalesce(lc.place, lb.place) AS place FROM lb FULL JOIN lc USING (word)),
r AS (SELECT word, kind, row_number() OVER (PARTITION BY kind ORDER BY place, word) AS first_at FROM k) SELECT word, kind, first_at AS "at" FROM r WHERE first_at <= 5""")
def compare_overview(spark, sf_dir):
    def ranked(counts):
        top = counts.orderBy(F.desc("n"), "word").limit(20)
        return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "word"))).select("word", "place")

    return C.kinds_of_change(*map(ranked, two_periods(spark, sf_dir)), "word")


@query(f"WITH {TITLES} SELECT source_id, count(*) AS n, count(DISTINCT day) AS days_active, count(*) / CAST(count(DISTINCT day) AS DOUBLE) AS per_day, count(DISTINCT day) * 100.0::DOUBLE / (SELECT count(DISTINCT day) FROM ti) AS activity_score FROM ti GROUP BY 1")
def activity_stats(spark, sf_dir):
    return C.activity(titles(spark, sf_dir))


@query(f"WITH {TITLES}, a AS (SELECT DISTINCT day FROM ti WHERE lang = 'en'), b AS (SELECT DISTINCT day FROM ti WHERE source_id = 'src3') SELECT day, CASE WHEN b.day IS NULL THEN 'one' WHEN a.day IS NULL THEN 'other' ELSE 'both' END AS where_is FROM a FULL JOIN b USING (day)")
def compare_dates(spark, sf_dir):
    rows = titles(spark, sf_dir)
    return C.set_difference(rows.where("lang = 'en'"), rows.where("source_id = 'src3'"), "day")


@query(f"""WITH {TITLES}, k AS (SELECT word, count(*) AS n FROM ws GROUP BY 1 ORDER BY n DESC, word LIMIT 10)
SELECT ti.title, min(seq) AS seq, CAST(sum(n) / count(DISTINCT seq) AS BIGINT) AS score FROM ti JOIN k ON contains(lower(ti.title), k.word) GROUP BY ti.title ORDER BY score DESC, title LIMIT 5""")
def summary_samples(spark, sf_dir):
    rows = titles(spark, sf_dir)
    top = F.broadcast(T.keyword_counts(rows).orderBy(F.desc("n"), "word").limit(10))
    first = rows.groupBy("title").agg(F.min("seq").alias("seq"))
    hits = first.join(top, F.lower(first["title"]).contains(top["word"]))
    return hits.groupBy("title", "seq").agg(F.sum("n").alias("score")).select("title", "seq", "score").orderBy(F.desc("score"), "title").limit(5)


@query(f"WITH {TITLES} SELECT day, count(*) AS n, count(DISTINCT source_id) AS sources, count(DISTINCT title) AS titles FROM ti WHERE day BETWEEN DATE '2024-01-08' AND DATE '2024-01-14' GROUP BY 1")
def period_rollup(spark, sf_dir):
    rows = titles(spark, sf_dir).where("day BETWEEN '2024-01-08' AND '2024-01-14'")
    return rows.groupBy("day").agg(F.count("*").alias("n"), F.countDistinct("source_id").alias("sources"), F.countDistinct("title").alias("titles"))


@query("""WITH o AS (SELECT o_orderpriority AS word, count(*) FILTER (o_orderdate < TIMESTAMP '1995-01-01') AS nb, count(*) FILTER (o_orderdate >= TIMESTAMP '1995-01-01') AS nc FROM orders GROUP BY 1)
SELECT word, nb AS n_before, nc AS n_after, nc - nb AS change, CASE WHEN nb > 0 THEN (nc - nb) * 100.0::DOUBLE / nb WHEN nc > 0 THEN 100.0 ELSE 0.0 END AS percent FROM o""")
def order_period_shift(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumnRenamed("o_orderpriority", "word")
    count = lambda x: rows.where(x).groupBy("word").agg(F.count("*").alias("n"))
    return C.shift(count("o_orderdate < '1995-01-01'"), count("o_orderdate >= '1995-01-01'"), "word")
