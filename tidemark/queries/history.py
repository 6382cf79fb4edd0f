"""Queries over rank histories."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import ranks as R
from tidemark.functions import scores
from tidemark.operators import history as H
from tidemark.queries.base import EVENTS, OBS, OFF, events, query


def observed(spark, sf_dir):
    return H.one_rank_each(events(spark, sf_dir))


def full_history(spark, sf_dir):
    obs = observed(spark, sf_dir)
    return obs.unionByName(H.off_list(obs))


FOLD = f"""WITH {OBS}, {OFF},
span AS (SELECT source_id, item_id, min(batch) FILTER (rank <> 0) AS first_time, max(batch) FILTER (rank <> 0) AS last_time, count(*) FILTER (rank <> 0) AS crawl_count FROM hist GROUP BY 1, 2),
h AS (SELECT hist.*, first_time, last_time, crawl_count FROM hist JOIN span USING (source_id, item_id) WHERE rank <> 0 OR batch <= last_time),
f AS (SELECT source_id, item_id, rank, min((batch, seq)) AS first_at FROM h WHERE rank <> 0 GROUP BY 1, 2, 3)"""


@query(f"""{FOLD}
SELECT h.source_id, h.item_id, any_value(first_time) AS first_time, any_value(last_time) AS last_time, any_value(crawl_count) AS crawl_count,
  (SELECT string_agg(CAST(rank AS VARCHAR), ',' ORDER BY first_at) FROM f WHERE f.source_id = h.source_id AND f.item_id = h.item_id) AS ranks,
  string_agg(CASE WHEN rank = 0 THEN '-' ELSE CAST(rank AS VARCHAR) END, ',' ORDER BY batch, seq) AS timeline
FROM h GROUP BY h.source_id, h.item_id""")
def rank_fold(spark, sf_dir):
    folded = H.fold_ranks(full_history(spark, sf_dir))
    text = lambda c: F.array_join(F.transform(c, lambda r: F.coalesce(r.cast("string"), F.lit("-"))), ",")
    return folded.withColumn("ranks", text("ranks")).withColumn("timeline", text("timeline"))


@query(f"""{FOLD},
r AS (SELECT source_id, item_id, list(rank ORDER BY first_at) AS ranks FROM f GROUP BY 1, 2),
w AS (SELECT r.source_id, r.item_id, crawl_count, list_min(ranks) AS best,
  6.0 * list_sum(list_transform(ranks, lambda x: 11 - least(x, 10))) / len(ranks) + 3.0 * least(crawl_count, 10) + 10.0 * len(list_filter(ranks, lambda x: x <= 5)) / len(ranks) AS weight
  FROM r JOIN span USING (source_id, item_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY weight DESC, best, crawl_count DESC, item_id) AS place FROM w)
SELECT source_id, item_id, weight, best, crawl_count, place FROM k WHERE place <= 10""")
def news_weight_topk(spark, sf_dir):
    folded = H.fold_ranks(full_history(spark, sf_dir))
    rows = folded.select("source_id", "item_id", R.news_weight(F.col("ranks"), F.col("crawl_count")).alias("weight"), R.best_rank(F.col("ranks")).alias("best"), "crawl_count")
    place = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("weight"), "best", F.desc("crawl_count"), "item_id"))
    return rows.withColumn("place", place.cast("long")).where("place <= 10")


@query(f"""WITH {OBS}, {OFF} SELECT source_id, item_id, string_agg(CAST(rank AS VARCHAR), ',' ORDER BY batch, seq) AS ranks, count(*) AS n FROM hist GROUP BY 1, 2""")
def snapshot_ranks(spark, sf_dir):
    rows = H.snapshot_ranks(full_history(spark, sf_dir))
    return rows.select("source_id", "item_id", F.array_join("ranks", ",").alias("ranks"), F.size("ranks").cast("long").alias("n"))


@query(f"WITH {OBS} SELECT * FROM obs WHERE batch = (SELECT max(batch) FROM obs)")
def latest_batch(spark, sf_dir):
    return H.latest_batch(observed(spark, sf_dir))


def _since(days: int) -> str:
    """SQL of the observations of the first days, and of what the last of them brought."""
    return f"""WITH {OBS}, first AS (SELECT * FROM obs WHERE batch < (SELECT min(batch) FROM obs) + INTERVAL {days} DAY), n AS (SELECT max(batch) AS m FROM first)
SELECT source_id, item_id, batch, rank FROM first, n WHERE batch = m AND NOT EXISTS (SELECT 1 FROM first o WHERE o.batch < m AND o.source_id = first.source_id AND o.item_id = first.item_id)"""


def first_days(spark, sf_dir, days):
    rows = observed(spark, sf_dir)
    start = rows.agg(F.min("batch").alias("start"))
    return rows.join(start, F.col("batch") < F.col("start") + F.make_interval(days=F.lit(days))).drop("start")


@query(f"""WITH {OBS}, n AS (SELECT max(batch) AS m FROM obs)
SELECT source_id, item_id, batch, rank FROM obs, n WHERE batch = m AND NOT EXISTS (SELECT 1 FROM obs o WHERE o.batch < m AND o.source_id = obs.source_id AND o.item_id = obs.item_id)""")
def new_items(spark, sf_dir):
    return H.new_items(observed(spark, sf_dir))


@query(_since(2))
def new_items_without_history(spark, sf_dir):
    """Where there is no earlier day none would be new; here there is one."""
    return H.new_items(first_days(spark, sf_dir, 2), "none")


@query(f"WITH {OBS}, {OFF} SELECT source_id, item_id, batch, CAST(0 AS BIGINT) AS rank FROM gone")
def off_list_items(spark, sf_dir):
    return H.off_list(observed(spark, sf_dir)).drop("seq")


@query(f"SELECT DISTINCT batch, strftime(batch, '%m-%d') AS shown FROM (WITH {OBS} SELECT batch FROM obs)")
def crawl_times(spark, sf_dir):
    return observed(spark, sf_dir).select("batch").distinct().withColumn("shown", F.date_format("batch", "MM-dd"))


@query("SELECT CAST(date_trunc('day', ts) AS DATE) AS day, count(DISTINCT date_trunc('hour', ts)) AS batches, count(DISTINCT date_trunc('hour', ts)) <= 1 AS first_crawl FROM events GROUP BY 1")
def first_crawl_of_day(spark, sf_dir):
    from tidemark.queries.base import table

    rows = table(spark, sf_dir, "events").withColumn("batch", F.date_trunc("hour", "ts"))
    return H.first_of_day(rows, F.to_date("ts"))


@query(f"""WITH {EVENTS} SELECT source_id, item_id, array_to_string(list_sort(list(DISTINCT rank)), ',') AS ranks, min(batch) AS first_time, max(batch) AS last_time,
count(DISTINCT batch) AS crawl_count, arg_min(title, seq) FILTER (title <> '') AS url FROM ev GROUP BY 1, 2""")
def merge_batches(spark, sf_dir):
    rows = H.merged_batches(events(spark, sf_dir).withColumnRenamed("title", "url"))
    return rows.withColumn("ranks", F.array_join("ranks", ","))


@query(f"""WITH {EVENTS}, m AS (SELECT max(batch) AS last FROM ev),
s AS (SELECT source_id, item_id, arg_max(title, seq) AS title, min(batch) AS first_time, max(batch) AS last_time, count(DISTINCT batch) AS crawl_count FROM ev, m WHERE batch < last GROUP BY 1, 2),
b AS (SELECT source_id, item_id, arg_max(title, seq) AS new_title, min(batch) AS nf, max(batch) AS nl, count(*) AS nc FROM ev, m WHERE batch = last GROUP BY 1, 2)
SELECT coalesce(s.source_id, b.source_id) AS source_id, coalesce(s.item_id, b.item_id) AS item_id, coalesce(new_title, title) AS title, coalesce(first_time, nf) AS first_time,
coalesce(nl, last_time) AS last_time, coalesce(crawl_count, 0) + coalesce(nc, 0) AS crawl_count
FROM s FULL JOIN b ON s.source_id = b.source_id AND s.item_id = b.item_id""")
def upsert_batch(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("url", F.lit(""))
    last = F.broadcast(rows.agg(F.max("batch").alias("last")))
    rows = rows.join(last)
    before = rows.where("batch < last").groupBy(*H.ITEM).agg(
        F.max_by("title", "seq").alias("title"), F.lit("").alias("url"), F.min("batch").alias("first_time"), F.max("batch").alias("last_time"), F.countDistinct("batch").alias("crawl_count")
    )
    return H.upserted(before, rows.where("batch = last")).drop("url")


@query(f"""WITH {EVENTS}, l AS (SELECT *, lag(title) OVER (PARTITION BY source_id, item_id ORDER BY batch, seq) AS old_title FROM ev)
SELECT source_id, item_id, batch, seq, old_title, title AS new_title FROM l WHERE old_title <> title""")
def title_changes(spark, sf_dir):
    return H.title_changes(events(spark, sf_dir))


LAG = f"""WITH {OBS}, {OFF}, p AS (SELECT *, rank > 0 AND rank <> 99 AS visible,
 lag(rank) OVER w AS row_before,
 last_value(CASE WHEN rank > 0 AND rank <> 99 THEN rank END IGNORE NULLS) OVER (PARTITION BY source_id, item_id ORDER BY batch, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS visible_before,
 count(CASE WHEN rank > 0 AND rank <> 99 THEN 1 END) OVER (PARTITION BY source_id, item_id ORDER BY batch, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS times_visible
 FROM hist WINDOW w AS (PARTITION BY source_id, item_id ORDER BY batch, seq))"""


@query(f"{LAG} SELECT source_id, item_id, batch, rank, visible, row_before, visible_before, times_visible, CASE WHEN row_before > 0 AND row_before <> 99 THEN row_before - rank END AS delta FROM p")
def previous_observation(spark, sf_dir):
    return H.with_previous(full_history(spark, sf_dir)).drop("seq")


ENTRY = "CASE WHEN rank <= 3 THEN 30.0 WHEN rank <= 10 THEN 27.0 WHEN rank <= 20 THEN 23.0 WHEN rank <= 50 THEN 15.0 WHEN rank <= 100 THEN 8.0 ELSE 3.0 END"


@query(f"""{LAG}, d AS (SELECT *, row_before - rank AS delta FROM p WHERE visible)
SELECT source_id, item_id, batch, CAST(CASE WHEN row_before IS NULL THEN CASE WHEN times_visible <= 1 THEN {ENTRY} * 0.7 ELSE {ENTRY} END
 WHEN NOT (row_before > 0 AND row_before <> 99) THEN {ENTRY}
 WHEN delta > 0 THEN least(CASE WHEN delta >= 50 AND rank <= 20 THEN 28.0 WHEN delta >= 30 AND rank <= 20 THEN 25.0 WHEN delta >= 20 THEN 21.0 WHEN delta >= 10 THEN 15.0 WHEN delta >= 5 THEN 9.0 ELSE 0.0 END,
   CASE WHEN rank > 100 THEN 6.0 WHEN rank > 50 THEN 12.0 ELSE 99.0 END)
 WHEN rank <= 10 THEN 3.0 WHEN rank <= 20 THEN 2.0 ELSE 0.0 END AS DOUBLE) AS movement FROM d""")
def score_rank_movement(spark, sf_dir):
    rows = H.with_previous(full_history(spark, sf_dir)).where("visible")
    before = F.col("row_before")
    value = scores.movement(F.col("rank"), before, before.isNotNull(), F.coalesce((before > 0) & (before != 99), F.lit(False)), F.col("times_visible"), F.col("times_visible"), F.lit(True))
    return rows.select("source_id", "item_id", "batch", value.alias("movement"))


@query(f"""{LAG} SELECT source_id, item_id, batch, CAST(CASE WHEN times_visible >= 3 AND rank <= 20 THEN 5 WHEN times_visible >= 3 AND rank <= 50 THEN 4 WHEN times_visible >= 2 AND rank <= 50 THEN 3
 WHEN times_visible >= 2 AND rank <= 100 THEN 2 WHEN times_visible >= 5 THEN 3 WHEN times_visible >= 3 THEN 2 WHEN times_visible >= 2 THEN 1 ELSE 0 END AS DOUBLE) AS persistence FROM p WHERE visible""")
def score_persistence(spark, sf_dir):
    rows = H.with_previous(full_history(spark, sf_dir)).where("visible")
    return rows.select("source_id", "item_id", "batch", scores.persistence(F.col("times_visible"), F.col("rank"), F.col("times_visible")).alias("persistence"))


@query(f"""WITH {OBS}, {OFF} SELECT source_id, item_id, batch, CASE WHEN rank = 0 THEN 'off_list' WHEN rank = 99 THEN 'no_rank' ELSE 'visible' END AS kind FROM hist""")
def rank_kinds(spark, sf_dir):
    return full_history(spark, sf_dir).select("source_id", "item_id", "batch", R.rank_kind(F.col("rank")).alias("kind"))


@query(f"""{FOLD}, r AS (SELECT source_id, item_id, list(rank ORDER BY first_at) AS ranks FROM f GROUP BY 1, 2)
SELECT source_id, item_id, CASE WHEN len(ranks) < 2 THEN '稳定' WHEN ranks[1] - ranks[-1] >= 3 THEN '升温' WHEN ranks[1] - ranks[-1] <= -3 THEN '降温' ELSE '稳定' END AS trend FROM r""")
def rank_trend(spark, sf_dir):
    return H.fold_ranks(full_history(spark, sf_dir)).select("source_id", "item_id", R.rank_trend(F.col("ranks")).alias("trend"))


@query(f"""WITH {OBS} SELECT item_id, count(DISTINCT source_id) AS sources, count(*) AS items, min(rank) AS best,
CAST(least(CASE WHEN min(rank) <= 3 THEN 30 WHEN min(rank) <= 10 THEN 26 WHEN min(rank) <= 20 THEN 22 WHEN min(rank) <= 50 THEN 16 WHEN min(rank) <= 100 THEN 10 ELSE 4 END
 + CASE WHEN count(DISTINCT source_id) >= 4 THEN 12 WHEN count(DISTINCT source_id) = 3 THEN 8 WHEN count(DISTINCT source_id) = 2 THEN 5 ELSE 2 END
 + CASE WHEN count(*) >= 4 THEN 8 WHEN count(*) = 3 THEN 5 WHEN count(*) = 2 THEN 3 ELSE 1 END, 50) AS DOUBLE) AS heat FROM obs GROUP BY 1""")
def score_current_heat(spark, sf_dir):
    rows = observed(spark, sf_dir).groupBy("item_id").agg(F.countDistinct("source_id").alias("sources"), F.count("*").alias("items"), F.min("rank").alias("best"))
    return rows.withColumn("heat", scores.heat(F.col("best"), F.col("sources"), F.col("items")))
