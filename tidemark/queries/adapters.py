"""Queries of run modes, items to score, and titles merged over days."""

from pyspark.sql import functions as F

from tidemark.operators import adapters as A
from tidemark.operators import history as H
from tidemark.operators import search as S
from tidemark.queries.base import TITLES, query, titles
from tidemark.queries.history import FOLD, full_history, observed

NEWS = "nw AS (SELECT DISTINCT source_id, item_id FROM obs WHERE batch >= TIMESTAMP '2024-01-29')"
SPANS = f"{FOLD}, {NEWS}"
MARK = "EXISTS (SELECT 1 FROM nw WHERE nw.source_id = span.source_id AND nw.item_id = span.item_id)"


def folded_and_new(spark, sf_dir):
    new = observed(spark, sf_dir).where("batch >= '2024-01-29'")
    return H.fold_ranks(full_history(spark, sf_dir)), new


def titles_of_mode(spark, sf_dir, mode, first_crawl=False):
    return A.titles_for_mode(*folded_and_new(spark, sf_dir), mode, first_crawl).select("source_id", "item_id", "crawl_count", "is_new")


@query(f"{SPANS} SELECT source_id, item_id, crawl_count, {MARK} AS is_new FROM span WHERE last_time IS NOT NULL")
def mode_daily(spark, sf_dir):
    return titles_of_mode(spark, sf_dir, "daily")


@query(f"{SPANS} SELECT source_id, item_id, crawl_count, {MARK} AS is_new FROM span WHERE last_time = (SELECT max(last_time) FROM span)")
def mode_current(spark, sf_dir):
    return titles_of_mode(spark, sf_dir, "current")


@query(f"{SPANS} SELECT source_id, item_id, crawl_count, true AS is_new FROM span WHERE last_time IS NOT NULL AND {MARK}")
def mode_incremental(spark, sf_dir):
    return titles_of_mode(spark, sf_dir, "incremental")


@query(f"{SPANS} SELECT source_id, item_id, crawl_count, true AS is_new FROM span WHERE last_time IS NOT NULL")
def mode_incremental_first_crawl(spark, sf_dir):
    return titles_of_mode(spark, sf_dir, "incremental", True)


VISIBLE = "x > 0 AND x <> 99"


@query(f"""{SPANS}, t AS (SELECT source_id, item_id, list(nullif(rank, 0) ORDER BY batch, seq) AS line FROM h GROUP BY 1, 2),
s AS (SELECT span.source_id, span.item_id, crawl_count, first_time, last_time, line, {MARK} AS is_new, list_min(list_filter(line, lambda x: {VISIBLE})) AS best,
 CASE WHEN line[-1] <> 99 THEN line[-1] END AS rank FROM span JOIN t ON t.source_id = span.source_id AND t.item_id = span.item_id),
p AS (SELECT *, len(line) > 1 AS has_before, coalesce(len(line) > 1 AND line[-2] <> 99, false) AS before_visible, list_filter(line[:-2], lambda x: {VISIBLE})[-1] AS visible_before FROM s)
SELECT source_id, item_id, coalesce(best, 99) AS best_rank, CASE WHEN best IS NULL THEN 'no_rank' ELSE 'visible' END AS kind_of_rank, rank, len(list_filter(line, lambda x: {VISIBLE})) AS times_visible,
 has_before, before_visible, visible_before, CASE WHEN before_visible THEN visible_before - rank END AS rank_delta, true AS reliable, true AS has_times, false AS times_made_up, true AS has_count, 'crawl_count' AS count_meaning,
 CASE WHEN is_new THEN 'new_titles_detection' ELSE 'unknown' END AS new_meaning FROM p""")
def list_items(spark, sf_dir):
    rows = A.titles_for_mode(*folded_and_new(spark, sf_dir), "daily").withColumnRenamed("crawl_count", "count")
    return A.list_items(rows).drop("ranks", "timeline", "first_time", "last_time", "count", "is_new", "kind")


@query(f"""WITH {TITLES}, m AS (SELECT source_id, title, count(*) AS n, min(rank) AS best, min((day, seq)) AS first,
 6.0::DOUBLE * sum(11 - least(rank, 10)) / count(*) + 3.0::DOUBLE * least(count(*), 10) + 10.0::DOUBLE * count(*) FILTER (rank <= 5) / count(*) AS weight FROM ti
 WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND contains(lower(title), 'the') GROUP BY 1, 2)
SELECT source_id, title, n, best, weight FROM m ORDER BY weight DESC, first, source_id, title LIMIT 50""")
def sentiment_titles(spark, sf_dir):
    rows = titles(spark, sf_dir).where("day BETWEEN '2024-01-05' AND '2024-01-20'")
    return S.merged_over_days(rows, "the", 50).drop("first")


@query()
def related_history(spark, sf_dir):
    rows, _ = S.related_in_days(titles(spark, sf_dir), "The and attion to thanedble the, anea.", "2024-01-05", "2024-01-20", 0.2)
    return rows.select("seq", "score", "overlap", "ratio", "day", "rank")
