"""Queries of candidates: identity, display, scores with their gates, and decisions."""

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.functions.text import event_key
from tidemark.operators import adapters as A
from tidemark.operators import candidates as C
from tidemark.operators import scoring, topics
from tidemark.operators.cluster import clustered
from tidemark.operators.run import EVENTS, QUEUE, States, run_once
from tidemark.operators.runs import SOURCES, end_run
from tidemark.plans.scratch import cut, delete, new_path
from tidemark.plans.state_folder import StateFolder
from tidemark.queries.adapters import MARK, SPANS, VISIBLE, folded_and_new
from tidemark.queries.base import TIER, query, tiers, titles
from tidemark.queries.topics import CLUSTERS, CROSS, STRENGTH

ENTRY = "CASE WHEN rank <= 3 THEN 30.0 WHEN rank <= 10 THEN 27.0 WHEN rank <= 20 THEN 23.0 WHEN rank <= 50 THEN 15.0 WHEN rank <= 100 THEN 8.0 ELSE 3.0 END"
BURST = "CASE WHEN rank <= 3 THEN 13.0 WHEN rank <= 10 THEN 12.0 WHEN rank <= 20 THEN 10.0 WHEN rank <= 50 THEN 7.0 WHEN rank <= 100 THEN 4.0 ELSE 2.0 END"
BETTER = "CASE WHEN rank_delta >= 50 AND rank <= 20 THEN 28.0 WHEN rank_delta >= 30 AND rank <= 20 THEN 25.0 WHEN rank_delta >= 20 THEN 21.0 WHEN rank_delta >= 10 THEN 15.0 WHEN rank_delta >= 5 THEN 9.0 ELSE 0.0 END"
#: From items (id, kind, source, tier, rank, best_rank, reliable, ...) to a row for each candidate; the names are those of the columns.
SCORED = f"""g AS (SELECT *,
 CASE WHEN kind <> 'hotlist' OR NOT reliable OR rank IS NULL THEN 0.0 WHEN NOT has_before THEN {ENTRY} * CASE WHEN times_visible <= 1 AND count <= 1 THEN 0.7 ELSE 1.0 END WHEN NOT before_visible THEN {ENTRY}
 WHEN rank_delta > 0 THEN least({BETTER}, CASE WHEN rank > 100 THEN 6.0 WHEN rank > 50 THEN 12.0 ELSE 99.0 END) WHEN rank <= 10 THEN 3.0 WHEN rank <= 20 THEN 2.0 ELSE 0.0 END AS movement,
 CASE WHEN kind <> 'hotlist' OR after_gap OR NOT is_new OR rank IS NULL THEN 0.0 ELSE {BURST} END AS burst,
 CASE WHEN is_new THEN 8.0 ELSE 4.0 END AS recency,
 CASE WHEN kind <> 'hotlist' OR rank IS NULL THEN 0.0 WHEN reliable THEN CASE WHEN times_visible >= 3 AND rank <= 20 THEN 5.0 WHEN times_visible >= 3 AND rank <= 50 THEN 4.0 WHEN times_visible >= 2 AND rank <= 50 THEN 3.0 WHEN times_visible >= 2 AND rank <= 100 THEN 2.0 ELSE 0.0 END
 WHEN count >= 5 THEN 3.0 WHEN count >= 3 THEN 2.0 WHEN count >= 2 THEN 1.0 ELSE 0.0 END AS persistence FROM it),
c AS (SELECT id, CAST(max(movement) AS DOUBLE) AS movement, CAST(max(recency) AS DOUBLE) AS recency, CAST(max(persistence) AS DOUBLE) AS persistence, count(*) AS items, count(DISTINCT source) AS sources,
 CAST(CASE WHEN count(*) = 1 THEN max(burst * CASE WHEN rank > 100 THEN 0.65 WHEN rank > 50 THEN 0.8 ELSE 1.0 END) ELSE max(burst) END AS DOUBLE) AS burst,
 coalesce(min(rank) FILTER (kind = 'hotlist'), min(best_rank) FILTER (kind = 'hotlist')) AS best, bool_or(kind = 'hotlist') AS has_hotlist, bool_or(kind = 'rss') AS has_rss,
 coalesce(bool_or(tier = 'A'), false) AS a, coalesce(bool_or(tier = 'B'), false) AS b, coalesce(bool_or(tier = 'C'), false) AS c, coalesce(bool_or(tier = 'D'), false) AS d FROM g GROUP BY id),
x AS (SELECT *, a OR b OR c OR d AS by_tiers, least(movement + burst + recency + persistence, 60.0::DOUBLE) AS growth,
 CAST(least(CASE WHEN best IS NULL THEN 0 WHEN best <= 3 THEN 30 WHEN best <= 10 THEN 26 WHEN best <= 20 THEN 22 WHEN best <= 50 THEN 16 WHEN best <= 100 THEN 10 ELSE 4 END
  + CASE WHEN sources >= 4 THEN 12 WHEN sources = 3 THEN 8 WHEN sources = 2 THEN 5 ELSE 2 END + CASE WHEN items >= 4 THEN 8 WHEN items = 3 THEN 5 WHEN items = 2 THEN 3 ELSE 1 END, 50) AS DOUBLE) AS heat,
 CASE WHEN a OR b OR c OR d THEN {CROSS} ELSE CAST(CASE WHEN has_hotlist AND has_rss THEN 11 ELSE 1 END + CASE WHEN sources >= 4 THEN 4 WHEN sources = 3 THEN 2 WHEN sources = 2 THEN 1 ELSE 0 END AS DOUBLE) END AS "cross",
 CASE WHEN a OR b OR c OR d THEN {STRENGTH} WHEN (has_hotlist AND has_rss) OR sources >= 3 THEN 'strong' WHEN sources = 2 THEN 'moderate' ELSE 'weak' END AS strength FROM c),
y AS (SELECT *, least(least(growth + heat, 80.0::DOUBLE) * FACTOR * (CASE strength WHEN 'strong' THEN 1.10::DOUBLE WHEN 'moderate' THEN 1.0::DOUBLE ELSE 0.88::DOUBLE END)
 + least(least("cross", 20.0::DOUBLE) * FACTOR * 0.25::DOUBLE, 5.0::DOUBLE), 100.0::DOUBLE) AS score FROM x)"""
LEVEL = "CASE WHEN score >= 80 THEN 'urgent' WHEN score >= 60 THEN 'alert' ELSE 'watch' END AS level"
COLUMNS = ["movement", "burst", "recency", "persistence", "growth", "heat", "cross", "strength", "by_tiers", "score", "level"]
OUT = 'movement, burst, recency, persistence, growth, heat, "cross", strength, by_tiers, score'


@query(f"""{SPANS}, t AS (SELECT source_id, item_id, list(nullif(rank, 0) ORDER BY batch, seq) AS line, list(rank ORDER BY batch, seq) FILTER (rank <> 0) AS ranks FROM h GROUP BY 1, 2),
s AS (SELECT span.source_id, span.item_id, crawl_count, {MARK} AS is_new, list_min(list_filter(ranks, lambda x: {VISIBLE})) AS visible, CASE WHEN span.item_id % 5 = 0 THEN [] ELSE line END AS line
 FROM span JOIN t ON t.source_id = span.source_id AND t.item_id = span.item_id),
p AS (SELECT *, coalesce(visible, 99) AS best_rank, CASE WHEN len(line) > 0 THEN CASE WHEN line[-1] <> 99 THEN line[-1] END ELSE visible END AS rank, len(list_filter(line, lambda x: {VISIBLE})) AS times_visible,
 len(line) > 1 AS has_before, coalesce(len(line) > 1 AND line[-2] <> 99, false) AS before_visible, list_filter(line[:-2], lambda x: {VISIBLE})[-1] AS visible_before FROM s),
it AS (SELECT item_id AS id, 'hotlist' AS kind, 'hotlist:' || source_id AS source, CASE WHEN item_id % 3 = 0 THEN CASE source_id WHEN 'click' THEN 'A' WHEN 'view' THEN 'B' WHEN 'purchase' THEN 'D' END END AS tier, rank, best_rank, len(line) > 0 AS reliable,
  has_before, before_visible, CASE WHEN before_visible THEN visible_before - rank END AS rank_delta, times_visible, crawl_count AS count, is_new, source_id = 'purchase' AND item_id % 2 = 0 AS after_gap FROM p WHERE source_id <> 'error'
 UNION ALL SELECT item_id, 'rss', 'rss:error', NULL, NULL, NULL, false, false, false, NULL, 0, crawl_count, is_new, false FROM p WHERE source_id = 'error'),
{SCORED.replace('FACTOR', '0.85::DOUBLE')} SELECT id AS candidate_id, {OUT}, {LEVEL} FROM y""")
def gated_scores(spark, sf_dir):
    """Users as candidates: errors are feed items, a fifth has no timeline, some sources just came back, few have tiers."""
    rows = A.titles_for_mode(*folded_and_new(spark, sf_dir), "daily").withColumnRenamed("crawl_count", "count")
    rows = rows.withColumn("timeline", F.when(F.col("item_id") % 5 == 0, F.array().cast("array<long>")).otherwise(F.col("timeline")))
    tier = F.when(F.col("item_id") % 3 == 0, F.when(F.col("source_id") == "click", "A").when(F.col("source_id") == "view", "B").when(F.col("source_id") == "purchase", "D"))
    lists = A.list_items(rows.where("source_id <> 'error'")).withColumns({"after_gap": (F.col("source_id") == "purchase") & (F.col("item_id") % 2 == 0), "tier": tier, "feed_id": F.lit(None).cast("string")})
    feeds = rows.where("source_id = 'error'").withColumns({"feed_id": F.col("source_id"), "published_at": F.lit(None).cast("timestamp")})
    feeds = A.feed_items(feeds).withColumns({"after_gap": F.lit(False), "tier": F.lit(None).cast("string")}).drop("published_at")
    items = lists.unionByName(feeds).withColumn("source_name", F.lit(None).cast("string"))
    coverage = scoring.Coverage(configured=5, successful=3, penalise=True)
    return scoring.decided(scoring.candidate_scores(items, "item_id", coverage)).select(F.col("item_id").alias("candidate_id"), *COLUMNS)


def title_items(spark, sf_dir):
    """Titles as items: those of three sources are a feed's, the others a list's with one observation each."""
    rows = titles(spark, sf_dir).withColumns({"url": F.lit(""), "first_time": F.col("day").cast("string"), "last_time": F.col("day").cast("string"), "count": F.lit(1).cast("long"), "is_new": F.col("day") >= "2024-01-21"})
    rows = topics.with_tier(rows.drop("words"), tiers(spark, sf_dir)).withColumns({"feed_id": F.col("source_id"), "source_name": F.upper("source_id"), "keyword_group": F.lit(None).cast("string"), "published_at": F.lit(None).cast("timestamp")})
    is_feed = F.col("source_id").isin("src0", "src1", "src2")
    ranks = {"ranks": F.array("rank"), "timeline": F.array("rank")}
    lists = A.list_items(rows.where(~is_feed).withColumns(ranks)).drop("ranks", "timeline")
    return lists.unionByName(A.feed_items(rows.where(is_feed))).withColumns({"after_gap": F.lit(False), "cross_admitted": F.col("kind") == "rss"})


TITLE_ITEMS = f"""{CLUSTERS}, it AS (SELECT cl.cluster AS id, ti.seq, ti.title, norm, ti.source_id, ti.rank AS place, source_id IN ('src0', 'src1', 'src2') AS feed, CASE WHEN feed THEN 'rss' ELSE 'hotlist' END AS kind, kind || ':' || source_id AS source, {TIER} AS tier,
 CASE WHEN NOT feed THEN ti.rank END AS rank, CASE WHEN NOT feed THEN ti.rank END AS best_rank, NOT feed AS reliable, false AS has_before, false AS before_visible, NULL AS rank_delta, 1 AS times_visible, 1 AS count, day >= DATE '2024-01-21' AS is_new, false AS after_gap
 FROM ti JOIN cl USING (seq) JOIN nt USING (seq)),
id AS (SELECT id, substr(sha1('pr9c:' || string_agg(norm, '||' ORDER BY norm)), 1, 12) AS candidate_id, count(*) AS key_parts FROM (SELECT DISTINCT id, norm FROM it) GROUP BY id),
dp AS (SELECT id, arg_min(title, (feed, coalesce(rank, 0), norm, source_id, title)) AS display_title FROM it GROUP BY id)"""


@query(f"""{TITLE_ITEMS} SELECT candidate_id, key_parts, display_title, count(*) AS items, min(rank) AS best_rank, bool_or(NOT feed) AS has_hotlist, bool_or(feed) AS has_rss, count(DISTINCT source) AS sources
FROM it JOIN id USING (id) JOIN dp USING (id) GROUP BY id, candidate_id, key_parts, display_title""")
def event_candidates(spark, sf_dir):
    """Clusters with their identity, made without a row that holds a cluster."""
    read = ["seq", "title", "url", "kind", "source_id", "feed_id", "source_name", "keyword_group", "rank", "best_rank", "has_count", "count"]
    items = cut(clustered(title_items(spark, sf_dir).select(read)), "items-of-clusters", "zstd")
    kinds = items.withColumn("_source", scoring.source_identity()).groupBy("cluster").agg(
        F.count("*").alias("items"), F.min("rank").alias("best_rank"), F.bool_or(F.col("kind") == "hotlist").alias("has_hotlist"), F.bool_or(F.col("kind") == "rss").alias("has_rss"), F.countDistinct("_source").alias("sources")
    )
    return C.identities(items).join(C.displayed(items), "cluster").join(kinds, "cluster").drop("cluster", "representative_url")


@query(f"""{TITLE_ITEMS}, {SCORED.replace('FACTOR', '1.0::DOUBLE')} SELECT candidate_id, display_title, items, sources, {OUT}, {LEVEL} FROM y JOIN id USING (id) JOIN dp USING (id) WHERE has_hotlist""")
def candidate_pipeline(spark, sf_dir):
    """Titles to decisions in one plan; candidates of feed items alone leave."""
    out = C.decide(title_items(spark, sf_dir), C.Settings(drop_unmerged_feeds=True))
    return out.select("candidate_id", "display_title", "items", "sources", *COLUMNS)


NOW = "2024-01-31 12:00:00"
NUMBER = "CAST(regexp_extract(source_id, '(\\d+)$', 1) AS INT)"
EVENT_KEY = "'event-v1:' || sha256('v1' || chr(31) || lower(trim(regexp_replace({}, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))))"


@query(f"""{TITLE_ITEMS.replace('false AS after_gap', f'{NUMBER} % 5 = 0 AND {NUMBER} % 4 <> 3 AS after_gap, day')}, {SCORED.replace('FACTOR', '1.0::DOUBLE')},
sn AS (SELECT {EVENT_KEY.format('title')} AS event_key, max(TIMESTAMP '{NOW}' - to_hours(CAST(seq % 8 AS INT))) AS seen_at FROM ti WHERE rank <= 10 GROUP BY 1),
fr AS (SELECT id, bool_or(day >= DATE '2024-01-11') AS fresh FROM it GROUP BY id),
de AS (SELECT candidate_id, display_title, score, fresh, {LEVEL}, {EVENT_KEY.format('display_title')} AS event_key FROM y JOIN id USING (id) JOIN dp USING (id) JOIN fr USING (id)),
st AS (SELECT de.*, CASE WHEN seen_at IS NULL THEN 'new' WHEN level = 'alert' THEN 'same_level_repeat' WHEN level = 'urgent' THEN 'meaningful_escalation' ELSE 'deescalation' END AS repeat_status, epoch(TIMESTAMP '{NOW}') - epoch(seen_at) >= 240 * 60 AS over FROM de LEFT JOIN sn USING (event_key)),
ou AS (SELECT *, CASE WHEN level = 'watch' THEN 'not_eligible' WHEN NOT fresh THEN 'not_fresh' WHEN repeat_status = 'same_level_repeat' AND NOT over THEN 'cooldown' WHEN level = 'alert' THEN 'deferred' END AS why FROM st),
pl AS (SELECT *, row_number() OVER (PARTITION BY why ORDER BY score DESC, lower(display_title), candidate_id) AS place FROM ou)
SELECT candidate_id, level, fresh, repeat_status, score, coalesce(why, CASE WHEN place <= 5 THEN 'sent' ELSE 'over_limit' END) AS outcome FROM pl""")
def run_outcomes(spark, sf_dir):
    """A whole run over titles in quiet hours: some sources just came back, some events were sent hours ago; five may be sent."""
    at, n = datetime.fromisoformat(NOW), F.regexp_extract("source_id", r"(\d+)$", 1).cast("int")
    items = title_items(spark, sf_dir).withColumn("observed", F.col("day") >= "2024-01-11")
    names = titles(spark, sf_dir).select("source_id").distinct()
    kind = F.when(F.col("source_id").isin("src0", "src1", "src2"), "rss").otherwise("hotlist").alias("kind")
    root = new_path(spark, "run")
    states = States(*[StateFolder(spark, f"{root}/{k}", s) for k, s in (("events", EVENTS), ("queue", QUEUE), ("sources", SOURCES))])
    end_run(names.select(kind, "source_id", (n % 5 != 0).alias("succeeded")), states.sources, NOW)
    ago = F.lit(at) - F.make_interval(hours=(F.col("seq") % 8).cast("int"))
    seen = titles(spark, sf_dir).where("rank <= 10").groupBy(event_key(F.col("title")).alias("event_key")).agg(F.max(ago).alias("seen_at"))
    states.events.save(seen.select("event_key", F.lit("alert").alias("level"), "seen_at", F.lit(0).cast("long").alias("seq")), NOW)
    run = run_once(items, names.select(kind, "source_id", (n % 4 != 3).alias("succeeded")), states, at, lambda sent: True, quiet=("11:00", "13:00"), most=5)
    delete(spark, [root])
    return run.outcomes.select("candidate_id", "level", "fresh", "repeat_status", "score", "outcome")
