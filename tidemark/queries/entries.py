"""Queries of feed entries: the kind of event is the feed, the user the guid or link, the day the batch."""

from pyspark.sql import functions as F

from tidemark.operators import entries as E
from tidemark.plans.rules import parse_rules
from tidemark.queries.base import query, table

#: Columns of entries in SQL of both engines.
COLUMNS = {
    "seq": "event_id",
    "feed_id": "event_type",
    "guid": "CASE WHEN event_id % 3 = 0 THEN concat('g', user_id) ELSE '' END",
    "url": "concat('http://x/', user_id)",
    "title": "CASE WHEN event_id % 5 = 0 THEN 'https://t' ELSE props END",
    "published_at": "ts",
    "batch": "CAST(date_trunc('day', ts) AS TIMESTAMP)",
}
EN = "en AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in COLUMNS.items()) + " FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL)"
OLD, NEW = "TIMESTAMP '2024-01-20'", "TIMESTAMP '2024-01-21'"
STATE = f"""{EN}, st AS (SELECT feed_id, url, coalesce(max(guid) FILTER (guid <> ''), '') AS guid, coalesce(arg_max(title, (batch, seq)) FILTER (title NOT LIKE 'http%'), max(title)) AS title,
 arg_max(published_at, (batch >= {OLD}, seq)) AS published_at, min(batch) AS first_batch, max(batch) AS last_batch, count(*) AS crawl_count FROM en WHERE batch < {NEW} GROUP BY 1, 2)"""
RULES = parse_rules('[Sevens]\n/"k": 7/\n\n[Rest]\n+k\n1\n2\n\n!99')


def feed_entries(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("user_id IS NOT NULL AND event_type IS NOT NULL")
    return rows.selectExpr(*[f"{e} AS {c}" for c, e in COLUMNS.items()], "'' AS summary", "'' AS author")


def no_state(spark):
    return spark.createDataFrame([], "entry_id string, feed_id string, guid string, url string, title string, summary string, author string, published_at timestamp, first_batch timestamp, last_batch timestamp, crawl_count long")


def state_by_days(spark, sf_dir):
    """The state after a batch of all days before the 20th, and then one of the 20th."""
    rows = feed_entries(spark, sf_dir)
    return E.upserted_entries(E.upserted_entries(no_state(spark), rows.where("batch < '2024-01-20'")), rows.where("batch = '2024-01-20'"))


@query(f"WITH {STATE} SELECT * FROM st")
def feed_upsert(spark, sf_dir):
    return state_by_days(spark, sf_dir).drop("entry_id", "summary", "author")


@query(f"WITH {STATE} SELECT feed_id, upper(feed_id) AS feed_name, url, title, published_at FROM st")
def feed_day(spark, sf_dir):
    state = state_by_days(spark, sf_dir)
    return E.day_entries(state, state.select("feed_id", F.upper("feed_id").alias("name")).distinct()).select("feed_id", "feed_name", "url", "title", "published_at")


@query(f"WITH {STATE} SELECT feed_id, url, crawl_count FROM st WHERE last_batch = (SELECT max(batch) FROM en WHERE batch < {NEW})")
def feed_latest_batch(spark, sf_dir):
    batches = feed_entries(spark, sf_dir).where("batch < '2024-01-21'").select("batch").distinct()
    return E.latest_entries(state_by_days(spark, sf_dir), batches).select("feed_id", "url", "crawl_count")


@query(f"WITH {EN} SELECT seq, feed_id, url FROM en e WHERE batch = TIMESTAMP '2024-01-03' AND NOT EXISTS (SELECT 1 FROM en o WHERE o.feed_id = e.feed_id AND o.url = e.url AND o.batch < TIMESTAMP '2024-01-03')")
def feed_new_entries(spark, sf_dir):
    rows = feed_entries(spark, sf_dir)
    state = E.upserted_entries(no_state(spark), rows.where("batch < '2024-01-03'"))
    return E.new_entries(rows.where("batch = '2024-01-03'"), state, F.lit("2024-01-03").cast("timestamp")).select("seq", "feed_id", "url")


PLACED = f"""WITH {EN}, b AS (SELECT * REPLACE (CASE WHEN seq % 7 = 0 THEN '' ELSE concat(url, '/', seq % 5) END AS url) FROM en), p AS (SELECT *, row_number() OVER (ORDER BY published_at DESC, seq) AS place FROM b),
u AS (SELECT url, min(seq) AS seq, max(place) AS position FROM p WHERE url <> '' GROUP BY 1),
f AS (SELECT p.seq, p.title, p.url, u.position FROM p JOIN u USING (url, seq) UNION ALL SELECT seq, title, url, 99 FROM p WHERE url = ''),
g AS (SELECT *, {RULES.first_group_sql('title')} AS group_no FROM f), k AS (SELECT seq, group_no, position, url IN (SELECT url FROM b WHERE batch = {OLD} AND url <> '') AS is_new FROM g WHERE group_no IS NOT NULL)"""


def entries_by_rules(spark, sf_dir):
    link = F.when(F.col("seq") % 7 == 0, "").otherwise(F.concat_ws("/", "url", (F.col("seq") % 5).cast("string")))
    rows = feed_entries(spark, sf_dir).withColumn("url", link)
    return E.frequencies(rows, RULES, rows.where("batch = '2024-01-20'"))


@query(f"{PLACED} SELECT * FROM k")
def feed_keyword_entries(spark, sf_dir):
    return entries_by_rules(spark, sf_dir)[0].select("seq", "group_no", "position", "is_new")


@query(f"{PLACED} SELECT group_no, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM b), 2) AS percentage FROM k GROUP BY 1")
def feed_keyword_counts(spark, sf_dir):
    return entries_by_rules(spark, sf_dir)[1]


@query(f"""WITH {EN}, k AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY batch DESC, seq) AS k FROM en WHERE batch > TIMESTAMP '2024-01-15' AND batch <= {OLD})
SELECT feed_id, url, title, batch, published_at FROM k WHERE k = 1""")
def feed_latest_days(spark, sf_dir):
    rows = feed_entries(spark, sf_dir)
    return E.last_days(rows, F.lit("2024-01-20").cast("timestamp"), 5).select("feed_id", "url", "title", "batch", "published_at")


@query(f"""WITH {EN}
SELECT seq FROM en WHERE CASE feed_id WHEN 'error' THEN true WHEN 'click' THEN epoch(TIMESTAMP '2024-01-25') - epoch(date_trunc('second', published_at)) <= 2 * 86400 ELSE epoch(TIMESTAMP '2024-01-25') - epoch(date_trunc('second', published_at)) <= 5 * 86400 END""")
def feed_freshness(spark, sf_dir):
    limits = spark.createDataFrame([("click", 2), ("error", 0)], "feed_id string, max_days int")
    return E.fresh_entries(feed_entries(spark, sf_dir), limits, F.lit("2024-01-25").cast("timestamp"), 5).select("seq")
