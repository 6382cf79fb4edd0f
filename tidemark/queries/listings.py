"""Queries of listings, gates and counts around reports."""

from pyspark.sql import functions as F

from tidemark.operators import listings as L
from tidemark.queries.base import OBS, TITLES, query, table, tiers, titles
from tidemark.queries.history import observed
from tidemark.queries.topics import EVIDENCE, evidence


@query(f"""WITH {OBS}, r AS (SELECT source_id, CAST(item_id AS VARCHAR) AS title, list(rank ORDER BY seq) FILTER (rank > 20) AS ranks FROM obs GROUP BY 1, 2)
SELECT source_id, title, CASE source_id WHEN 'view' THEN 'view' ELSE upper(source_id) END AS source_name, coalesce(ranks[1], 99) AS rank, '09-30' AS crawl_time, '09-30' AS first_time, '09-30' AS last_time, CAST(1 AS BIGINT) AS count FROM r""")
def crawled_rows(spark, sf_dir):
    rows = observed(spark, sf_dir).groupBy("source_id", F.col("item_id").cast("string").alias("title")).agg(F.array_sort(F.collect_list(F.when(F.col("rank") > 20, F.struct("seq", "rank")))).alias("x"))
    rows = rows.select("source_id", "title", F.transform("x", lambda r: r["rank"]).alias("ranks"), F.lit("").alias("url"), F.lit("").alias("mobile_url"))
    names = observed(spark, sf_dir).select(F.col("source_id").alias("id"), F.upper("source_id").alias("name")).where("id <> 'view'").distinct()
    return L.crawled_rows(rows, names, F.lit("09-30")).drop("ranks", "url", "mobile_url")


@query(f"WITH {TITLES} SELECT seq AS id, title, source_id, CASE WHEN source_id LIKE '%1' THEN source_id ELSE upper(source_id) END AS source_name FROM ti")
def title_ids(spark, sf_dir):
    names = tiers(spark, sf_dir).select("id", F.when(F.col("id").endswith("1"), "").otherwise(F.col("name")).alias("name"))
    return L.named_ids(titles(spark, sf_dir).withColumnRenamed("seq", "id"), names)


@query("SELECT strftime(ts, '%H-%M') || '.db' AS name, CASE WHEN event_id % 4 = 3 THEN 1704067200 ELSE CAST(epoch(date_trunc('second', ts)) AS BIGINT) END AS epoch FROM events")
def crawl_epochs(spark, sf_dir):
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    created = F.when(F.col("event_id") % 8 == 3, "soon").when(F.col("event_id") % 8 == 7, F.lit(None)).otherwise(stamp)
    rows = table(spark, sf_dir, "events").select(F.date_format("ts", "HH-mm").alias("crawl_time"), created.alias("created_at"))
    return L.crawl_epochs(rows, F.lit("2024-01-01").cast("timestamp"))


STRIP = lambda x: f"regexp_replace({x}, '^[\\s\\x0B\\x{{85}}\\p{{Z}}]+|[\\s\\x0B\\x{{85}}\\p{{Z}}]+$', '', 'g')"


@query(f"SELECT doc_id, source || ':' || md5(array_to_string(list_filter(list_transform(string_split_regex(coalesce(text, ''), '\\r\\n|[\\n\\r\\x0B\\f\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: {STRIP('x')}), lambda x: x <> '' AND x NOT LIKE '#%'), chr(10))) AS hash FROM documents")
def interests_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", L.interests_hash(F.col("text"), F.col("source")).alias("hash"))


WITHOUT = lambda pattern: STRIP(f"regexp_replace(coalesce(html, ''), '{pattern}', '', 'gi')")
LINK, BARE_LINK = "https?://\\S+", "https?://[^\\s<>\"'']+"


@query(f"WITH p AS (SELECT page_id, {WITHOUT(BARE_LINK)} AS public, {WITHOUT(LINK)} AS bare FROM pages) SELECT page_id, public, CASE WHEN length(bare) <= 160 THEN bare ELSE {STRIP('substr(bare, 1, 160)')} || '...' END AS short FROM p")
def public_texts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", L.public_text(F.col("html")).alias("public"), L.shortened(F.col("html"), 160).alias("short"))


@query(f"""WITH {TITLES}, k AS (SELECT source_id AS topic, seq, {STRIP('title')} AS title, 'http://h/' || seq AS url FROM ti WHERE seq % 5 <> 0 AND NOT contains(title, 'the')),
r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY seq) AS place FROM k WHERE title <> '') SELECT topic, seq, title, url, place FROM r WHERE place <= 5""")
def source_links(spark, sf_dir):
    url = F.when(F.col("seq") % 5 == 0, " ").otherwise(F.concat(F.lit(" http://h/"), F.col("seq").cast("string")))
    rows = titles(spark, sf_dir).select(F.col("source_id").alias("topic"), "seq", "title", url.alias("url"))
    return L.source_links(rows, F.col("title").contains("the")).withColumn("place", F.col("place").cast("long"))


@query(f"""{EVIDENCE}, v AS (SELECT coalesce(label, 'background') AS section, topic LIKE 's%' AS turned FROM e), w AS (SELECT CASE WHEN turned THEN 'silence_gap' ELSE section END AS s FROM v)
SELECT count(*) AS anomaly, count(*) FILTER (s = 'cross_layer_verified') AS cross_layer, count(*) FILTER (s = 'high_heat_unverified') AS high_heat, count(*) FILTER (s = 'chinese_only_hot') AS chinese_only, count(*) FILTER (s = 'silence_gap') AS silence_gap, CAST(7 AS BIGINT) AS suppressed FROM w""")
def radar_recount(spark, sf_dir):
    rows = evidence(spark, sf_dir).select(F.coalesce("label", F.lit("background")).alias("section"), F.when(F.col("topic").startswith("s"), "社交端响应偏弱").alias("status"))
    return L.radar(rows, F.lit(7).cast("long"))


@query("""WITH r AS (SELECT event_id AS run_id, CAST(ts AS DATE) AS day, CASE WHEN user_id % 4 = 0 THEN NULL ELSE event_type END AS period, user_id % 3 > 0 AS once, value > 10 AS analyzed FROM events),
x AS (SELECT DISTINCT day, period FROM r WHERE run_id % 50 = 0 AND period IS NOT NULL)
SELECT run_id, day, period, once, analyzed FROM r WHERE NOT (coalesce(once, false) AND coalesce(period, '') <> '') OR (coalesce(analyzed, false) AND NOT EXISTS (SELECT 1 FROM x WHERE x.day = r.day AND x.period = r.period))""")
def scheduled_sends(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("run_id"), F.col("ts").cast("date").alias("day"), F.when(F.col("user_id") % 4 != 0, F.col("event_type")).alias("period"), (F.col("user_id") % 3 > 0).alias("once"), (F.col("value") > 10).alias("analyzed")
    )
    return L.may_send(rows, rows.where("run_id % 50 = 0"))


@query("""WITH p AS (SELECT CAST(ts AS DATE) AS day, event_type AS kind, count(*) AS rows, CAST(sum(length(props)) AS BIGINT) AS bytes FROM events GROUP BY 1, 2)
SELECT count(DISTINCT day) AS days, min(day) AS first_day, max(day) AS last_day, CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(bytes) AS BIGINT) AS bytes, date_diff('day', min(day), max(day)) + 1 - count(DISTINCT day) AS missing_days FROM p""")
def storage_status(spark, sf_dir):
    parts = table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("day"), F.col("event_type").alias("kind")).agg(F.count("*").alias("rows"), F.sum(F.length("props")).alias("bytes"))
    return L.storage_status(parts).withColumn("missing_days", F.col("missing_days").cast("long"))


