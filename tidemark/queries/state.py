"""Queries of keyed state, ledgers and health."""

from pyspark.sql import functions as F

from tidemark.functions import scores as S
from tidemark.operators import state as K
from tidemark.plans.scratch import cut, delete, new_path
from tidemark.queries.base import query, table
from tidemark.streaming.ledger import Ledger

LEVEL = "CASE event_type WHEN 'purchase' THEN 'urgent' WHEN 'signup' THEN 'alert' WHEN 'error' THEN 'suppress' ELSE 'watch' END"
NO = "CASE level WHEN 'suppress' THEN 0 WHEN 'watch' THEN 1 WHEN 'alert' THEN 2 ELSE 3 END"
UPDATES = f"u AS (SELECT CAST(user_id AS VARCHAR) AS event_key, {LEVEL} AS level, ts AS seen_at, event_id AS seq FROM events)"
STATE = f"""st AS (SELECT event_key, level, seen_at, seq FROM (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY {NO} DESC, seen_at DESC, seq DESC) AS k FROM u WHERE seen_at < TIMESTAMP '2024-01-15') WHERE k = 1),
nw AS (SELECT event_key, level, seen_at, seq FROM (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY {NO} DESC, seen_at DESC, seq DESC) AS k FROM u WHERE seen_at >= TIMESTAMP '2024-01-15' AND seen_at < TIMESTAMP '2024-01-16') WHERE k = 1)"""


def updates(spark, sf_dir):
    kind = F.col("event_type")
    level = F.when(kind == "purchase", "urgent").when(kind == "signup", "alert").when(kind == "error", "suppress").otherwise("watch")
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("event_key"), level.alias("level"), F.col("ts").alias("seen_at"), F.col("event_id").alias("seq"))


def before_and_after(spark, sf_dir):
    rows = updates(spark, sf_dir)
    return rows.where("seen_at < '2024-01-15'"), rows.where("seen_at >= '2024-01-15' AND seen_at < '2024-01-16'")


@query(f"WITH {UPDATES}, {STATE} SELECT * FROM nw UNION ALL SELECT * FROM st WHERE event_key NOT IN (SELECT event_key FROM nw)")
def state_merge(spark, sf_dir):
    before, after = before_and_after(spark, sf_dir)
    return K.merged_state(K.highest_of_each(before), after)


@query(f"""WITH {UPDATES}, {STATE}, j AS (SELECT nw.event_key, nw.level, st.level AS seen_level, date_diff('second', st.seen_at, TIMESTAMP '2024-01-15 02:00:00') / 60.0 AS age FROM nw LEFT JOIN st USING (event_key)),
r AS (SELECT *, CASE WHEN seen_level IS NULL THEN 'new' WHEN seen_level = level THEN 'same_level_repeat' WHEN ({NO}) > ({NO.replace('level', 'seen_level')}) THEN 'meaningful_escalation' ELSE 'deescalation' END AS repeat_status FROM j),
a AS (SELECT *, CASE WHEN repeat_status = 'new' THEN 'allow_new' WHEN repeat_status = 'meaningful_escalation' THEN 'allow_escalation' WHEN age >= 240 THEN 'allow_new' ELSE 'cooldown' END AS action FROM r)
SELECT event_key, level, seen_level, repeat_status, action, action LIKE 'allow%' AND level IN ('alert', 'urgent') AS dispatch FROM a""")
def cooldown_action(spark, sf_dir):
    before, after = before_and_after(spark, sf_dir)
    now = F.lit("2024-01-15 02:00:00").cast("timestamp")
    return K.cooldowns(K.highest_of_each(after), K.highest_of_each(before), now).select("event_key", "level", "seen_level", "repeat_status", "action", "dispatch")


@query(f"WITH {UPDATES}, {STATE} SELECT event_key, CASE WHEN seen_at > TIMESTAMP '2024-01-12' THEN 'future_seen_at' WHEN date_diff('second', seen_at, TIMESTAMP '2024-01-12') > 7 * 86400 THEN 'evictable' ELSE 'active' END AS phase FROM st")
def lifecycle_phases(spark, sf_dir):
    state = K.highest_of_each(before_and_after(spark, sf_dir)[0]).withColumn("seen_text", F.date_format("seen_at", "yyyy-MM-dd HH:mm:ss"))
    return K.phases(state, F.lit("2024-01-12").cast("timestamp")).select("event_key", "phase")


@query(f"""WITH {UPDATES}, {STATE}, j AS (SELECT coalesce(st.event_key, nw.event_key) AS event_key, coalesce(CAST(st.seq AS VARCHAR), CAST(nw.seq AS VARCHAR)) AS entry_id,
 CASE WHEN st.level IS NULL OR ({NO.replace('level', 'nw.level')}) >= ({NO.replace('level', 'st.level')}) AND nw.level IS NOT NULL THEN nw.level ELSE st.level END AS level, coalesce(st.seen_at, nw.seen_at) AS deferred_at FROM st FULL JOIN nw ON st.event_key = nw.event_key)
SELECT * FROM j WHERE date_diff('second', deferred_at, TIMESTAMP '2024-01-15 06:00:00') <= 5 * 86400""")
def deferred_flush_order(spark, sf_dir):
    before, after = before_and_after(spark, sf_dir)
    named = lambda d: K.highest_of_each(d).withColumn("entry_id", F.col("seq").cast("string"))
    queue = named(before).select("event_key", "entry_id", "level", F.col("seen_at").alias("deferred_at"))
    incoming = named(after).withColumnRenamed("seen_at", "deferred_at")
    merged = K.deferred(queue, incoming)
    return K.flush_order(K.unexpired(merged, F.lit("2024-01-15 06:00:00").cast("timestamp"), 120)).select("event_key", "entry_id", "level", "deferred_at")


@query("""WITH s AS (SELECT event_type, count(*) FILTER (ts >= TIMESTAMP '2024-01-20' AND ts < TIMESTAMP '2024-01-21') AS n FROM events GROUP BY 1)
SELECT count(*) AS configured, count(*) FILTER (n > 0) AS successful, count(*) FILTER (n > 0) AS recovered, count(*) FILTER (n > 0) / CAST(count(*) AS DOUBLE) AS ratio, 30 AS minutes, CASE WHEN count(*) FILTER (n > 0) = 0 THEN 'fail_closed' WHEN count(*) FILTER (n > 0) < 0.67 * count(*) THEN 'degraded' ELSE 'healthy' END AS status FROM s""")
def input_health(spark, sf_dir):
    day = (F.col("ts") >= "2024-01-20") & (F.col("ts") < "2024-01-21")
    sources = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source_id")).agg((F.count_if(day) > 0).alias("succeeded")).withColumn("recovered", F.lit(True))
    return K.health(sources, F.lit(30))


def _ledger_of_labels(spark, sf_dir, find):
    """What find gives of a ledger that has the labels as answers: a tag each, and none where neither label is set."""
    root = new_path(spark, "ledger")
    ledger, hit = Ledger(spark, root), (F.col("quality") == 1) | (F.col("toxic") == 1)
    labels = table(spark, sf_dir, "labels")
    ledger.add(labels.select(F.col("doc_id").alias("news_id"), F.lit("doc").alias("kind"), F.lit("interests").alias("interests"), F.lit(1).cast("long").alias("version"), F.when(hit, F.lit(1).cast("long")).alias("tag_id"), F.when(hit, 1.0).alias("score"), hit.alias("matched")))
    items = table(spark, sf_dir, "documents").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("news_id"), F.col("text").alias("title"))
    out = cut(find(ledger, items).select(F.col("news_id").alias("doc_id")), "pending")
    delete(spark, [root])
    return out


@query("SELECT DISTINCT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def pending_items(spark, sf_dir):
    return _ledger_of_labels(spark, sf_dir, lambda ledger, items: ledger.pending(items, "interests", 1))


@query("SELECT DISTINCT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND (quality = 1 OR toxic = 1))")
def pending_again(spark, sf_dir):
    """With those whose answer matched nothing."""
    return _ledger_of_labels(spark, sf_dir, lambda ledger, items: ledger.pending(items, "interests", 1, again=True))


@query("SELECT d.source, l.quality, l.toxic, count(*) AS n FROM labels l JOIN documents d USING (doc_id) GROUP BY 1, 2, 3")
def filter_results_by_tag(spark, sf_dir):
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").groupBy("source", "quality", "toxic").agg(F.count("*").alias("n"))


@query("""SELECT r_name, n_name, c_mktsegment, count(*) AS n, min(o_orderkey) AS first_order FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
WHERE o_orderstatus = 'O' GROUP BY 1, 2, 3""")
def active_results_join(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    rows = t("orders").where("o_orderstatus = 'O'").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").groupBy("r_name", "n_name", "c_mktsegment").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_order"))


@query("""WITH o AS (SELECT conv_id, turn, length(text) AS size, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, length(text) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far FROM conversations) SELECT conv_id, turn, size, CAST(so_far AS BIGINT) AS so_far FROM o WHERE so_far <= 1500""")
def prompt_budget(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("size"))
    return K.budgeted(rows, [F.col("turn"), F.col("size")], "size", 1500, "conv_id")


@query("SELECT source, doc_id, CAST(floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 12.0) AS BIGINT) AS chunk FROM documents")
def prompt_chunks(spark, sf_dir):
    return K.chunked(table(spark, sf_dir, "documents").select("source", "doc_id"), [F.col("doc_id")], 12, "source")


@query(f"WITH e AS (SELECT event_id, {LEVEL} AS level FROM events) SELECT level, count(*) AS n FROM e GROUP BY 1")
def count_by_level(spark, sf_dir):
    rows = updates(spark, sf_dir).groupBy("level").agg(F.count("*").alias("n"))
    levels = spark.createDataFrame([(x,) for x in S.LEVELS], "level string")
    return levels.join(rows, "level", "left").na.fill(0, ["n"])


TG = "tg AS (SELECT doc_id AS tag_id, source AS interests, CASE WHEN doc_id % 4 = 0 THEN 'deprecated' ELSE 'active' END AS status, doc_id % 5 AS priority, doc_id % 7 AS version, concat('h', doc_id) AS prompt_hash FROM documents)"


def tags(spark, sf_dir):
    """Documents as tags, their source as the file of interests."""
    status = F.when(F.col("doc_id") % 4 == 0, "deprecated").otherwise("active")
    number = lambda n: F.col("doc_id") % n
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("tag_id"), F.col("source").alias("interests"), status.alias("status"), number(5).alias("priority"), number(7).alias("version"), F.concat(F.lit("h"), "doc_id").alias("prompt_hash"))


@query(f"WITH {TG} SELECT tag_id, priority, version FROM tg WHERE status = 'active' AND interests = 'src3' ORDER BY priority, tag_id")
def active_tags(spark, sf_dir):
    return K.active_tags(tags(spark, sf_dir), "src3").select("tag_id", "priority", "version")


@query(f"WITH {TG}, p AS (SELECT prompt_hash FROM tg WHERE status = 'active' AND interests = 'src3' ORDER BY version DESC, tag_id LIMIT 1) SELECT (SELECT prompt_hash FROM p) AS prompt_hash, (SELECT max(version) FROM tg) AS version")
def newest_tags(spark, sf_dir):
    rows = tags(spark, sf_dir)
    return K.newest_prompt(rows, "src3").join(F.broadcast(K.newest_version(rows)))


@query("SELECT d.doc_id, d.source FROM documents d JOIN labels l USING (doc_id) WHERE NOT (d.source = 'src3' AND l.toxic = 0)")
def tried_again(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", F.col("source").alias("interests"), (F.col("toxic") != 0).alias("matched"))
    return K.to_be_tried_again(rows, "src3").select("doc_id", F.col("interests").alias("source"))


@query(f"WITH {UPDATES}, {STATE} SELECT event_key, level FROM st WHERE event_key NOT IN (SELECT event_key FROM nw)")
def deferred_removed(spark, sf_dir):
    before, after = before_and_after(spark, sf_dir)
    return K.removed(K.highest_of_each(before), after.select("event_key")).select("event_key", "level")
