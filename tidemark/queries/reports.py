"""Queries of daily listings, reports and entities."""

from pyspark.sql import functions as F

from tidemark.operators import reports as P
from tidemark.queries.base import TITLES, query, table, titles
from tidemark.queries.rules import ASSIGNED, NAMES, R
from tidemark.queries.topics import EVIDENCE, evidence
from tidemark.operators import grouping as G


@query(f"WITH {TITLES} SELECT seq, source_id, title, rank FROM ti WHERE day = DATE '2024-01-05' ORDER BY rank, seq LIMIT 20")
def news_by_date(spark, sf_dir):
    return titles(spark, sf_dir).where("day = '2024-01-05'").select("seq", "source_id", "title", "rank").orderBy("rank", "seq").limit(20)


@query(f"WITH {TITLES} SELECT seq, day, rank FROM ti WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-11' ORDER BY day DESC, rank, seq LIMIT 60")
def news_by_date_range(spark, sf_dir):
    return titles(spark, sf_dir).where("day BETWEEN '2024-01-05' AND '2024-01-11'").select("seq", "day", "rank").orderBy(F.desc("day"), "rank", "seq").limit(60)


@query(f"WITH {TITLES} SELECT seq, source_id, rank FROM ti WHERE day = (SELECT max(day) FROM ti) ORDER BY rank, seq LIMIT 50")
def latest_news(spark, sf_dir):
    rows = titles(spark, sf_dir)
    last = F.broadcast(rows.agg(F.max("day").alias("last")))
    return rows.join(last, F.col("day") == F.col("last")).select("seq", "source_id", "rank").orderBy("rank", "seq").limit(50)


@query(f"WITH {TITLES} SELECT source_id, count(*) FILTER (day = DATE '2024-01-30') AS today, count(*) AS n, min(day) AS first_day, max(day) AS last_day FROM ti GROUP BY 1")
def feeds_status(spark, sf_dir):
    return titles(spark, sf_dir).groupBy("source_id").agg(F.count_if(F.col("day") == F.lit("2024-01-30").cast("date")).alias("today"), F.count("*").alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@query(f"WITH {TITLES} SELECT min(day) AS first_day, max(day) AS last_day, count(DISTINCT day) AS days, count(*) AS n, count(DISTINCT source_id) AS sources FROM ti")
def date_range(spark, sf_dir):
    return titles(spark, sf_dir).agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.countDistinct("day").alias("days"), F.count("*").alias("n"), F.countDistinct("source_id").alias("sources"))


@query(f"{EVIDENCE}, s AS (SELECT topic, CASE label WHEN 'cross_layer_verified' THEN 400 WHEN 'chinese_only_hot' THEN 320 WHEN 'high_heat_unverified' THEN 240 WHEN 'silence_gap' THEN 160 ELSE 0 END + least(platforms, 8) AS score FROM e) SELECT topic, score FROM s ORDER BY score DESC, topic LIMIT 40")
def digest_scores(spark, sf_dir):
    score = P.digest_score(F.col("label"), F.lit(False), F.col("platforms"))
    return evidence(spark, sf_dir).select("topic", score.alias("score")).orderBy(F.desc("score"), "topic").limit(40)


@query(f"""{EVIDENCE}, s AS (SELECT topic, CASE WHEN topic LIKE 'th%' THEN 'noise:th' ELSE 'main:' || coalesce(label, 'background') END AS section FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY topic) AS k FROM s) SELECT section, count(*) AS n, string_agg(topic, ', ' ORDER BY k) FILTER (k <= 3) AS examples FROM r GROUP BY 1""")
def report_sections(spark, sf_dir):
    rows = evidence(spark, sf_dir).select(F.col("topic").alias("event_id"), F.col("label").alias("bucket"), F.when(F.col("topic").startswith("th"), "th").alias("category"), F.col("topic").alias("title"))
    return P.sections(rows).withColumn("examples", F.array_join("examples", ", "))


@query(f"{ASSIGNED}, g AS (SELECT group_no, count(*) AS n FROM a WHERE group_no IS NOT NULL GROUP BY 1 ORDER BY n DESC, group_no LIMIT 8), k AS (SELECT a.*, n, row_number() OVER (PARTITION BY group_no ORDER BY rank, seq) AS place FROM a JOIN g USING (group_no)) SELECT group_no, {NAMES} AS group_name, seq, place, n > 5 AS truncated FROM k WHERE place <= 5")
def raw_appendix(spark, sf_dir):
    rows = G.assigned(titles(spark, sf_dir), R).where("group_no IS NOT NULL")
    groups = rows.groupBy("group_no").agg(F.count("*").alias("n"))
    out = P.appendix(groups, rows)
    return out.select("group_no", F.element_at(G.names_of(R), F.col("group_no")).alias("group_name"), "seq", F.col("place").cast("long").alias("place"), "truncated")


@query("""WITH r AS (SELECT source AS tag, CAST(regexp_extract(source, '(\\d+)$', 1) AS INT) % 3 AS priority, quality + toxic / 2.0::DOUBLE AS score, sha256(text) AS title, l.doc_id AS seq FROM labels l JOIN documents USING (doc_id)),
f AS (SELECT *, row_number() OVER (PARTITION BY tag, title ORDER BY seq) AS k FROM r WHERE score >= 0.5), c AS (SELECT tag, min(priority) AS priority, count(*) AS n, max(score) AS best FROM f WHERE k = 1 GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY priority, n DESC, tag) AS place FROM c""")
def filter_report(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    rows = rows.select(F.col("source").alias("tag"), (F.regexp_extract("source", r"(\d+)$", 1).cast("int") % 3).alias("priority"), (F.col("quality") + F.col("toxic") / 2.0).alias("score"), F.sha2("text", 256).alias("title"), F.col("doc_id").alias("seq"))
    return P.tagged(rows, 0.5).withColumn("place", F.col("place").cast("long"))


def _alike(x: str, y: str) -> str:
    """SQL of how alike two keys are."""
    pairs = lambda k: f"list_distinct(list_transform(range(1, greatest(length({k}), 2)), lambda i: substr({k}, CAST(i AS INT), 2)))"
    share = f"len(list_intersect({pairs(x)}, {pairs(y)})) / CAST(least(len({pairs(x)}), len({pairs(y)})) AS DOUBLE)"
    return f"CASE WHEN contains({x}, {y}) OR contains({y}, {x}) THEN 1.0 WHEN least(length({x}), length({y})) < 8 THEN 0.0 ELSE {share} END"


def _rounds(most: int) -> str:
    """SQL of the digest: each round's best of what isn't like the best before."""
    out, rest = [], "k"
    for i in range(1, most + 1):
        out.append(f"b{i} AS (SELECT * FROM {rest} ORDER BY score DESC, seq LIMIT 1)")
        out.append(f"r{i} AS (SELECT {rest}.* FROM {rest}, b{i} WHERE {_alike(f'{rest}.key', f'b{i}.key')} < 0.72)")
        rest = f"r{i}"
    return ", ".join(out)


@query(f"""WITH {TITLES}, t AS (SELECT title AS topic, min(seq) AS seq, CAST(100 * least(count(DISTINCT source_id), 8) + least(count(*), 50) AS BIGINT) AS score FROM ti GROUP BY 1),
k AS (SELECT *, regexp_replace(lower(topic), '[\\s\\x0B\\p{{P}}\\p{{S}}]', '', 'g') AS key FROM t WHERE regexp_replace(lower(topic), '[\\s\\x0B\\p{{P}}\\p{{S}}]', '', 'g') <> ''),
{_rounds(5)} SELECT row_number() OVER (ORDER BY score DESC, seq) AS place, topic, seq, score FROM (""" + " UNION ALL ".join(f"SELECT * FROM b{i}" for i in range(1, 6)) + ")")
def digest_topics(spark, sf_dir):
    """The five best of all titles, by sources and copies, none like another."""
    score = 100 * F.least(F.countDistinct("source_id"), F.lit(8)) + F.least(F.count("*"), F.lit(50))
    rows = titles(spark, sf_dir).groupBy(F.col("title").alias("topic")).agg(F.min("seq").alias("seq"), score.cast("long").alias("score"))
    return P.digest(rows).withColumn("place", F.col("place").cast("long"))
