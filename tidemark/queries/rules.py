"""Queries of keyword rules over titles."""

from pyspark.sql import functions as F

from tidemark.operators import grouping as G
from tidemark.plans.rules import parse_rules
from tidemark.queries.base import RULES, TITLES, query, titles

R = parse_rules(RULES)
ASSIGNED = f"WITH {TITLES}, a AS (SELECT *, {R.first_group_sql('title')} AS group_no FROM ti)"
NAMES = "CASE group_no " + " ".join(f"WHEN {g.position} THEN '{g.name}'" for g in R.groups) + " END"
CAPS = "CASE group_no " + " ".join(f"WHEN {g.position} THEN {g.most or 6}" for g in R.groups) + " END"


@query(f"{ASSIGNED} SELECT seq, group_no FROM a WHERE group_no IS NOT NULL")
def keyword_first_match(spark, sf_dir):
    return G.assigned(titles(spark, sf_dir), R).where("group_no IS NOT NULL").select("seq", "group_no")


@query(f"{ASSIGNED} SELECT group_no, {NAMES} AS group_name, count(*) AS n, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM ti) AS percentage FROM a WHERE group_no IS NOT NULL GROUP BY group_no")
def keyword_percentage(spark, sf_dir):
    return G.group_counts(titles(spark, sf_dir), R)


@query(f"{ASSIGNED}, k AS (SELECT *, row_number() OVER (PARTITION BY group_no ORDER BY rank, title, seq) AS place FROM a WHERE group_no IS NOT NULL) SELECT group_no, seq, title, place FROM k WHERE place <= {CAPS}")
def capped_group_topk(spark, sf_dir):
    rows = G.capped(titles(spark, sf_dir), R, [F.col("rank"), F.col("title"), F.col("seq")], cap=6)
    return rows.select("group_no", "seq", "title", F.col("place").cast("long").alias("place"))


@query(f"""{ASSIGNED}, f AS (SELECT title, min((seq, source_id, rank)) AS x FROM a WHERE group_no IS NULL AND {R.passes_sql('title')} GROUP BY title),
g AS (SELECT title, x[2] AS source_id, x[3] AS rank FROM f) SELECT substr(title, 1, 30) AS group_name, title, source_id, rank FROM g WHERE rank <= 5 ORDER BY rank, title LIMIT 5""".replace("x[2]", "struct_extract(x, 2)").replace("x[3]", "struct_extract(x, 3)"))
def catch_all_top5(spark, sf_dir):
    return G.catch_all(titles(spark, sf_dir), R)


@query(
    f"WITH {TITLES}, h AS (SELECT seq, list_filter([{', '.join(f'CASE WHEN {g.matches_sql("lower(title)")} THEN {g.position} END' for g in R.groups)}], lambda p: p IS NOT NULL) AS hits FROM ti WHERE {R.passes_sql('title')}), "
    "e AS (SELECT hits[1] AS winner, unnest(hits[2:]) AS other FROM h WHERE len(hits) > 1) SELECT winner, other, count(*) AS n FROM e GROUP BY 1, 2"
)
def swallowed_pairs(spark, sf_dir):
    return G.swallowed(titles(spark, sf_dir), R)


@query(f"{ASSIGNED} SELECT CASE WHEN NOT ({R.passes_sql('title')}) THEN 'dropped' WHEN group_no IS NULL THEN 'unmatched' ELSE 'matched' END AS outcome, count(*) AS n FROM a GROUP BY 1")
def rule_outcomes(spark, sf_dir):
    rows = G.assigned(titles(spark, sf_dir), R)
    outcome = F.when(~R.passes(F.col("title")), "dropped").when(F.col("group_no").isNull(), "unmatched").otherwise("matched")
    return rows.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query(f"{ASSIGNED} SELECT group_no, source_id, count(*) AS n, min(rank) AS best FROM a WHERE group_no IS NOT NULL GROUP BY 1, 2")
def group_sources(spark, sf_dir):
    rows = G.assigned(titles(spark, sf_dir), R).where("group_no IS NOT NULL")
    return rows.groupBy("group_no", "source_id").agg(F.count("*").alias("n"), F.min("rank").alias("best"))


@query(f"{ASSIGNED} SELECT lower(regexp_replace(trim(title), '\\s+', ' ', 'g')) AS title, min(seq) AS seq, count(DISTINCT source_id) AS sources, min(group_no) AS group_no FROM a GROUP BY 1")
def rule_titles_deduplicated(spark, sf_dir):
    rows = G.assigned(titles(spark, sf_dir), R).withColumn("title", F.lower(F.regexp_replace(F.trim("title"), r"\s+", " ")))
    return rows.groupBy("title").agg(F.min("seq").alias("seq"), F.countDistinct("source_id").alias("sources"), F.min("group_no").alias("group_no"))
