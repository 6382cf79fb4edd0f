"""Queries of tiers, evidence, labels, scores and clusters."""

from pyspark.sql import functions as F

from tidemark.functions import scores as S
from tidemark.operators import cluster, scoring, topics
from tidemark.operators import history as H
from tidemark.queries.base import OBS, OFF, TIER, TITLES, query, tiers, titles, words_of
from tidemark.queries.history import full_history

ITEMS = f"{TITLES}, it AS (SELECT ws.word AS topic, ti.source_id, {TIER.replace('source_id', 'ti.source_id')} AS tier, ti.rank, ti.title, ti.seq FROM ws JOIN ti USING (seq))"
EVIDENCE = f"""WITH {ITEMS}, g AS (SELECT topic, bool_or(tier = 'A') AS a, bool_or(tier = 'B') AS b, bool_or(tier = 'C') AS c, bool_or(tier = 'D') AS d, count(DISTINCT source_id) AS platforms,
 count(DISTINCT source_id) FILTER (tier = 'D') AS d_platforms, min(rank) FILTER (tier = 'D') AS best_d_rank, bool_or(regexp_matches(title, '(?i)(panic|outrage|shock|that)')) AS feeling,
 count(*) FILTER (tier IN ('A', 'B')) AS ab_items, count(*) AS items FROM it GROUP BY 1),
h AS (SELECT *, d_platforms >= 2 OR coalesce(best_d_rank <= 10, false) AS high_d FROM g),
e AS (SELECT *, CASE WHEN d AND (a OR b) THEN 'cross_layer_verified' WHEN d AND c THEN 'chinese_only_hot' WHEN d THEN CASE WHEN high_d THEN 'high_heat_unverified' WHEN feeling THEN 'sentiment_heavy' END WHEN a OR b THEN 'silence_gap' END AS label FROM h)"""


def evidence(spark, sf_dir):
    feeling = F.col("title").rlike(r"(?i)(panic|outrage|shock|that)")  # once a title, before its words part
    rows = titles(spark, sf_dir).select("source_id", "rank", feeling.alias("feeling"), "words")
    each = rows.select("source_id", "rank", "feeling", F.explode("words").alias("topic"))
    return topics.evidence(topics.with_tier(each, tiers(spark, sf_dir)))


@query(f"WITH {TITLES} SELECT seq, source_id, {TIER} AS tier, CASE WHEN CAST(regexp_extract(source_id, '(\\d+)$', 1) AS INT) % 2 = 0 THEN 'lead' ELSE 'follow' END AS role FROM ti")
def tier_lookup(spark, sf_dir):
    return topics.with_tier(titles(spark, sf_dir).select("seq", "source_id"), tiers(spark, sf_dir))


@query(f"{EVIDENCE} SELECT * FROM e")
def evidence_label(spark, sf_dir):
    return evidence(spark, sf_dir)


@query(f"{EVIDENCE} SELECT coalesce(label, 'background') AS label, count(*) AS n FROM e GROUP BY 1")
def overview_stats(spark, sf_dir):
    return topics.label_counts(evidence(spark, sf_dir))


@query(f"{EVIDENCE} SELECT count(*) FILTER (a) AS with_a, count(*) FILTER (b) AS with_b, count(*) FILTER (c) AS with_c, count(*) FILTER (d) AS with_d, count(*) AS topics FROM e")
def tier_presence(spark, sf_dir):
    return topics.tier_presence(evidence(spark, sf_dir))


@query(f"""{EVIDENCE} SELECT CAST(count(*) FILTER (label = 'cross_layer_verified') AS BIGINT) AS cross_layer_verified, count(*) FILTER (label = 'chinese_only_hot') AS chinese_only_hot, count(*) FILTER (label = 'high_heat_unverified') AS high_heat_unverified,
 count(*) FILTER (label = 'silence_gap') AS silence_gap, count(*) FILTER (label IS NULL OR label = 'sentiment_heavy') AS suppressed FROM e""")
def radar_readout(spark, sf_dir):
    return topics.readout(topics.label_counts(evidence(spark, sf_dir)))


@query(f"""WITH {ITEMS}, f AS (SELECT *, row_number() OVER (PARTITION BY topic, source_id, title ORDER BY rank, seq) AS k FROM it), r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY rank, seq) AS place FROM f WHERE k = 1)
SELECT topic, source_id, title, place FROM r WHERE place <= 3""")
def evidence_samples(spark, sf_dir):
    rows = topics.samples(titles(spark, sf_dir), words_of(F.col("title")), [F.col("rank"), F.col("seq")], 3, ["source_id", "title"])
    return rows.select("topic", "source_id", "title", F.col("place").cast("long").alias("place"))


@query(f"{EVIDENCE} SELECT topic, CASE WHEN d_platforms >= 3 OR platforms >= 5 THEN 'confirmed' WHEN d_platforms >= 2 OR platforms >= 3 THEN 'high' ELSE 'public' END AS confidence FROM e WHERE c AND d AND NOT a AND NOT b")
def domestic_confidence(spark, sf_dir):
    c = {x: F.col(x) for x in "abcd"}
    value = S.domestic_confidence(F.col("platforms"), F.col("d_platforms"), **c)
    return evidence(spark, sf_dir).select("topic", value.alias("confidence")).where("confidence IS NOT NULL")


N = "(CAST(a AS INT) + CAST(b AS INT) + CAST(c AS INT) + CAST(d AS INT))"
STRENGTH = f"CASE WHEN ((a OR b) AND (c OR d)) OR {N} >= 3 THEN 'strong' WHEN {N} = 2 THEN 'moderate' ELSE 'weak' END"
CROSS = f"CAST(least(CASE {STRENGTH} WHEN 'strong' THEN 7 WHEN 'moderate' THEN 4 ELSE 0 END + CASE WHEN {N} >= 2 THEN 4 ELSE 0 END + CASE WHEN {N} >= 4 THEN 4 WHEN {N} = 3 THEN 2 WHEN {N} = 2 THEN 1 ELSE 0 END, 15) AS DOUBLE)"


@query(f"{EVIDENCE} SELECT topic, {STRENGTH} AS strength, {CROSS} AS cross_layer FROM e")
def score_cross_layer(spark, sf_dir):
    t = [F.col(x) for x in "abcd"]
    return evidence(spark, sf_dir).select("topic", S.strength(*t).alias("strength"), S.cross_layer(*t).alias("cross_layer"))


ENTRY = "CASE WHEN rank <= 3 THEN 30.0 WHEN rank <= 10 THEN 27.0 WHEN rank <= 20 THEN 23.0 WHEN rank <= 50 THEN 15.0 WHEN rank <= 100 THEN 8.0 ELSE 3.0 END"


@query(f"""WITH {OBS}, {OFF}, p AS (SELECT *, lag(rank) OVER (PARTITION BY source_id, item_id ORDER BY batch, seq) AS row_before,
 count(CASE WHEN rank > 0 AND rank <> 99 THEN 1 END) OVER (PARTITION BY source_id, item_id ORDER BY batch, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tv FROM hist),
l AS (SELECT *, row_before - rank AS delta, row_before IS NULL AS is_new, CASE source_id WHEN 'click' THEN 'A' WHEN 'view' THEN 'B' WHEN 'purchase' THEN 'C' ELSE 'D' END AS tier,
 count(*) OVER (PARTITION BY item_id) AS n FROM p WHERE rank > 0 AND rank <> 99 AND batch = TIMESTAMP '2024-01-10'),
sr AS (SELECT item_id, count(DISTINCT source_id) AS sources FROM l GROUP BY 1),
s AS (SELECT l.item_id, sources, rank, source_id, tier,
 CASE WHEN row_before IS NULL THEN CASE WHEN tv <= 1 THEN {ENTRY} * 0.7 ELSE {ENTRY} END WHEN NOT (row_before > 0 AND row_before <> 99) THEN {ENTRY}
 WHEN delta > 0 THEN least(CASE WHEN delta >= 50 AND rank <= 20 THEN 28.0 WHEN delta >= 30 AND rank <= 20 THEN 25.0 WHEN delta >= 20 THEN 21.0 WHEN delta >= 10 THEN 15.0 WHEN delta >= 5 THEN 9.0 ELSE 0.0 END, CASE WHEN rank > 50 THEN 12.0 ELSE 99.0 END)
 WHEN rank <= 10 THEN 3.0 WHEN rank <= 20 THEN 2.0 ELSE 0.0 END AS mv,
 CASE WHEN NOT is_new THEN 0.0 ELSE (CASE WHEN rank <= 3 THEN 13.0 WHEN rank <= 10 THEN 12.0 WHEN rank <= 20 THEN 10.0 WHEN rank <= 50 THEN 7.0 ELSE 4.0 END) * (CASE WHEN sources <= 1 AND rank > 50 THEN 0.8 ELSE 1.0 END) END AS bu,
 CASE WHEN is_new THEN 8.0 ELSE 4.0 END AS re,
 CASE WHEN tv >= 3 AND rank <= 20 THEN 5 WHEN tv >= 3 AND rank <= 50 THEN 4 WHEN tv >= 2 AND rank <= 50 THEN 3 WHEN tv >= 2 AND rank <= 100 THEN 2 ELSE 0 END AS pe
 FROM l JOIN sr USING (item_id)),
c AS (SELECT item_id, least(max(mv)::DOUBLE + max(bu)::DOUBLE + max(re)::DOUBLE + max(pe), 60.0::DOUBLE) AS growth, min(rank) AS best, max(sources) AS so, count(*) AS it,
 bool_or(tier = 'A') AS a, bool_or(tier = 'B') AS b, bool_or(tier = 'C') AS c, bool_or(tier = 'D') AS d FROM s GROUP BY 1),
x AS (SELECT item_id AS candidate_id, growth, CAST(least(CASE WHEN best <= 3 THEN 30 WHEN best <= 10 THEN 26 WHEN best <= 20 THEN 22 WHEN best <= 50 THEN 16 ELSE 10 END
 + CASE WHEN so >= 4 THEN 12 WHEN so = 3 THEN 8 WHEN so = 2 THEN 5 ELSE 2 END + CASE WHEN it >= 4 THEN 8 WHEN it = 3 THEN 5 WHEN it = 2 THEN 3 ELSE 1 END, 50) AS DOUBLE) AS heat, {CROSS} AS "cross", {STRENGTH} AS st FROM c),
y AS (SELECT candidate_id, growth, heat, "cross", least(least(growth + heat, 80.0::DOUBLE) * (CASE st WHEN 'strong' THEN 1.10::DOUBLE WHEN 'moderate' THEN 1.0::DOUBLE ELSE 0.88::DOUBLE END) + least(least("cross", 20.0::DOUBLE) * 0.25::DOUBLE, 5.0::DOUBLE), 100.0::DOUBLE) AS score FROM x)
SELECT candidate_id, growth, heat, "cross", score, CASE WHEN score >= 80 THEN 'urgent' WHEN score >= 60 THEN 'alert' ELSE 'watch' END AS level FROM y""")
def decision_level(spark, sf_dir):
    rows = H.with_previous(full_history(spark, sf_dir)).where("visible AND batch = '2024-01-10'")
    tier = F.when(F.col("source_id") == "click", "A").when(F.col("source_id") == "view", "B").when(F.col("source_id") == "purchase", "C").otherwise("D")
    visible = F.coalesce((F.col("row_before") > 0) & (F.col("row_before") != 99), F.lit(False))
    rows = rows.withColumns({"candidate_id": F.col("item_id"), "tier": tier, "is_new": F.col("row_before").isNull(), "count": F.col("times_visible"), "best_rank": F.col("rank"), "first_time": F.col("batch"), "last_time": F.col("batch")})
    known = {"kind": F.lit("hotlist"), "reliable": F.col("times_visible") > 0, "has_before": ~F.col("is_new"), "before_visible": visible, "rank_delta": F.col("delta"), "has_count": F.col("count") > 0, "has_times": F.col("batch").isNotNull()}
    unset = {c: F.lit(None).cast("string") for c in ("feed_id", "source_name")} | {c: F.lit(False) for c in ("times_made_up", "after_gap")}
    rows = rows.withColumns(known | unset | {"new_meaning": F.when(F.col("is_new"), "new_titles_detection")})
    return scoring.decided(scoring.candidate_scores(rows, "candidate_id")).select("candidate_id", "growth", "heat", "cross", "score", "level")


#: Clusters of titles: cl (seq, cluster), and nt, the titles in normal form.
CLUSTERS = f"""WITH RECURSIVE {TITLES}, nt AS (SELECT seq, trim(regexp_replace(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS norm, list_distinct(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}_]+')) AS tok FROM ti),
d AS (SELECT norm, min(seq) AS seq, any_value(tok) AS tok FROM nt GROUP BY 1), ex AS (SELECT seq, len(tok) AS m, unnest(tok) AS w FROM d),
sh AS (SELECT x.seq AS a, y.seq AS b, count(*) AS k, any_value(least(x.m, y.m)) AS m FROM ex x JOIN ex y ON x.w = y.w AND x.seq < y.seq GROUP BY 1, 2),
one AS MATERIALIZED (SELECT a, b FROM sh WHERE k >= 2 AND 100 * k >= 55 * m),
ed AS MATERIALIZED (SELECT a, b FROM one UNION ALL SELECT b, a FROM one),
cc(n, c) USING KEY (n) AS (SELECT seq, seq FROM d UNION (SELECT ed.b, min(cc.c) FROM cc JOIN ed ON ed.a = cc.n JOIN recurring.cc AS o ON o.n = ed.b WHERE cc.c < o.c GROUP BY ed.b)),
cl AS (SELECT nt.seq, cc.c AS cluster FROM nt JOIN d ON nt.norm = d.norm JOIN cc ON cc.n = d.seq)"""


@query(f"{CLUSTERS} SELECT seq, cluster FROM cl")
def title_clusters(spark, sf_dir):
    return cluster.clustered(titles(spark, sf_dir).select("seq", F.lit("").alias("url"), "title")).select("seq", "cluster")
