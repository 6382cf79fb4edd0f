"""Sections of reports from topics and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidemark.functions.text import WHITE, compatible
from tidemark.plans.scratch import cut

#: Fixed values.
BUCKET_SCORES = {"cross_layer_verified": 400, "chinese_only_hot": 320, "high_heat_unverified": 240, "silence_gap": 160}


def digest_score(bucket: Column, has_summary: Column, platforms: Column) -> Column:
    value = F.lit(0)
    for name, score in BUCKET_SCORES.items():
        value = F.when(bucket == name, score).otherwise(value)
    return value + F.when(has_summary, 12).otherwise(0) + F.least(platforms, F.lit(8))


def topic_key(topic: Column) -> Column:
    """A topic's name as digests compare it: in compatibility form and lower case, without white space, marks and symbols."""
    return F.regexp_replace(F.lower(compatible(F.coalesce(topic, F.lit("")))), rf"{WHITE}|[\p{{P}}\p{{S}}]", "")


def letter_pairs(key: Column) -> Column:
    """Distinct pairs of neighbouring letters; of a single letter that one."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(key) - 1, F.lit(1))), lambda i: F.substr(key, i, F.lit(2))))


def alike(key: Column, pairs: Column, other: Column, other_pairs: Column) -> Column:
    """Shared letter pairs by the smaller set; 1 where one key contains the other, 0 for short ones."""
    share = F.size(F.array_intersect(pairs, other_pairs)) / F.least(F.size(pairs), F.size(other_pairs))
    return F.when(F.contains(key, other) | F.contains(other, key), 1.0).when(F.least(F.length(key), F.length(other)) < 8, 0.0).otherwise(share)


def _chosen(rows: DataFrame, most: int, limit: float) -> list[Row]:
    """Of (topic, score, seq, ...) up to most, in rounds: the best, then the best that isn't like it, and so on."""
    keyed = rows.withColumn("_key", topic_key(F.col("topic"))).where("_key <> ''")
    rest, chosen = cut(keyed.withColumn("_pairs", letter_pairs(F.col("_key"))), "best-topics"), []
    for _ in range(most):
        best = rest.orderBy(F.desc("score"), "seq").limit(1).collect()
        if not best:
            break
        chosen.append(best[0])
        key, pairs = F.lit(best[0]["_key"]), F.array(*map(F.lit, best[0]["_pairs"]))
        rest = rest.where(alike(F.col("_key"), F.col("_pairs"), key, pairs) < limit)
    return chosen


def digest(topics: DataFrame, most: int = 5, limit: float = 0.72, first: int = 1000) -> DataFrame:
    """The topics (topic, score, seq, ...) of a digest with their place: best first, none too like one before it.

    In each of most rounds the best topic is taken (highest score, then least seq) and all that are like it leave; one
    row a round comes to the driver. What is taken from the best so many topics is what would be taken from all, so the
    first ones alone get keys, and many more only as long as they don't yield enough: every topic counts. Topics without
    letters or digits are left out.
    """
    table, chosen = cut(topics, "topics"), []
    n = table.count()
    while True:
        rows = table if first >= n else table.orderBy(F.desc("score"), "seq").limit(first)
        chosen = _chosen(rows, most, limit)
        if len(chosen) == most or first >= n:
            break
        first *= 100
    out = [(place, *[r[c] for c in topics.columns]) for place, r in enumerate(chosen, 1)]
    return topics.sparkSession.createDataFrame(out, StructType([StructField("place", IntegerType()), *topics.schema.fields]))


def sections(events: DataFrame, examples: int = 3) -> DataFrame:
    """Events (event_id, bucket, category, title): main sections by bucket, noise by category, with counts and examples."""
    name = F.when(F.col("category").isNotNull(), F.concat(F.lit("noise:"), "category")).otherwise(F.concat(F.lit("main:"), F.coalesce("bucket", F.lit("background"))))
    rows = events.withColumn("section", name)
    counts = rows.groupBy("section").agg(F.count("*").alias("n"))
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy("section").orderBy("event_id"))).where(F.col("place") <= examples)
    shown = ranked.groupBy("section").agg(F.array_sort(F.collect_list(F.struct("place", "title"))).alias("x")).select("section", F.transform("x", lambda e: e["title"]).alias("examples"))
    return counts.join(shown, "section")


def appendix(groups: DataFrame, titles: DataFrame, most_groups: int = 8, most_titles: int = 5) -> DataFrame:
    """The first titles of the largest groups, and whether more were cut off."""
    top = groups.orderBy(F.desc("n"), "group_no").limit(most_groups)
    ranked = titles.join(F.broadcast(top), "group_no").withColumn("place", F.row_number().over(Window.partitionBy("group_no").orderBy("rank", "seq")))
    return ranked.where(F.col("place") <= most_titles).withColumn("truncated", F.col("n") > most_titles)


def tagged(results: DataFrame, least: float = 0.0) -> DataFrame:
    """Classifier results (tag, priority, title, score, seq): of a tag and title the first row, with counts and order."""
    first = results.where(F.col("score") >= least).withColumn("_n", F.row_number().over(Window.partitionBy("tag", "title").orderBy("seq"))).where("_n = 1")
    counts = first.groupBy("tag").agg(F.min("priority").alias("priority"), F.count("*").alias("n"), F.max("score").alias("best"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy("priority", F.desc("n"), "tag")))


def best_tags(answers: DataFrame, ids: DataFrame) -> DataFrame:
    """(batch, body) of classifier answers, a JSON array of {id, tag, score}, to the best tag of each known id.

    A code fence around the array is taken off, scores are clamped to 0 to 1, missing ones are a half.
    """
    body = F.regexp_replace("body", r"(?s)^\s*```[a-z]*\s*|\s*```\s*$", "")
    rows = answers.select(F.explode(F.from_json(body, "array<struct<id: long, tag: string, score: double>>")).alias("x")).select("x.*").where("tag IS NOT NULL")
    score = F.least(F.greatest(F.coalesce("score", F.lit(0.5)), F.lit(0.0)), F.lit(1.0))
    known = rows.withColumn("score", score).join(ids.select("id"), "id", "left_semi")
    return known.groupBy("id").agg(F.max_by(F.struct("tag", "score"), F.struct("score", "tag")).alias("x")).select("id", "x.*")


def returned_ids(expected: DataFrame, returned: DataFrame) -> DataFrame:
    """One row for each batch of (batch, id): missing, extra and repeated ids; a batch with any is rejected."""
    got = returned.groupBy("batch", "id").agg(F.count("*").alias("n"))
    both = expected.select("batch", "id").distinct().withColumn("wanted", F.lit(True)).join(got, ["batch", "id"], "full_outer")
    out = both.groupBy("batch").agg(F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("wanted").isNull()).alias("extra"), F.count_if(F.col("n") > 1).alias("repeated"))
    return out.withColumn("accepted", (F.col("missing") == 0) & (F.col("extra") == 0) & (F.col("repeated") == 0))


def dashboard(most: int = 10_000, **parts: DataFrame) -> DataFrame:
    """One row with a JSON document of small tables by name, each sorted; one with more than most rows is an error."""
    out = None
    for name, rows in sorted(parts.items()):
        listed = rows.select(F.struct(*sorted(rows.columns)).alias("x")).limit(most + 1)
        fits = F.when(F.count("*") > most, F.raise_error(F.lit(f"{name} has more than {most} rows")).cast("boolean")).otherwise(True)
        one = listed.agg(F.array_sort(F.collect_list("x")).alias(name), fits.alias("_fits")).where("_fits").drop("_fits")
        out = one if out is None else out.crossJoin(F.broadcast(one))  # one row each
    return out.select(F.to_json(F.struct("*")).alias("document"))


def presented(candidates: DataFrame, most: int = 3) -> DataFrame:
    """Alerts and urgent candidates in order: level, score, title, id."""
    rank = F.when(F.col("level") == "urgent", 0).when(F.col("level") == "alert", 1).when(F.col("level") == "watch", 2).otherwise(3)
    return candidates.where(F.col("level").isin("urgent", "alert")).orderBy(rank, F.desc("score"), F.lower("title"), "candidate_id").limit(most)


def bound(candidates: DataFrame, scores: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates with their one score and decision; ids that are repeated or missing are an error."""
    n = [d.groupBy("candidate_id").agg(F.count("*").alias(f"n{i}")) for i, d in enumerate((candidates, scores, decisions))]
    each = n[0].join(n[1], "candidate_id", "full_outer").join(n[2], "candidate_id", "full_outer")
    wrong = each.where("n0 IS NULL OR n1 IS NULL OR n2 IS NULL OR n0 + n1 + n2 <> 3")
    if not wrong.isEmpty():
        raise ValueError(f"candidates, scores and decisions don't go together, for instance {wrong.first()['candidate_id']}")
    return candidates.join(scores, "candidate_id").join(decisions, "candidate_id")
