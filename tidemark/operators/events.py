"""Events from evidence, alerts by level, merged feeds, and statistics of files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.display import sample_summary
from tidemark.plans.scratch import cut, release

#: Levels in the order in which they are listed.
LEVEL_ORDER = "urgent alert watch suppress".split()


def event_id(evidence_ids: Column) -> Column:
    return F.concat(F.lit("evt_"), F.substring(F.sha2(F.array_join(F.array_sort(evidence_ids), "\x1f"), 256), 1, 16))


def bound_events(events: DataFrame, evidence: DataFrame) -> DataFrame:
    """Events (place, topic, title, evidence_ids) that stand on evidence nobody claimed before them.

    In order of place an event is taken if it has a title that no taken event of its topic has, and evidence ids that
    are all known and that no taken event has. One unknown id voids an event; nulls and blanks among the ids don't
    count. place tells events apart. Returns place, topic, title, evidence_ids (distinct, sorted) and event_id.

    Each round takes the events that come first for everything they claim and drops those that clash with them.
    """
    known = evidence.select(F.trim("evidence_id").alias("claim")).where("claim <> ''").distinct().withColumn("known", F.lit(True))
    ids = F.array_sort(F.array_distinct(F.filter(F.transform("evidence_ids", lambda i: F.trim(i)), lambda i: i != "")))
    rows = events.select("place", "topic", F.trim("title").alias("title"), ids.alias("evidence_ids")).where("title <> '' AND size(evidence_ids) > 0")
    rows = cut(rows, "events")
    each = rows.select("place", F.explode("evidence_ids").alias("claim"))
    void = each.join(known, "claim", "left").where("known IS NULL").select("place").distinct()
    titles = rows.select("place", F.sha2(F.to_json(F.struct("topic", "title")), 256).alias("claim"))
    claims = each.select("place", F.concat(F.lit("id "), "claim").alias("claim")).unionByName(titles)
    pending, taken = cut(claims.join(void, "place", "left_anti"), "claims"), None
    while not pending.isEmpty():
        first = pending.groupBy("claim").agg(F.min("place").alias("first"))
        compared = pending.join(first, "claim").groupBy("place").agg(F.bool_and(F.col("place") == F.col("first")).alias("wins"))
        winners = cut(compared.where("wins").select("place"), "taken")
        lost = pending.join(pending.join(winners, "place").select("claim").distinct(), "claim").select("place").distinct()
        left = cut(pending.join(lost, "place", "left_anti"), "claims")
        release(pending)
        pending, taken = left, winners if taken is None else taken.unionByName(winners)
    none = rows.select("place").limit(0)
    return rows.join(none if taken is None else taken, "place").withColumn("event_id", event_id(F.col("evidence_ids")))


def events_of_unclaimed(evidence: DataFrame, taken: DataFrame) -> DataFrame:
    """An event for each piece of evidence (evidence_id, topic, title, source, tier, rank, seen_at, excerpt) that no event claims.

    Of pieces with one id the first by topic and title stays; a null or blank id makes no event.
    """
    claimed = taken.select(F.explode("evidence_ids").alias("evidence_id")).distinct()
    rows = evidence.withColumn("evidence_id", F.trim("evidence_id")).where("evidence_id <> ''").join(claimed, "evidence_id", "left_anti")
    one = rows.groupBy("evidence_id").agg(F.min(F.struct("topic", "title", "source", "tier", "rank", "seen_at", "excerpt")).alias("x")).select("evidence_id", "x.*")
    blank = lambda c: F.trim(F.coalesce(c, F.lit("")))
    source = F.when(blank(F.col("source")) == "", "未知来源").otherwise(F.trim("source"))
    head, on_list = blank(F.col("title")), F.coalesce("tier", F.lit("")) == "D"
    named = F.when(on_list, F.concat(source, F.lit("出现“"), head, F.lit("”相关传播"))).otherwise(F.concat(source, F.lit("收录“"), head, F.lit("”")))
    bare = F.when(on_list, F.concat(source, F.lit("出现未提供标题的传播记录"))).otherwise(F.concat(source, F.lit("收录未提供标题的来源记录")))
    analysis = F.concat(F.lit("单一"), F.coalesce("tier", F.lit("unknown")), F.lit("层来源，覆盖平台为"), source, F.lit("。"))
    return one.select(
        "evidence_id",
        "topic",
        F.when(head == "", bare).otherwise(named).alias("title"),
        sample_summary(*[F.col(c) for c in ("title", "source", "tier", "rank", "seen_at", "excerpt")]).alias("summary"),
        analysis.alias("analysis"),
        event_id(F.array("evidence_id")).alias("event_id"),
    )


def level_sections(candidates: DataFrame, urgent: float = 80.0) -> DataFrame:
    """Candidates (level, score) by level: each level, empty ones too, with its place, count and how many reach urgent."""
    spark = candidates.sparkSession
    levels = spark.createDataFrame(list(enumerate(LEVEL_ORDER)), "section long, level string")
    counts = candidates.groupBy("level").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= urgent).alias("high"))
    return levels.join(counts, "level", "left").select("section", "level", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("high", F.lit(0)).alias("high"))


def merged_feed_items(grouped: DataFrame, admitted: DataFrame) -> DataFrame:
    """Feed items (seq, word, url, feed, title, published_at, entities) of groups, and of admitted ones those that are new.

    Items are the same by link, without one by feed, title and time. Grouped items all stay; the last of each takes
    entities from the first admitted one that has them, where it has none. New items come once, the first by seq, with
    the first entities known, in a group without a word.
    """
    link = F.trim(F.coalesce("url", F.lit("")))
    same = F.when(link != "", F.concat(F.lit("u "), link)).otherwise(F.concat(F.lit("t "), F.to_json(F.struct("feed", "title", "published_at"))))
    here, there = grouped.withColumn("_same", same), admitted.withColumn("_same", same)
    # the first of each, and the first entities, by partial aggregation
    new = there.groupBy("_same").agg(
        F.min_by(F.struct("seq", "url", "feed", "title", "published_at"), "seq").alias("x"), F.min_by("entities", F.when(F.col("entities").isNotNull(), F.col("seq"))).alias("known")
    )
    last = here.groupBy("_same").agg(F.max("seq").alias("_last"))
    filled = here.join(last, "_same").join(new.select("_same", "known"), "_same", "left")
    entities = F.when((F.col("seq") == F.col("_last")) & F.col("entities").isNull(), F.col("known")).otherwise(F.col("entities"))
    columns = ["seq", "word", "url", "feed", "title", "published_at", "entities"]
    added = new.join(last, "_same", "left_anti").select("x.seq", F.lit(None).cast("string").alias("word"), "x.url", "x.feed", "x.title", "x.published_at", F.col("known").alias("entities"))
    return filled.withColumn("entities", entities).select(*columns).unionByName(added)


def numbered_tags(tags: DataFrame, order: str, start: int = 1) -> DataFrame:
    """Tags without blank ones, trimmed, with priorities from start in order; a configured list is few rows, which one task numbers."""
    rows = tags.withColumn("tag", F.trim("tag")).where("tag <> ''")
    return rows.withColumn("priority", F.row_number().over(Window.orderBy(order)) + (start - 1))


def pattern_stats(files: DataFrame, patterns: dict[str, list[str]]) -> DataFrame:
    """(name, matches, files) over files (file, text): matches of each pattern's terms in any case, and files with one.

    Matches don't overlap; where several terms start at a place the longest counts, for every pattern that has it.
    """
    names: dict[str, list[str]] = {}
    for name, terms in patterns.items():
        for term in terms:
            names.setdefault(term.lower(), []).append(name)
    spark = files.sparkSession
    listed = spark.createDataFrame([(name,) for name in patterns], "name string")
    if not names:
        return listed.select("name", F.lit(0).cast("long").alias("matches"), F.lit(0).cast("long").alias("files"))
    pattern = "|".join(re.escape(t) for t in sorted(names, key=len, reverse=True))
    found = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(pattern), F.lit(0))
    terms = files.select("file", F.explode(found).alias("term")).groupBy("file", "term").agg(F.count("*").alias("n"))
    of = spark.createDataFrame([(t, n) for t, each in names.items() for n in each], "term string, name string")
    by_file = terms.join(of, "term").groupBy("name", "file").agg(F.sum("n").alias("n"))
    totals = by_file.groupBy("name").agg(F.sum("n").alias("matches"), F.count("*").alias("files"))
    return listed.join(totals, "name", "left").select("name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("matches", "files")])


def project_lifecycles(files: DataFrame, pattern: str) -> DataFrame:
    """Files (path, tool, modified) by project, which the pattern's first group names: count, first, last and tools.

    A project shows under an identifier made of its name, so that names stay private. Other paths don't count.
    """
    name = F.regexp_extract("path", pattern, 1)
    rows = files.select(name.alias("name"), "tool", "modified").where("name <> ''")
    label = F.concat(F.lit("project_"), F.substring(F.sha2("name", 256), 1, 16))
    return rows.groupBy(label.alias("project")).agg(
        F.count("*").alias("n"), F.min("modified").alias("first"), F.max("modified").alias("last"), F.array_sort(F.collect_set("tool")).alias("tools")
    )
