"""Candidates from clusters of items: identity, display, scores and decisions, as one plan over the items."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.entities import entities, is_specific
from tidemark.functions.reader import about_games
from tidemark.functions.text import normal_title
from tidemark.operators import scoring
from tidemark.operators.cluster import clustered
from tidemark.operators.scoring import Coverage
from tidemark.plans.scratch import cut

SALT = "pr9c"


def _digests(salt: str):
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts sorted by (cluster, kind, value), one after the other through a digest: nothing of a cluster is kept."""
        own, sha, parts, done = None, None, 0, []
        for batch in batches:
            for cluster, kind, value, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if cluster != own or sha is None:
                    if sha is not None:
                        done.append((own, sha.hexdigest()[:12], parts))
                    own, sha, parts, named = cluster, hashlib.sha1(f"{salt}:".encode()), 0, False
                named |= kind < 2
                if kind == 2 and named:
                    continue
                for _ in range(times if kind == 2 else 1):
                    sha.update((b"||" if parts else b"") + value.encode())
                    parts += 1
            if done:
                yield _rows(done)
                done = []
        if sha is not None:
            yield _rows([(own, sha.hexdigest()[:12], parts)])

    def _rows(done: list[tuple]) -> pa.RecordBatch:
        cluster, name, parts = zip(*done, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(cluster, pa.int64()), pa.array(name, pa.string()), pa.array(parts, pa.int64())], ["cluster", "candidate_id", "key_parts"])

    return digests


def identities(items: DataFrame, salt: str = SALT, listed_first: bool = False) -> DataFrame:
    """(cluster, candidate_id, key_parts) of items (cluster, title, url, kind, source_id, feed_id, source_name, keyword_group).

    A cluster's key is its distinct normal titles in order and then its distinct links in order, joined by two bars; one
    without any of these has what is known of its items' sources instead. candidate_id is the first 12 digits of the
    SHA-1 of salt, colon and key; key_parts says how many parts the key has. With listed_first a cluster with items of
    ranked lists is named by those alone. Parts are made distinct before the shuffle, sorted, and run through the digest
    one by one, so a cluster of any size takes no more memory than another.
    """
    rows = items.select("cluster", "title", "url", "kind", F.coalesce("source_id", F.lit("")).alias("source_id"), F.coalesce("feed_id", F.lit("")).alias("feed_id"), F.coalesce("source_name", F.lit("")).alias("source_name"), F.coalesce("keyword_group", F.lit("")).alias("keyword_group"))
    if listed_first:
        listed = rows.where("kind = 'hotlist'").select("cluster").distinct().withColumn("_listed", F.lit(True))
        rows = rows.join(listed, "cluster", "left").where("_listed IS NULL OR kind = 'hotlist'").drop("_listed")
    no_title, no_url = (F.coalesce(c, F.lit("")) == "" for c in ("title", "url"))
    part = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    source = F.concat_ws(":", *[F.nullif(F.col(c), F.lit("")) for c in ("kind", "source_id", "feed_id", "source_name", "keyword_group")])
    parts = F.array_compact(F.array(F.when(~no_title, part(0, normal_title(F.col("title")))), F.when(~no_url, part(1, F.col("url"))), F.when(no_title & no_url, part(2, source))))
    each = rows.select("cluster", F.explode(parts).alias("p")).select("cluster", "p.kind", "p.value").groupBy("cluster", "kind", "value").agg(F.count("*").alias("times"))
    ordered = each.repartition("cluster").sortWithinPartitions("cluster", "kind", "value")
    return ordered.mapInArrow(_digests(salt), "cluster long, candidate_id string, key_parts long")


def with_feed_items(items: DataFrame, common: list[str], least_shared: int = 2, least_specific: int = 2) -> DataFrame:
    """items (cluster, seq, kind, rank, best_rank, title) where clusters of feed items alone join that of a list's item.

    Of such a cluster the first feed item decides that shares enough entities, enough of them specific, with an item of
    a ranked list: it goes to the one with most specific ones in common, then the better rank, then the first. A cluster
    with a list's item stays, so a feed item never connects two of them. Items with equal entities count as one, that
    with the best rank, before they meet by their specific entities.
    """
    listed = items.where("kind = 'hotlist'").select("cluster").distinct()
    with_entities = items.select("cluster", "seq", "kind", F.coalesce("rank", "best_rank", F.lit(1_000_000_000)).cast("long").alias("place"), entities(F.col("title")).alias("entities")).where("size(entities) > 0")
    hot = with_entities.where("kind = 'hotlist'").groupBy("entities").agg(F.min(F.struct("place", "seq", "cluster")).alias("hot"))
    feed = with_entities.where("kind = 'rss'").join(listed, "cluster", "left_anti").groupBy("cluster", "entities").agg(F.min("seq").alias("seq"))
    told = lambda c: F.filter(c, lambda e: is_specific(e, common))
    hot = cut(hot.withColumn("told", told("entities")).where(F.size("told") >= least_specific), "hot-entities")
    feed = cut(feed.withColumn("told", told("entities")).where(F.size("told") >= least_specific), "feed-entities")
    pairs = feed.select("cluster", "seq", F.col("entities").alias("ours"), F.col("told").alias("our_told"), F.explode("told").alias("e")).join(hot.select("hot", F.col("entities").alias("theirs"), F.col("told").alias("their_told"), F.explode("told").alias("e")), "e")
    pairs = pairs.where(F.col("e") == F.array_min(F.array_intersect("our_told", "their_told")))  # each pair once
    shared, specific = F.size(F.array_intersect("ours", "theirs")), F.size(F.array_intersect("our_told", "their_told"))
    fit = pairs.where((shared >= least_shared) & (specific >= least_specific)).withColumn("key", F.struct("seq", (-specific).alias("few"), "hot.place", F.col("hot.seq").alias("hot_seq")))
    into = fit.groupBy("cluster").agg(F.min_by("hot.cluster", "key").alias("_into"))
    return items.join(into, "cluster", "left").withColumn("cluster", F.coalesce("_into", "cluster")).drop("_into")


def display_key() -> Column:
    """Order of a cluster's items for display: lists first, then the better current rank, known rank, higher count, title, link, source."""
    kind = F.when(F.col("kind") == "hotlist", 0).when(F.col("kind") == "rss", 1).otherwise(2)
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    count = F.when(F.col("has_count"), F.coalesce("count", F.lit(0))).otherwise(0)
    return F.struct(
        kind.alias("a"), F.col("rank").isNull().alias("b"), F.coalesce("rank", F.lit(0)).alias("c"), F.col("best_rank").isNull().alias("d"), F.coalesce("best_rank", F.lit(0)).alias("e"),
        (-count).alias("f"), normal_title(F.col("title")).alias("g"), text("url"), text("source_id"), text("source_name"), text("title"),
    )


def displayed(items: DataFrame) -> DataFrame:
    """(cluster, display_title, representative_url): the first title by display_key, and the least link of items with just
    that title, or else of all; null without links."""
    best = items.groupBy("cluster").agg(F.min_by("title", display_key()).alias("display_title"), F.min(F.nullif("url", F.lit(""))).alias("_any"))
    own = items.select("cluster", "title", F.nullif("url", F.lit("")).alias("_url")).where("_url IS NOT NULL").join(best, "cluster").where(F.col("title").eqNullSafe(F.col("display_title")))
    least = own.groupBy("cluster").agg(F.min("_url").alias("_own"))
    return best.join(least, "cluster", "left").select("cluster", "display_title", F.coalesce("_own", "_any").alias("representative_url"))


@dataclass(frozen=True)
class Settings:
    """What a run of the pipeline is asked for."""

    coverage: Coverage = field(default_factory=Coverage)
    trusted: bool = True
    first_crawl: bool = False
    attach_feeds: bool = False
    common: tuple[str, ...] = ()
    drop_unmerged_feeds: bool = False
    no_games: bool = False
    alert: float = 60.0
    urgent: float = 80.0


def decide(items: DataFrame, settings: Settings | None = None) -> DataFrame:
    """From items to decisions: one row for each candidate.

    items are (seq, title, url, tier, cross_admitted, ...) with the columns that adapters.list_items and feed_items give.
    They are clustered by titles, links and tokens, and if asked feed items attach by entities; each cluster gets its
    identity, what to display, its scores and its level, and fresh: whether this run observed one of its items (column
    observed; without it all count as observed). Candidates only of feed items that were admitted for support
    leave, if asked, where they support nothing; those about games, if the reader wants none, are suppressed.

    The items with their clusters are one table, written once, which identities, display and scores read.
    """
    settings = settings or Settings()
    rows = clustered(items)
    if settings.attach_feeds:
        rows = with_feed_items(cut(rows, "clustered"), list(settings.common))
    rows = cut(rows, "items-of-clusters", "zstd")
    scored = scoring.candidate_scores(rows, "cluster", settings.coverage, settings.trusted, settings.first_crawl)
    named = identities(rows, listed_first=settings.attach_feeds)
    out = scored.join(named, "cluster").join(displayed(rows), "cluster")
    if "observed" in items.columns:
        out = out.join(rows.groupBy("cluster").agg(F.bool_or(F.coalesce("observed", F.lit(False))).alias("fresh")), "cluster")
    else:
        out = out.withColumn("fresh", F.lit(True))
    if settings.drop_unmerged_feeds:
        support = rows.groupBy("cluster").agg((F.bool_and(F.col("kind") == "rss") & F.bool_and(F.coalesce("cross_admitted", F.lit(False)))).alias("_support"))
        out = out.join(support, "cluster").where("NOT _support").drop("_support")
    wish = F.lit(False)
    if settings.no_games:
        games = rows.groupBy("cluster").agg(F.bool_or(about_games(F.col("title"))).alias("by_wish"))
        out, wish = out.join(games, "cluster"), F.col("by_wish")
    else:
        out = out.withColumn("by_wish", F.lit(False))
    return scoring.decided(out, wish, settings.alert, settings.urgent)
