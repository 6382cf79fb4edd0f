"""Pages of a channel that were fetched by going back from cursor to cursor, put in order and merged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.scratch import cut

MOST_PAGES = 10


def ordered_pages(pages: DataFrame, most: int = MOST_PAGES) -> DataFrame:
    """pages (feed_id, page_id, before, cursor) in whatever order, with place from 0 and stuck.

    A feed's first page has no before; the page after one is that whose before is its cursor, the least page_id if there
    are several. Places come from pointer jumping: each page knows which page is 1, 2, 4, ... pages before it, so most
    pages take as many joins as most has binary digits. Pages that the first doesn't lead to, and those from the most-th
    on, are left out. A page is stuck, and the scan of its feed failed, if its cursor isn't below the one it was asked
    with.
    """
    if not 1 <= most <= MOST_PAGES:
        raise ValueError(f"pages must be between 1 and {MOST_PAGES}")
    least = lambda rows, *by: rows.groupBy(*by).agg(F.min("page_id").alias("page_id"), F.min_by("cursor", "page_id").alias("cursor"))
    heads = cut(least(pages.where("before IS NULL"), "feed_id").withColumn("before", F.lit(None).cast("long")), "heads")
    nodes = cut(heads.unionByName(least(pages.where("before IS NOT NULL"), "feed_id", "before")), "pages")
    ahead = nodes.where("cursor IS NOT NULL").groupBy("feed_id", F.col("cursor").alias("before")).agg(F.min("page_id").alias("back"))
    known = nodes.join(ahead, ["feed_id", "before"], "left").select("feed_id", "page_id", F.coalesce("back", "page_id").alias("back"), F.when(F.col("back").isNull(), 0).otherwise(1).alias("place"))
    for _ in range((most - 1).bit_length()):
        known = cut(known, "jumps")
        of = known.select("feed_id", F.col("page_id").alias("back"), F.col("back").alias("_back"), F.col("place").alias("_more"))
        known = known.join(of, ["feed_id", "back"]).select("feed_id", "page_id", F.col("_back").alias("back"), (F.col("place") + F.col("_more")).alias("place"))
    reached = known.join(heads.select("feed_id", F.col("page_id").alias("back")), ["feed_id", "back"], "left_semi").where(F.col("place") < most)
    stuck = F.coalesce(F.col("cursor") >= F.col("before"), F.lit(False)).alias("stuck")
    return reached.join(nodes, ["feed_id", "page_id"]).select("feed_id", "page_id", "place", "before", "cursor", stuck)


def scanned(pages: DataFrame, posts: DataFrame, most: int = MOST_PAGES) -> DataFrame:
    """Posts (page_id, at, url, summary, published_at, ...) of the ordered pages of feeds, one row a link.

    Of a link's posts that with the longest summary stays; of equally long ones the one on the first page, there the last,
    on later pages the first. Feeds with a stuck page give nothing: their scan failed. A null summary is empty.
    """
    placed = ordered_pages(pages, most)
    failed = placed.where("stuck").select("feed_id").distinct()
    rows = posts.join(placed.join(failed, "feed_id", "left_anti").select("feed_id", "page_id", "place"), "page_id")
    at = F.when(F.col("place") == 0, F.col("at")).otherwise(-F.col("at"))
    # On the first page the last of a link's posts stands; its summary then competes with those of later pages.
    head = rows.where("place = 0").withColumn("_at", at).groupBy("feed_id", "url").agg(F.max("_at").alias("_at"))
    kept = rows.withColumn("_at", at).join(head.withColumnRenamed("_at", "_last"), ["feed_id", "url"], "left").where("place > 0 OR _at = _last")
    key = F.struct(F.length(F.coalesce("summary", F.lit(""))).alias("a"), (-F.col("place")).alias("b"), F.col("_at").alias("c"))
    columns = [c for c in posts.columns if c != "url"]
    best = kept.groupBy("feed_id", "url").agg(F.max_by(F.struct(*columns, "place"), key).alias("x"))
    return best.select("feed_id", "url", "x.*")
