"""Ranked lists, feeds and pages as relations."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.moments import parsed
from tidemark.functions.text import unescaped, url_host, without_tags

RANKED = "status STRING, items ARRAY<STRUCT<title: STRING, url: STRING, mobileUrl: STRING>>"
JSON_FEED = (
    "version STRING, title STRING, items ARRAY<STRUCT<id: STRING, url: STRING, title: STRING, content_text: STRING, content_html: STRING, summary: STRING, "
    "date_published: STRING, date_modified: STRING, authors: ARRAY<STRUCT<name: STRING>>>>"
)


def ranked_items(responses: DataFrame) -> DataFrame:
    """(source_id, body) of JSON answers to (source_id, title, ranks, url, mobile_url).

    The place in a list, from 1, is the rank; a title that comes again adds a rank and keeps the first link. Blank
    titles are dropped, answers that are no success give nothing.
    """
    rows = responses.withColumn("parsed", F.from_json("body", RANKED)).where(F.col("parsed.status").isin("success", "cache"))
    each = rows.select("source_id", F.posexplode("parsed.items").alias("at", "item")).where(F.trim(F.coalesce("item.title", F.lit(""))) != "")
    return each.groupBy("source_id", F.trim("item.title").alias("title")).agg(
        F.array_sort(F.collect_list(F.col("at") + 1)).alias("ranks"), F.min_by("item.url", "at").alias("url"), F.min_by("item.mobileUrl", "at").alias("mobile_url")
    )


def on_domain(items: DataFrame, domains: DataFrame, url: str = "url") -> DataFrame:
    """Items of sources all of whose links are https and on the source's domain (source_id, domain) or one below it.

    A single other link rejects its whole source. Sources without a domain are not checked.
    """
    host = url_host(F.col(url))
    known = items.join(domains, "source_id", "left")
    linked = F.coalesce(F.col(url), F.lit("")) != ""
    fits = F.col(url).startswith("https://") & ((host == F.col("domain")) | F.endswith(host, F.concat(F.lit("."), F.col("domain"))))
    bad = known.where(F.col("domain").isNotNull() & linked & ~fits).select("source_id").distinct()
    return items.join(bad, "source_id", "left_anti")


def _first(*values: Column) -> Column:
    return F.coalesce(*[F.when(F.trim(v) != "", F.trim(v)) for v in values])


def json_feed_items(feeds: DataFrame) -> DataFrame:
    """(feed_id, body) of JSON Feeds to items; the title falls back to the text's start and the link."""
    rows = feeds.withColumn("parsed", F.from_json("body", JSON_FEED)).where(F.col("parsed.version").contains("jsonfeed.org"))
    each = rows.select("feed_id", F.posexplode("parsed.items").alias("at", "i"))
    start = F.when(F.length(F.trim("i.content_text")) > 0, F.concat(F.substring("i.content_text", 1, 20), F.lit("...")))
    return each.select(
        "feed_id",
        F.col("at").alias("seq"),
        _first(F.col("i.title"), start, F.col("i.url")).alias("title"),
        F.col("i.url").alias("url"),
        _first(F.col("i.id"), F.col("i.url")).alias("guid"),
        F.coalesce(parsed(F.col("i.date_published")), parsed(F.col("i.date_modified"))).alias("published_at"),
        F.substring(_first(F.col("i.summary"), F.col("i.content_text"), without_tags(unescaped(F.coalesce("i.content_html", F.lit(""))))), 1, 500).alias("summary"),
        F.array_join(F.transform("i.authors", lambda a: a["name"]), ", ").alias("author"),
    )


def rss_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS files by Spark's own XML reader; dates that are none are null."""
    schema = "title STRING, link STRING, guid STRING, pubDate STRING, description STRING, author STRING"
    rows = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)
    return rows.select(
        _first(F.col("title"), F.col("link")).alias("title"),
        F.col("link").alias("url"),
        _first(F.col("guid"), F.col("link")).alias("guid"),
        parsed(F.col("pubDate")).alias("published_at"),
        F.substring(without_tags(unescaped("description")), 1, 500).alias("summary"),
        "author",
    )


def first_of_feed(items: DataFrame, most: int) -> DataFrame:
    return items.where(F.col("seq") < most)


LINK = r"<a\s[^>]*href=[\"']([^\"']+)[\"'][^>]*>(.*?)</a>"


def links(pages: DataFrame, html: str = "html") -> DataFrame:
    """(page_id, at, href, label) of the links of a page, in order."""
    found = pages.withColumn("_hrefs", F.regexp_extract_all(html, F.lit(f"(?is){LINK}"), F.lit(1))).withColumn("_labels", F.regexp_extract_all(html, F.lit(f"(?is){LINK}"), F.lit(2)))
    each = found.select("page_id", F.posexplode(F.arrays_zip("_hrefs", "_labels")).alias("at", "x"))
    return each.select("page_id", "at", F.col("x._hrefs").alias("href"), without_tags(F.col("x._labels")).alias("label"))


def dated_listing(pages: DataFrame, base: str) -> DataFrame:
    """Links whose label has an English date such as 'Mar 4, 2024': (page_id, url, title, published_at), first of each url."""
    date = F.regexp_extract("label", r"((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{1,2}, \d{4})", 1)
    rows = links(pages).withColumn("_date", date).where("_date <> ''")
    url = F.when(F.col("href").startswith("/"), F.concat(F.lit(base), F.col("href"))).otherwise(F.col("href"))
    short = F.regexp_replace("_date", r"^([A-Z][a-z]{2})[a-z]*", "$1")
    rows = rows.select("page_id", "at", url.alias("url"), F.trim(F.regexp_replace(F.replace("label", F.col("_date"), F.lit(" ")), r"\s+", " ")).alias("title"), F.try_to_timestamp(short, F.lit("MMM d, yyyy")).alias("published_at"))
    first = rows.groupBy("page_id", "url").agg(F.min(F.struct("at", "title", "published_at")).alias("x"))
    return first.select("page_id", "url", "x.title", "x.published_at")


MESSAGES = "page_id long, post string, published_at string, text string, cursor long"


def messages(pages: DataFrame, pattern: str = r'data-post="([^"]+)".*?<time[^>]*datetime="([^"]+)".*?class="text"[^>]*>(.*?)</div>') -> DataFrame:
    """Posts of channel pages, parsed in tasks page by page; of a post seen again the longest text stays.

    Times without offset are dropped; cursor is the least place the page tells to go back to.
    """
    post = re.compile(pattern, re.S)
    before = re.compile(r'data-before="(\d+)"')

    def found_posts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for page, html in zip(frame["page_id"], frame["html"], strict=True):
                back = min(map(int, before.findall(html or "")), default=None)
                rows += [(page, p, t, re.sub(r"\s+", " ", re.sub("<[^>]+>", " ", x)).strip(), back) for p, t, x in post.findall(html or "") if re.search(r"(Z|[+-]\d\d:?\d\d)$", t)]
            yield pd.DataFrame(rows, columns=["page_id", "post", "published_at", "text", "cursor"]).astype({"cursor": "Int64"})

    found = pages.select("page_id", "html").mapInPandas(found_posts, MESSAGES)
    best = found.groupBy("post").agg(F.max_by(F.struct("published_at", "text", "cursor"), F.struct(F.length("text"), -F.col("page_id"))).alias("x"))
    return best.select("post", F.to_timestamp("x.published_at").alias("published_at"), "x.text", "x.cursor")


POSTS = "page_id long, at long, url string, owner string, text string, millis long, moment string"


def _inside(x: object, apart: tuple[str, ...]) -> Iterator[dict]:
    """The results that a timeline lists, without those that other posts quote or repeat."""
    rest = [x]
    while rest:
        x = rest.pop()
        if isinstance(x, dict):
            listed = x.get("tweet_results")
            if isinstance(listed, dict) and isinstance(listed.get("result"), dict):
                yield listed["result"]
            rest += [v for k, v in reversed(x.items()) if k not in apart]
        elif isinstance(x, list):
            rest += reversed(x)


def _at(x: object, path: str) -> object:
    for name in path.split("."):
        x = x.get(name) if isinstance(x, dict) else None
    return x


def embedded_posts(pages: DataFrame) -> DataFrame:
    """Posts (page_id, url, owner, text, published_at) in the JSON texts that scripts of a profile page (page_id, url, html) hold.

    Only the profile's own posts count, with an id of digits, a text and a time: milliseconds, or a date with an
    offset. Of a post seen again on a page the last one stays. Pages that aren't profiles have none.
    """
    literal = re.compile(r'\bvalue\s*:\s*("(?:[^"\\]|\\.)*")', re.S)
    script = re.compile(r"<script\b[^>]*>(.*?)</script\s*>", re.S | re.I)
    profile = re.compile(r"https://(?:x|twitter)\.com/(\w+)/?", re.A)
    apart = ("tweet_results", "quoted_tweet_results", "retweeted_status_result")

    def posts(url: str, html: str) -> Iterator[tuple]:
        handle = profile.fullmatch(url or "")
        for text in literal.findall("\n".join(script.findall(html or ""))) if handle else ():
            try:
                held = json.loads(json.loads(text))
            except (ValueError, RecursionError):
                continue
            for result in _inside(held, apart):
                post = result["tweet"] if isinstance(result.get("tweet"), dict) else result
                user = _at(post, "core.user_results.result")
                owner = _at(user, "core.screen_name") or _at(user, "legacy.screen_name")
                body = _at(post, "note_tweet.note_tweet_results.result.text") or _at(post, "details.full_text") or _at(post, "legacy.full_text")
                key, millis = str(_at(post, "rest_id") or ""), _at(post, "details.created_at_ms") or _at(post, "legacy.created_at_ms")
                moment = _at(post, "details.created_at") or _at(post, "legacy.created_at")
                if str(owner or "").lower() == handle[1].lower() and re.fullmatch("[0-9]+", key) and isinstance(body, str):
                    whole = int(millis) if re.fullmatch("-?[0-9]{1,15}", str(millis)) else None
                    yield f"https://x.com/{handle[1]}/status/{key}", handle[1], body, whole, None if millis is not None else str(moment)

    def found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(page, at, *post) for page, url, html in zip(frame["page_id"], frame["url"], frame["html"], strict=True) for at, post in enumerate(posts(url, html))]
            yield pd.DataFrame(rows, columns=["page_id", "at", "url", "owner", "text", "millis", "moment"]).astype({"millis": "Int64", "at": "int64"})

    rows = pages.select("page_id", "url", "html").mapInPandas(found, POSTS)
    # dates such as 'Wed Mar 13 08:00:00 +0000 2024' or 'Wed, 13 Mar 2024 08:00:00 +0000'
    one = F.regexp_extract("moment", r"^\w{3} (\w{3} \d{1,2} [\d:]{8} [+-]\d{4} \d{4})$", 1)
    other = F.regexp_extract("moment", r"^(?:\w{3}, )?(\d{1,2} \w{3} \d{4} [\d:]{8} [+-]\d{4})$", 1)
    dated = F.coalesce(F.try_to_timestamp(one, F.lit("MMM d HH:mm:ss Z yyyy")), F.try_to_timestamp(other, F.lit("d MMM yyyy HH:mm:ss Z")))
    rows = rows.withColumn("published_at", F.coalesce(F.timestamp_millis("millis"), dated)).where("published_at IS NOT NULL")
    last = rows.groupBy("page_id", "url").agg(F.max_by(F.struct("owner", "text", "published_at"), "at").alias("x"))
    return last.select("page_id", "url", "x.owner", "x.text", "x.published_at")


def fetched(spark: SparkSession, ids: list[str], fetch: Callable[[str], str | None]) -> DataFrame:
    """(source_id, body) by a callable, one task for each source; None is a failed source, whose body is null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"source_id": frame["source_id"], "body": [fetch(x) for x in frame["source_id"]]})

    table = spark.createDataFrame([(x,) for x in ids], "source_id string").repartition(max(1, len(ids)), "source_id")
    return table.mapInPandas(run, "source_id string, body string")
