"""RSS, RDF and Atom feeds as entries, by Spark's own XML parser."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.moments import parsed
from tidemark.functions.text import unescaped, without_tags
from tidemark.sources.feeds import json_feed_items

TEXT = "STRUCT<_VALUE: STRING, _type: STRING>"
ENTRY = (
    f"STRUCT<title: {TEXT}, link: ARRAY<STRUCT<_VALUE: STRING, _href: STRING, _rel: STRING, _type: STRING>>, id: STRING, guid: STRUCT<_VALUE: STRING>, "
    "pubDate: STRING, published: STRING, updated: STRING, `dc:date`: STRING, "
    f"description: STRING, summary: {TEXT}, content: ARRAY<{TEXT}>, `content:encoded`: STRING, author: ARRAY<STRUCT<_VALUE: STRING, name: STRING>>, `dc:creator`: STRING>"
)
#: RSS has its items in a channel, RDF beside it, and Atom has entries; a feed is of one of these shapes.
FEED = f"STRUCT<channel: STRUCT<item: ARRAY<{ENTRY}>>, item: ARRAY<{ENTRY}>, entry: ARRAY<{ENTRY}>>"
OPTIONS = {"attributePrefix": "_", "valueTag": "_VALUE"}
TITLE_START, SUMMARY_MOST = 20, 500


def _given(value: Column) -> Column:
    """The trimmed text, null if blank."""
    return F.nullif(F.trim(value), F.lit(""))


def _clean(value: Column) -> Column:
    return F.nullif(without_tags(unescaped(F.coalesce(value, F.lit("")))), F.lit(""))


def _cut(value: Column, most: int) -> Column:
    return F.when(F.length(value) > most, F.concat(F.substring(value, 1, most), F.lit("..."))).otherwise(value)


def entry_link(links: Column) -> Column:
    """The link of an entry: the text of one that has text, as in RSS, or else the address of the first that is an alternate
    (as one is that doesn't say), then of the first to HTML, then of the first."""
    href = lambda some: F.get(F.transform(some, lambda x: x["_href"]), F.lit(0))
    has = F.filter(links, lambda x: _given(x["_href"]).isNotNull())
    alternate = F.filter(has, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    to_html = F.filter(has, lambda x: F.coalesce(x["_type"], F.lit("")).startswith("text/html"))
    text = F.get(F.filter(F.transform(links, lambda x: _given(x["_VALUE"])), lambda t: t.isNotNull()), F.lit(0))
    return F.coalesce(text, href(alternate), href(to_html), href(has))


def xml_feed_items(feeds: DataFrame) -> DataFrame:
    """(feed_id, body) of RSS, RDF and Atom feeds to items (feed_id, seq, title, url, guid, published_at, summary, author).

    Texts lose their markup. A title that is missing is the start of the summary, or else the link; an entry without any
    of these is left out. The summary is the first of summary, description, content that is there; guid the id, or the
    link; the time that of publication, or else of the last change, null where it is none. Bodies that are no XML or no
    feed, null and empty ones give nothing: broken_feeds() names them. Markup that isn't escaped inside a text, as in XHTML
    content, isn't read.
    """
    rows = feeds.select("feed_id", F.from_xml(F.trim("body"), FEED, OPTIONS).alias("x"))
    each = rows.select("feed_id", F.posexplode(F.coalesce("x.channel.item", "x.item", "x.entry")).alias("seq", "e"))
    content = F.get(F.transform("e.content", lambda c: c["_VALUE"]), F.lit(0))
    told = F.coalesce(_given(F.col("e.summary._VALUE")), _given(F.col("e.description")), _given(content), _given(F.col("e.`content:encoded`")))
    names = F.array_join(F.filter(F.transform("e.author", lambda a: F.coalesce(_given(a["name"]), _given(a["_VALUE"]))), lambda n: n.isNotNull()), ", ")
    out = each.select("feed_id", "seq", "e", entry_link(F.col("e.link")).alias("url"), _clean(told).alias("told"))
    return out.select(
        "feed_id",
        "seq",
        F.coalesce(_clean(F.col("e.title._VALUE")), _cut(F.col("told"), TITLE_START), "url").alias("title"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce(_given(F.col("e.id")), _given(F.col("e.guid._VALUE")), "url").alias("guid"),
        F.coalesce(*[parsed(_given(F.col(c))) for c in ("e.pubDate", "e.published", "e.`dc:date`", "e.updated")]).alias("published_at"),
        _cut(F.col("told"), SUMMARY_MOST).alias("summary"),
        F.coalesce(_clean(F.nullif(names, F.lit(""))), _clean(F.col("e.`dc:creator`"))).alias("author"),
    ).where("title IS NOT NULL")


def _is_json(body: Column) -> Column:
    """Whether a body says that it is a JSON Feed."""
    return F.coalesce(F.trim(body).startswith("{") & F.get_json_object(body, "$.version").contains("jsonfeed.org"), F.lit(False))


def feed_items(feeds: DataFrame) -> DataFrame:
    """Items of feeds (feed_id, body) of any kind: JSON Feeds by what they say of themselves, all others as XML."""
    json, xml = feeds.where(_is_json(F.col("body"))), feeds.where(~_is_json(F.col("body")))
    return xml_feed_items(xml).unionByName(json_feed_items(json).select("feed_id", "seq", "title", F.coalesce("url", F.lit("")).alias("url"), "guid", "published_at", "summary", "author").where("title IS NOT NULL"))


def broken_feeds(feeds: DataFrame) -> DataFrame:
    """feed_id of bodies in which no feed can be found; one that has a channel without items isn't broken."""
    x = F.from_xml(F.trim("body"), FEED, OPTIONS)
    found = F.coalesce(x["channel"].isNotNull() | x["item"].isNotNull() | x["entry"].isNotNull(), F.lit(False))
    return feeds.where(~_is_json(F.col("body")) & ~found).select("feed_id")


def newest_of_feed(items: DataFrame, most: int) -> DataFrame:
    """The first most items of each feed in its own order; 0 means all."""
    return items.where(F.col("seq") < most) if most > 0 else items
