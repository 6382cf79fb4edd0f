"""Queries of sources: feeds and paged channels that the given tables make, ledgers and modes over them."""

from pyspark.sql import functions as F

from tidemark.operators import grouping as G
from tidemark.operators.paging import ordered_pages, scanned
from tidemark.operators.replay import replayed_entries
from tidemark.plans.scratch import cut, delete, new_path
from tidemark.queries.adapters import MARK, SPANS, VISIBLE, folded_and_new
from tidemark.queries.base import events, query, table
from tidemark.queries.entries import RULES, STATE, feed_entries, no_state
from tidemark.sources.xml_feeds import feed_items
from tidemark.streaming.ledger import Ledger, classify_pending

#: A document as a feed with an entry for each line: RSS, Atom or RDF by turns. Marks of markup and characters that XML
#: doesn't have become spaces.
SAFE = "regexp_replace(line, '[<>&\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', ' ', 'g')"


def feed_bodies(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "source")
    lines = F.split(F.regexp_replace("text", r"[<>&\x00-\x08\x0B\x0C\x0E-\x1F]", " "), "\n")
    at = lambda i: F.concat_ws("-", F.col("doc_id").cast("string"), i.cast("string"))
    title = lambda t, i: F.when(i % 4 == 3, "").otherwise(F.concat(F.lit("<title>"), t, F.lit("</title>")))
    rss = lambda t, i: F.concat(F.lit("<item>"), title(t, i), F.lit("<link>http://h/"), at(i), F.lit("</link><guid>g"), at(i), F.lit("</guid><description>"), t, F.lit("</description></item>"))
    atom = lambda t, i: F.concat(F.lit("<entry>"), title(t, i), F.lit('<link rel="self" href="s"/><link href="http://h/'), at(i), F.lit('"/><updated>2024-01-02T03:04:05Z</updated><summary>'), t, F.lit("</summary></entry>"))
    body = F.when(
        F.col("doc_id") % 3 == 0, F.concat(F.lit("<rss><channel>"), F.array_join(F.transform(lines, rss), ""), F.lit("</channel></rss>"))
    ).when(
        F.col("doc_id") % 3 == 1, F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), F.array_join(F.transform(lines, atom), ""), F.lit("</feed>"))
    ).otherwise(F.concat(F.lit("<rdf:RDF xmlns:rdf='r'><channel/>"), F.array_join(F.transform(lines, rss), ""), F.lit("</rdf:RDF>")))
    return docs.select(F.col("doc_id").cast("string").alias("feed_id"), body.alias("body"))


@query(f"""WITH ln AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS seq FROM documents),
c AS (SELECT doc_id, seq, trim(regexp_replace({SAFE}, '\\s+', ' ', 'g')) AS told, 'http://h/' || doc_id || '-' || seq AS url FROM ln)
SELECT CAST(doc_id AS VARCHAR) AS feed_id, seq, CASE WHEN told = '' THEN url WHEN seq % 4 = 3 THEN CASE WHEN length(told) > 20 THEN substr(told, 1, 20) || '...' ELSE told END ELSE told END AS title, url,
 CASE WHEN doc_id % 3 = 1 THEN url ELSE 'g' || doc_id || '-' || seq END AS guid, CASE WHEN doc_id % 3 = 1 THEN TIMESTAMP '2024-01-02 03:04:05' END AS published_at,
 CASE WHEN told = '' THEN NULL WHEN length(told) > 500 THEN substr(told, 1, 500) || '...' ELSE told END AS summary FROM c""")
def xml_feed_entries(spark, sf_dir):
    return feed_items(feed_bodies(spark, sf_dir)).drop("author").withColumn("seq", F.col("seq").cast("long"))


#: Pages of channels from events: a user's channel, whose pages lead from each to the next older; a few go astray.
PAGES = """pg AS (SELECT user_id AS feed_id, event_id AS page_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE user_id IS NOT NULL),
ch AS (SELECT feed_id, page_id, k, CASE WHEN k > 1 THEN 1000000 - (k - 1) * 10 END AS before, CASE WHEN feed_id % 7 = 3 AND k = 4 THEN 2000000 ELSE 1000000 - k * 10 END AS cursor FROM pg)"""


def channel_pages(spark, sf_dir):
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "events").where("user_id IS NOT NULL").select(F.col("user_id").alias("feed_id"), F.col("event_id").alias("page_id"), "value")
    k = F.row_number().over(Window.partitionBy("feed_id").orderBy("page_id"))
    rows = cut(rows.withColumn("k", k.cast("long")), "pages")
    before = F.when(F.col("k") > 1, 1_000_000 - (F.col("k") - 1) * 10)
    cursor = F.when((F.col("feed_id") % 7 == 3) & (F.col("k") == 4), 2_000_000).otherwise(1_000_000 - F.col("k") * 10)
    return rows.select("feed_id", "page_id", before.cast("long").alias("before"), cursor.cast("long").alias("cursor"), "k", "value")


@query(f"WITH {PAGES} SELECT feed_id, page_id, k - 1 AS place, feed_id % 7 = 3 AND k = 4 AS stuck FROM ch WHERE k <= CASE WHEN feed_id % 7 = 3 THEN 4 ELSE 10 END")
def page_order(spark, sf_dir):
    pages = channel_pages(spark, sf_dir)
    return ordered_pages(pages.drop("k", "value").repartition(8, "page_id")).select("feed_id", "page_id", F.col("place").cast("long").alias("place"), "stuck")


@query(f"""WITH {PAGES}, ok AS (SELECT * FROM ch WHERE k <= 10 AND NOT (feed_id % 7 = 3 AND feed_id IN (SELECT feed_id FROM ch WHERE k = 4))),
po AS (SELECT ok.feed_id, ok.page_id, k, 'u' || (e.event_id % 3) AS url, repeat('x', CAST(floor(abs(e.value)) AS INT) % 5) AS summary FROM ok JOIN events e ON e.event_id = ok.page_id),
b AS (SELECT *, row_number() OVER (PARTITION BY feed_id, url ORDER BY length(summary) DESC, k) AS n FROM po) SELECT feed_id, url, page_id, summary FROM b WHERE n = 1""")
def paged_scan(spark, sf_dir):
    """A post a page, its link one of three a channel: the longest summary of the first ten pages stays."""
    pages = channel_pages(spark, sf_dir)
    summary = F.expr("repeat('x', CAST(floor(abs(value)) AS INT) % 5)")
    posts = pages.select("page_id", F.lit(0).cast("long").alias("at"), F.concat(F.lit("u"), (F.col("page_id") % 3).cast("string")).alias("url"), summary.alias("summary"))
    return scanned(pages.drop("k", "value"), posts).select("feed_id", "url", "page_id", "summary")


@query(f"WITH {STATE} SELECT * FROM st")
def feed_replay(spark, sf_dir):
    """The entries of feed_upsert, put in one by one: days before the 20th, then the 20th."""
    rows = feed_entries(spark, sf_dir)
    state, _ = replayed_entries(no_state(spark), rows.where("batch < '2024-01-20'"))
    state, _ = replayed_entries(state, rows.where("batch = '2024-01-20'"))
    return state.drop("entry_id", "summary", "author")


def _ask(titles: list[tuple[int, str]]) -> list[tuple[int, int, float]]:
    """Stands for a classifier: a tag for each of three words that a text has."""
    return [(n, tag, 0.5 + 0.1 * tag) for n, t in titles for tag, word in enumerate(("the", "que", "und")) if word in (t or "")]


@query("""SELECT doc_id AS news_id, source AS kind, tag_id, 0.5::DOUBLE + 0.1::DOUBLE * tag_id AS score FROM documents, (VALUES (0, 'the'), (1, 'que')) AS w(tag_id, word)
WHERE contains(coalesce(text, ''), word) AND source IS NOT NULL""")
def ledger_results(spark, sf_dir):
    """Documents classified in two overlapping batches, the second a repeat in part; one of three tags is given up."""
    docs = table(spark, sf_dir, "documents").where("source IS NOT NULL").select(F.col("source").alias("kind"), F.col("doc_id").alias("news_id"), F.col("text").alias("title"))
    root = new_path(spark, "ledger")
    ledger = Ledger(spark, root)
    for some in (docs.where("news_id % 2 = 0"), docs):
        classify_pending(ledger, some, _ask, "interests", 1)
    tags = spark.createDataFrame([(0, "active"), (1, "active"), (2, "deprecated")], "tag_id long, status string")
    out = cut(ledger.results(tags, "interests", 1), "results").select("news_id", "kind", "tag_id", "score")
    delete(spark, [root])
    return out


TITLED = f"""{SPANS}, tt AS (SELECT source_id, item_id, arg_max(title, (batch, seq)) AS title FROM ev GROUP BY 1, 2),
be AS (SELECT source_id, item_id, min(rank) FILTER ({VISIBLE.replace('x', 'rank')}) AS best FROM h GROUP BY 1, 2),
tm AS (SELECT span.*, title, best, {MARK} AS is_new FROM span JOIN tt ON tt.source_id = span.source_id AND tt.item_id = span.item_id LEFT JOIN be ON be.source_id = span.source_id AND be.item_id = span.item_id WHERE last_time IS NOT NULL)"""


def _mode(where: str, new: str = "is_new") -> str:
    return f"""{TITLED}, m AS (SELECT *, {RULES.first_group_sql('title')} AS group_no FROM tm WHERE {where})
SELECT group_no, count(*) AS n, count(*) FILTER ({new}) AS n_new, min(best) AS best, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM m) AS percentage FROM m WHERE group_no IS NOT NULL GROUP BY 1"""


def keyword_mode(spark, sf_dir, mode, first_crawl=False):
    folded, new = folded_and_new(spark, sf_dir)
    last = events(spark, sf_dir).groupBy("source_id", "item_id").agg(F.max_by("title", F.struct("batch", "seq")).alias("title"))
    return G.counts_for_mode(folded.join(last, ["source_id", "item_id"]), new, RULES, mode, first_crawl)


@query(_mode("true"))
def keyword_daily(spark, sf_dir):
    return keyword_mode(spark, sf_dir, "daily")


@query(_mode("last_time = (SELECT max(last_time) FROM tm)"))
def keyword_current(spark, sf_dir):
    return keyword_mode(spark, sf_dir, "current")


@query(_mode("is_new", "true"))
def keyword_incremental(spark, sf_dir):
    return keyword_mode(spark, sf_dir, "incremental")


@query(_mode("true", "true"))
def keyword_first_crawl(spark, sf_dir):
    return keyword_mode(spark, sf_dir, "incremental", True)
