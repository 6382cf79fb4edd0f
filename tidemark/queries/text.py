"""Queries of text, links, markup, times and searches."""

from pyspark.sql import functions as F

from tidemark.functions import moments as M
from tidemark.functions import text as X
from tidemark.operators import search as S
from tidemark.queries.base import TITLES, query, table, titles
from tidemark.sources import feeds

SQL_TRACK = "(" + ", ".join(f"'{t}'" for t in X.TRACKING) + ")"


def pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


URL = f"""u AS (SELECT page_id, url, regexp_replace(url, '#.*$', '') AS bare FROM pages),
p AS (SELECT *, regexp_extract(bare, '^([^?]*)', 1) AS base, list_filter(string_split(regexp_extract(bare, '\\?(.*)$', 1), '&'), lambda p: p <> '') AS pieces FROM u),
v AS (SELECT *, list_filter(list_transform(pieces, lambda p, i: {{'name': url_decode(replace(regexp_extract(p, '^([^=]*)', 1), '+', ' ')), 'at': i,
    'value': url_decode(replace(regexp_extract(p, '^[^=]*=(.*)$', 1), '+', ' '))}}), lambda x: lower(x.name) NOT IN {SQL_TRACK}) AS kept FROM p),
n AS (SELECT page_id, url, CASE WHEN NOT regexp_matches(bare, '\\?.') THEN url WHEN len(kept) = 0 THEN base ELSE base || '?' ||
    replace(array_to_string(list_transform(list_sort(kept), lambda x: url_encode(x.name) || '=' || url_encode(x.value)), '&'), '%20', '+') END AS normal FROM v)"""


@query(f"WITH {URL} SELECT page_id, normal FROM n")
def normalize_url(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", X.normal_url(F.col("url")).alias("normal"))


@query(f"WITH {URL} SELECT normal, count(*) AS n, min(page_id) AS first FROM n GROUP BY 1")
def url_dedupe(spark, sf_dir):
    rows = pages(spark, sf_dir).withColumn("normal", X.normal_url(F.col("url")))
    return rows.groupBy("normal").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))


@query("SELECT lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) AS host, count(*) AS n, count(*) FILTER (starts_with(url, 'https://')) AS secure FROM pages GROUP BY 1")
def hosts(spark, sf_dir):
    return pages(spark, sf_dir).groupBy(X.url_host(F.col("url")).alias("host")).agg(F.count("*").alias("n"), F.count_if(F.col("url").startswith("https://")).alias("secure"))


@query("SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) AS digest FROM pages")
def clean_text(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", F.md5(X.without_tags(F.col("html"))).alias("digest"))


@query("SELECT page_id, substr(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), 1, 600) AS excerpt FROM pages")
def source_excerpt(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", X.excerpt(F.col("html")).alias("excerpt"))


@query("SELECT page_id, len(regexp_extract_all(html, '(?is)<a\\s[^>]*href=[\"'']([^\"'']+)[\"''][^>]*>(.*?)</a>', 1)) AS n FROM pages WHERE regexp_matches(html, '(?is)<a\\s[^>]*href=[\"'']([^\"'']+)[\"''][^>]*>(.*?)</a>')")
def page_links(spark, sf_dir):
    return feeds.links(pages(spark, sf_dir)).groupBy("page_id").agg(F.count("*").alias("n"))


@query("SELECT role, count(*) AS n, count(DISTINCT conv_id) AS conversations, min(turn) AS first_turn, max(turn) AS last_turn FROM conversations GROUP BY 1")
def role_counts(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("conversations"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


PATTERNS = {"digits": "[0-9]+", "questions": "[?]", "capitals": "[A-Z][a-z]+", "the": "(?i)the"}


@query("WITH c AS (SELECT conv_id, unnest([" + ", ".join(f"{{'category': '{k}', 'n': len(regexp_extract_all(text, '{p}'))}}" for k, p in PATTERNS.items()) + "], recursive := true) FROM conversations) SELECT category, CAST(sum(n) AS BIGINT) AS matches, count(DISTINCT conv_id) FILTER (n > 0) AS conversations FROM c GROUP BY 1")
def pattern_stats(spark, sf_dir):
    counts = [F.struct(F.lit(k).alias("category"), F.regexp_count("text", F.lit(p)).alias("n")) for k, p in PATTERNS.items()]
    each = table(spark, sf_dir, "conversations").select("conv_id", F.explode(F.array(*counts)).alias("x")).select("conv_id", "x.*")
    return each.groupBy("category").agg(F.sum("n").alias("matches"), F.countDistinct(F.when(F.col("n") > 0, F.col("conv_id"))).alias("conversations"))


#: Redactions without looking around: runs are found whole, and the edges of a number are put back, twice as two may share one.
EDGE = r"[^\p{L}\p{N}_]"
REDACT = r"trim(regexp_replace(text, '[\s\x0B\x1C-\x1F\x85\p{Z}]+', ' ', 'g'))"
for _p, _b in [
    *X.REDACTIONS[:5],
    ("[A-Za-z0-9_-]{32,}", "[redacted]"),
    *[(rf"(^|{EDGE})\p{{Nd}}{{8,}}($|{EDGE})", r"\1[redacted]\2")] * 2,
    (rf"\b[A-Z][a-z]+ [A-Z][a-z]+($|{EDGE})", r"[name]\1"),
    (r"[\x00-\x1f\x7f]", " "),
]:
    _p = _p.replace("'", "''")
    REDACT = f"regexp_replace({REDACT}, '{_p}', '{_b}', 'g')"


@query(f"WITH r AS (SELECT doc_id, {REDACT} AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 180 THEN rtrim(substr(t, 1, 177)) || '...' ELSE t END AS redacted FROM r")
def redaction(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.redacted(F.col("text")).alias("redacted"))


@query(f"WITH {TITLES} SELECT seq, 'event-v1:' || sha256('v1' || chr(31) || lower(trim(regexp_replace(title, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')))) AS event_key, 'ev_' || substr(sha256(trim(source_id) || chr(31) || trim(title)), 1, 16) AS evidence_id FROM ti")
def event_identity(spark, sf_dir):
    return titles(spark, sf_dir).select("seq", X.event_key(F.col("title")).alias("event_key"), X.stable_id("ev", F.col("source_id"), F.col("title")).alias("evidence_id"))


@query(f"WITH {TITLES} SELECT day, substr(sha256(array_to_string(list_sort(list_distinct(list(lower(trim(source_id))))), chr(10))), 1, 16) AS fingerprint FROM ti GROUP BY 1")
def platform_fingerprint(spark, sf_dir):
    return titles(spark, sf_dir).groupBy("day").agg(F.collect_set("source_id").alias("sources")).select("day", X.fingerprint_set(F.col("sources")).alias("fingerprint"))


STOP = "(" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + ")"


@query(f"WITH {TITLES} SELECT seq, array_to_string(list_filter(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) >= 2 AND w NOT IN {STOP}), ' ') AS words FROM ti")
def extract_keywords(spark, sf_dir):
    return titles(spark, sf_dir).select("seq", F.array_join(X.keywords(F.col("title")), " ").alias("words"))


CATEGORIES = {"sports": ["der", "las"], "people": ["the", "und"], "other": ["es"]}


@query(f"WITH {TITLES} SELECT seq, CASE " + " ".join(f"WHEN {' OR '.join(f"regexp_matches(title, '(?i)(^|[^A-Za-z0-9]){w}($|[^A-Za-z0-9])')" for w in ws)} THEN '{c}'" for c, ws in CATEGORIES.items()) + " END AS category FROM ti")
def content_category(spark, sf_dir):
    return titles(spark, sf_dir).select("seq", X.first_category(F.col("title"), CATEGORIES).alias("category"))


@query(f"WITH {TITLES} SELECT seq, source_id, 1.0::DOUBLE AS score FROM ti WHERE contains(lower(title), 'the') ORDER BY rank, seq LIMIT 50")
def search_keyword(spark, sf_dir):
    return S.page_of(S.by_keyword(titles(spark, sf_dir), "the"), [F.col("rank"), F.col("seq")], 50).select("seq", "source_id", "score")


@query(f"WITH {TITLES} SELECT seq, source_id FROM ti WHERE contains(title, 'The')")
def search_entity(spark, sf_dir):
    return S.by_entity(titles(spark, sf_dir), "The").select("seq", "source_id")


@query(f"WITH {TITLES} SELECT source_id, count(*) AS n, avg(rank) AS mean_rank FROM ti WHERE contains(lower(title), 'the') GROUP BY 1")
def search_platform_averages(spark, sf_dir):
    return S.platform_averages(S.by_keyword(titles(spark, sf_dir), "the"))


@query("""WITH r AS (SELECT doc_id AS seq, split_part(text, chr(10), 1) AS url, DATE '2024-01-01' + CAST(doc_id % 30 AS INT) AS day, text FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY day DESC, seq) AS k FROM r)
SELECT seq, CASE WHEN contains(lower(url), 'the') THEN 'title' ELSE 'summary' END AS match_in FROM k WHERE (k = 1 OR url = '') AND (contains(lower(url), 'the') OR contains(lower(text), 'the'))""")
def search_rss_dedupe(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("url"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).alias("day"), "text")
    return S.in_title_or_summary(S.newest_of_each_link(rows), "the", "url", "text").select("seq", "match_in")


@query()
def search_fuzzy(spark, sf_dir):
    return S.by_fuzzy(titles(spark, sf_dir), "the and attion to", 0.5).select("seq", "score")


REFERENCE = "The and attion to thanedble the, anea."
WORDS_OF = lambda text: f"list_distinct(list_filter(regexp_extract_all(lower(regexp_replace(regexp_replace({text}, 'https?://\\S+', '', 'g'), '\\[[^\\]]*\\]', '', 'g')), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) >= 2 AND w NOT IN {STOP}))"


@query(f"""WITH {TITLES}, w AS (SELECT seq, {WORDS_OF('title')} AS words, {WORDS_OF(f"'{REFERENCE}'")} AS wanted FROM ti WHERE title <> '{REFERENCE}'),
j AS (SELECT seq, len(list_intersect(words, wanted)) AS shared, len(list_distinct(list_concat(words, wanted))) AS whole FROM w) SELECT seq, shared / CAST(whole AS DOUBLE) AS score FROM j WHERE shared / CAST(whole AS DOUBLE) >= 0.1""")
def related_by_words(spark, sf_dir):
    """Titles by the Jaccard measure of keywords alone."""
    return S.related_by_keywords(titles(spark, sf_dir), REFERENCE, 0.1, 0.0).select("seq", "score")


@query()
def related_titles(spark, sf_dir):
    return S.related_by_keywords(titles(spark, sf_dir), "The and attion to thanedble the, anea.", 0.2).select("seq", "score")


@query()
def related_titles_by_text(spark, sf_dir):
    return S.related_by_text(titles(spark, sf_dir), "The and attion to thanedble the, anea.", 0.3).select("seq", "score")


@query()
def aggregate_similar(spark, sf_dir):
    rows = titles(spark, sf_dir).withColumn("weight", (100 - F.col("rank")).cast("double"))
    return S.merged_reports(rows, []).select("title", "n", F.size("sources").alias("platforms"), F.size("days").alias("days"))


@query("SELECT event_id, epoch(TIMESTAMP '2024-01-20') - epoch(date_trunc('second', ts)) <= 7 * 86400 AS fresh, (epoch(TIMESTAMP '2024-01-20') - epoch(date_trunc('second', ts))) / 86400.0 AS days_old FROM events")
def freshness(spark, sf_dir):
    now = F.lit("2024-01-20").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", M.is_fresh(F.col("ts"), now, 7).alias("fresh"), M.days_old(F.col("ts"), now).alias("days_old"))


@query("SELECT event_id, strftime(ts, '%H:%M') >= '23:00' OR strftime(ts, '%H:%M') < '08:00' AS quiet, CASE WHEN strftime(ts, '%H:%M') >= '23:00' THEN CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL 32 HOUR WHEN strftime(ts, '%H:%M') < '08:00' THEN CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL 8 HOUR END AS ends FROM events")
def quiet_hours(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", M.in_window(F.date_format("ts", "HH:mm"), "23:00", "08:00").alias("quiet"), M.window_end(F.col("ts"), "23:00", "08:00").alias("ends"))


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_fields(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", (F.get_json_object("props", "$.k").cast("long") % 10).alias("k"))
    return rows.groupBy("event_type", "k").agg(F.count("*").alias("n"))
