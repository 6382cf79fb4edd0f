"""Queries of entities, identities, addresses and times of the given tables' texts."""

from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions.entities import NO_NAMES, entities, is_specific
from tidemark.functions.moments import time_for_reader
from tidemark.plans.rules import parse_rules
from tidemark.queries.base import TITLES, query, table, titles
from tidemark.queries.text import SQL_TRACK

LOW_NAMES = "(" + ", ".join(f"'{n}'" for n in NO_NAMES) + ")"
IS_MODEL = "regexp_matches(t, '^[A-Za-z0-9.\\-]{2,}$') AND regexp_matches(t, '[A-Za-z]') AND regexp_matches(t, '[0-9]')"
ENTITIES = f"""{TITLES}, e1 AS (SELECT seq, regexp_extract_all(title, '\\$\\p{{Nd}}[\\p{{Nd}},]*(?:\\.\\p{{Nd}}+)?') AS amounts, regexp_replace(title, '\\$\\p{{Nd}}[\\p{{Nd}},]*(?:\\.\\p{{Nd}}+)?', ' ', 'g') AS rest FROM ti),
e2 AS (SELECT seq, amounts, regexp_extract_all(rest, '\\p{{Nd}}{{1,3}}-\\p{{Nd}}{{1,3}}') AS results, regexp_replace(rest, '\\p{{Nd}}{{1,3}}-\\p{{Nd}}{{1,3}}', ' ', 'g') AS rest FROM e1),
e3 AS (SELECT seq, amounts, results, list_filter(regexp_extract_all(rest, '\\p{{Nd}}+%'), lambda x: NOT regexp_matches(x, '^0*[01]?%$')) AS shares, regexp_replace(rest, '\\p{{Nd}}+%', ' ', 'g') AS rest FROM e2),
e4 AS (SELECT *, regexp_extract_all(rest, '[A-Za-z0-9][A-Za-z0-9.\\-]*[A-Za-z0-9]|[A-Za-z0-9]|[^A-Za-z0-9]+') AS tokens FROM e3),
e5 AS (SELECT seq, amounts, results, shares, list_transform(list_filter(tokens, lambda t: {IS_MODEL}), lambda t: lower(t)) AS models, array_to_string(list_transform(tokens, lambda t: CASE WHEN {IS_MODEL} THEN ' ' ELSE t END), '') AS rest FROM e4),
en AS (SELECT seq, list_sort(list_distinct(list_concat(list_transform(amounts, lambda x: replace(x, ',', '')), results, shares, models, list_filter(regexp_extract_all(rest, '\\p{{Nd}}{{3,}}'), lambda x: NOT regexp_matches(x, '^0*(?:19[0-9][0-9]|20[0-9][0-9]|2100)$')),
 list_filter(list_transform(regexp_extract_all(rest, '[A-Z][A-Za-z][A-Za-z]+'), lambda x: lower(x)), lambda x: x NOT IN {LOW_NAMES})))) AS entities FROM e5)"""
COMMON = ["the", "que", "les", "und", "der"]


@query(f"WITH {ENTITIES} SELECT seq, array_to_string(entities, ' ') AS entities FROM en")
def title_entities(spark, sf_dir):
    return titles(spark, sf_dir).select("seq", F.array_join(entities(F.col("title")), " ").alias("entities"))


@query(f"WITH {ENTITIES}, x AS (SELECT unnest(entities) AS entity FROM en) SELECT entity, count(*) AS n, regexp_matches(entity, '\\p{{Nd}}|^\\$|%$') OR entity NOT IN ({', '.join(f"'{c}'" for c in COMMON)}) AS telling FROM x WHERE entity <> '' GROUP BY 1")
def specific_entities(spark, sf_dir):
    each = titles(spark, sf_dir).select(F.explode(entities(F.col("title"))).alias("entity")).where("entity <> ''").groupBy("entity").agg(F.count("*").alias("n"))
    return each.withColumn("telling", is_specific(F.col("entity"), COMMON))


#: Addresses of pages with a platform's own parameters, bad escapes, repeated and empty names.
TOUCHED = "url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_source=x&Refer=top&t=3&k=%zz%41+b&flag&k=1&page=' || (page_id % 7)"
ON = "CASE WHEN page_id % 2 = 0 THEN 'weibo' ELSE 'other' END"


@query(f"""WITH u AS (SELECT page_id, {TOUCHED} AS whole, page_id % 2 = 0 AS weibo, regexp_replace({TOUCHED}, '#.*$', '') AS bare FROM pages),
p AS (SELECT *, regexp_extract(bare, '^([^?]*)', 1) AS base, list_filter(string_split(regexp_extract(bare, '\\?(.*)$', 1), '&'), lambda p: p <> '') AS pieces FROM u),
v AS (SELECT *, list_filter(list_transform(pieces, lambda p, i: {{'name': url_decode(replace(regexp_extract(p, '^([^=]*)', 1), '+', ' ')), 'at': i, 'value': url_decode(replace(replace(regexp_extract(p, '^[^=]*=(.*)$', 1), '+', ' '), '%zz', '%25zz'))}}),
  lambda x: lower(x.name) NOT IN {SQL_TRACK} AND NOT (weibo AND lower(x.name) IN ('band_rank', 'refer', 't'))) AS kept FROM p)
SELECT page_id, CASE WHEN bare NOT LIKE '%?_%' THEN whole ELSE base || '?' || replace(array_to_string(list_transform(list_sort(kept), lambda x: url_encode(x.name) || '=' || url_encode(x.value)), '&'), '%20', '+') END AS normal FROM v""")
def platform_urls(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").selectExpr("page_id", f"{TOUCHED} AS url", f"{ON} AS platform")
    return rows.select("page_id", X.normal_url(F.col("url"), F.col("platform")).alias("normal"))


@query("""WITH u AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS head, regexp_replace(regexp_replace(url, '#.*$', ''), '^[a-z]+://[^/?#]*', '') AS tail FROM pages)
SELECT page_id, lower(head) || tail AS normal, substr(sha256(array_to_string(list_sort(list_distinct([lower(head) || tail, lower(head) || '/x' || (page_id % 3)])), chr(10))), 1, 16) AS fingerprint FROM u""")
def event_urls(spark, sf_dir):
    """Each page's address with a loud host, a fragment and blanks around it, and the set it makes with others."""
    rows = table(spark, sf_dir, "pages").withColumn("head", F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1))
    loud = F.concat(F.lit(" \t"), F.upper("head"), F.substr("url", F.length("head") + 1), F.lit("#part \n"))
    other = F.concat("head", F.lit("/x"), (F.col("page_id") % 3).cast("string"))
    urls = F.array(loud, F.col("url"), other, F.concat(other, F.lit("#y")), F.lit(" "), F.lit(None).cast("string"))
    return rows.select("page_id", X.event_url(loud).alias("normal"), X.url_fingerprint(urls).alias("fingerprint"))


TRIM = lambda c: f"regexp_replace(coalesce({c}, ''), '^[\\s\\x0B\\x{{85}}\\x{{A0}}]+|[\\s\\x0B\\x{{85}}\\x{{A0}}]+$', '', 'g')"


@query(f"""WITH {TITLES}, k AS (SELECT seq, CASE seq % 4 WHEN 0 THEN ' HotList ' WHEN 1 THEN 'rss' WHEN 2 THEN '' ELSE 'Feed' END AS kind, source_id, lang, title, CASE WHEN seq % 3 = 0 THEN 'http://x/' || seq ELSE '' END AS url FROM ti),
l AS (SELECT *, CASE WHEN kind = '' THEN 'unknown' ELSE lower(trim(kind)) END AS low FROM k)
SELECT seq, low || chr(31) || trim(CASE WHEN low = 'hotlist' THEN source_id ELSE lang END) || chr(31) || CASE WHEN low = 'rss' AND url <> '' THEN url ELSE {TRIM('title')} END AS identity FROM l""")
def item_identities(spark, sf_dir):
    kind = F.element_at(F.array(F.lit(" HotList "), F.lit("rss"), F.lit(""), F.lit("Feed")), (F.col("seq") % 4 + 1).cast("int"))
    url = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("http://x/"), F.col("seq").cast("string"))).otherwise("")
    return titles(spark, sf_dir).select("seq", X.item_identity(kind, F.concat(F.lit(" "), "source_id"), F.col("lang"), F.col("title"), url).alias("identity"))


ADDRESS = "CASE doc_id % 7 WHEN 0 THEN 'https://t.me/s/' || source || '/' WHEN 1 THEN 'https://t.me/' || source WHEN 2 THEN 'https://www.x.com/' || source WHEN 3 THEN 'HTTPS://TWITTER.com/' || source || '?lang=' || lang WHEN 4 THEN 'http://x.com/' || source WHEN 5 THEN 'https://x.com:443/' || source ELSE 'https://twitter.com/' || source END"


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 AND length(source) BETWEEN 4 AND 32 THEN source END AS telegram, CASE WHEN doc_id % 7 IN (2, 6) AND length(source) <= 15 THEN source END AS x FROM documents")
def account_names(spark, sf_dir):
    url = F.expr(ADDRESS)
    return table(spark, sf_dir, "documents").select("doc_id", X.account_name(url, "telegram_html").alias("telegram"), X.account_name(url, "x_public").alias("x"))


@query(f"""WITH {TITLES}, w AS (SELECT seq, list_filter(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(title, 'https?://\\S+', '', 'g'), '\\[.*?\\]', '', 'g'), '[【】《》「」『』"''・·•]', '', 'g'), '[\\x{{4e00}}-\\x{{9fff}}]{{2,}}|[a-zA-Z][a-zA-Z]+[a-zA-Z0-9]*'),
 lambda x: length(x) >= 2 AND lower(x) NOT IN ('the', 'que', 'der')) AS words FROM ti) SELECT seq, array_to_string(words, '|') AS words FROM w""")
def word_runs(spark, sf_dir):
    return titles(spark, sf_dir).select("seq", F.array_join(X.word_runs(F.col("title"), ["the", "que", "der"]), "|").alias("words"))


@query(rf"""WITH {TITLES} SELECT seq, trim(regexp_replace(lower(title), '[\s\x0B\x{{85}}\x{{A0}}]+', ' ', 'g')) AS event_title, trim(regexp_replace(regexp_replace(lower(title), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS topic_title,
 array_to_string(list_sort(list_distinct(regexp_extract_all(lower(title), '[\p{{L}}\p{{N}}_]+'))), ' ') AS tokens FROM ti""")
def folded_titles(spark, sf_dir):
    title = F.col("title")
    return titles(spark, sf_dir).select("seq", X.event_title(title).alias("event_title"), X.normal_title(title).alias("topic_title"), F.array_join(F.sort_array(X.topic_tokens(title)), " ").alias("tokens"))


#: A rule file with sections, aliases, named groups, caps, filters and a section that comes too late.
RULE_FILE = """
[global_filter]
zzz
/x.*y/
+not

[Word_Groups]
[Articles]
/(?P<n>th)e / => Tee
+and
@2

que => Shown
una
[late]
+des
!est
"""


@query(f"""WITH {TITLES}, f AS (SELECT seq, lower(title) AS low FROM ti),
g AS (SELECT seq, low, contains(low, 'zzz') OR contains(low, '/x.*y/') OR contains(low, '+not') OR contains(low, 'est') AS ruled_out FROM f)
SELECT seq, CASE WHEN contains(low, 'and') AND contains(low, 'the ') THEN 'Articles' WHEN contains(low, 'des') AND (contains(low, 'que') OR contains(low, 'una')) THEN 'Shown / una / [late] / des' END AS group_name FROM g WHERE NOT ruled_out""")
def rule_file_groups(spark, sf_dir):
    rules = parse_rules(RULE_FILE)
    names = F.array(*[F.lit(g.name) for g in rules.groups])
    rows = titles(spark, sf_dir).where(rules.passes(F.col("title")))
    return rows.select("seq", F.get(names, rules.first_group(F.col("title"))).alias("group_name"))




@query("""SELECT event_id, CASE event_id % 6 WHEN 4 THEN 'soon ' || event_id WHEN 5 THEN '' WHEN 2 THEN strftime(ts, '%m-%d %H:%M') ELSE strftime(ts + INTERVAL 8 HOUR, '%m-%d %H:%M') END AS shown FROM events""")
def reader_times(spark, sf_dir):
    at = lambda by: F.date_format("ts", f"yyyy-MM-dd'{by}'HH:mm:ss")
    kind = F.col("event_id") % 6
    text = F.when(kind == 0, at("T")).when(kind == 1, F.concat(at("T"), F.lit("Z"))).when(kind == 2, F.concat(at("T"), F.lit("+08:00"))).when(kind == 3, F.concat(at(" "), F.lit(".123"))).when(kind == 4, F.concat(F.lit("soon "), F.col("event_id").cast("string"))).otherwise("")
    return table(spark, sf_dir, "events").select("event_id", time_for_reader(text).alias("shown"))
