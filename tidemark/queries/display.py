"""Queries of statuses, reasons, records, events and merged feeds."""

import re

from pyspark.sql import functions as F

from tidemark.functions import display as D
from tidemark.functions import reader, records
from tidemark.functions.names import BESIDE, GAMES
from tidemark.operators import events as E
from tidemark.queries.base import TITLES, events, query, table, titles
from tidemark.queries.topics import EVIDENCE, evidence

WORDS = ["review", "the", "data", "model", "und", "les", "que"]
PATTERNS = {"articles": ["the", "der", "los"], "joins": ["and", "und", "y "], "both": ["the", "und"]}


@query("""WITH e AS (SELECT event_id, event_id % 5 AS n, unnest([struct_pack(at := 0, score := (event_id % 31)::DOUBLE, shown := 'rank↑' || (event_id % 31) || '.0'),
 struct_pack(at := 1, score := (event_id % 14)::DOUBLE, shown := 'burst+' || (event_id % 14) || '.0'), struct_pack(at := 2, score := (event_id * 7 % 31)::DOUBLE, shown := '#' || (event_id % 60 + 1)),
 struct_pack(at := 3, score := (event_id % 3)::DOUBLE, shown := 'cross')]) AS x FROM events),
r AS (SELECT event_id, n, x.shown AS shown, row_number() OVER (PARTITION BY event_id ORDER BY x.score DESC, x.at) AS k FROM e WHERE x.score > 0),
s AS (SELECT event_id, string_agg(shown, '; ' ORDER BY k) FILTER (k <= 3) || '; src ' || CASE WHEN any_value(n) > 0 THEN any_value(n) ELSE 1 END AS shown FROM r GROUP BY 1)
SELECT event_id, coalesce(shown, 'score threshold') AS summary FROM events LEFT JOIN s USING (event_id)""")
def trigger_summary(spark, sf_dir):
    i = F.col("seq")
    heat = F.format_string("best_rank_heat=%d(rank=%d)", i * 7 % 31, i % 60 + 1)
    covered = F.when(i % 5 > 0, F.format_string("source_coverage_heat=5(n=%d)", i % 5)).otherwise("source_coverage_heat=x")
    reasons = F.array(covered, F.format_string("rank_movement=%d.0(delta)", i % 31), F.format_string("new_burst=%d", i % 14), heat, F.format_string("hotlist_rss_cooccurrence=%d", i % 3))
    return events(spark, sf_dir).select(i.alias("event_id"), D.trigger_summary(reasons).alias("summary"))


@query(f"""{EVIDENCE} SELECT topic, CASE WHEN c AND d AND NOT a AND NOT b THEN CASE WHEN d_platforms >= 3 OR platforms >= 5 THEN '中文多源覆盖' WHEN d_platforms >= 2 OR platforms >= 3 THEN '中文多平台覆盖' ELSE '中文源有呼应' END
 ELSE CASE label WHEN 'cross_layer_verified' THEN '多层来源呼应' WHEN 'high_heat_unverified' THEN '单点高热，来源待补' WHEN 'chinese_only_hot' THEN '中文平台热度上升' WHEN 'silence_gap' THEN '社交端响应偏弱' ELSE '' END END AS status,
 concat_ws(' · ', nullif('层级 ' || concat_ws('/', CASE WHEN a THEN 'A' END, CASE WHEN b THEN 'B' END, CASE WHEN c THEN 'C' END, CASE WHEN d THEN 'D' END), '层级 '), platforms || ' 个来源', CASE WHEN feeling THEN '情绪聚集' END) AS note FROM e""")
def reader_status(spark, sf_dir):
    tiers = F.array_compact(F.array(*[F.when(F.col(t.lower()), t) for t in "ABCD"]))
    status = D.reader_status(F.col("label"), F.lit(None).cast("string"), tiers, F.col("d_platforms"), F.col("platforms"))
    note = D.evidence_note(F.array_join(tiers, "/"), F.col("platforms"), F.lit("-"), F.col("feeling"))
    return evidence(spark, sf_dir).select("topic", status.alias("status"), note.alias("note"))


def _first_word_sql() -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '(^|[^a-z0-9]){w}([^a-z0-9]|$)') THEN '{w}'" for w in WORDS) + " END"


@query(f"SELECT doc_id, {_first_word_sql()} AS reason FROM documents")
def structural_reason(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", reader.first_word(F.col("text"), WORDS).alias("reason"))


def _named_sql(text: str) -> str:
    """SQL of whether a text has a name of competitive games, by the same table of names."""
    groups: dict[tuple, list[str]] = {}
    for row in GAMES:
        before = f"(^|[^{row.not_before}])" if row.not_before else ""
        after = {"": "", "[a-z]": "($|[^a-z])"}.get(row.not_after, "($|[^a-z0-9-]|-($|[^0-9]))")
        names = "|".join(n.replace(".", "\\.") for n in row.names.split())
        groups.setdefault(row.beside, []).append(f"regexp_matches({text}, '{'' if row.exact else '(?i)'}{before}{row.lead}({names}){after}')")
    beside = {word: f"regexp_matches({text}, '{pattern}')" for word, pattern in BESIDE.items()}
    return " OR ".join(f"(({' OR '.join(found)}) AND ({' OR '.join(beside[w] for w in words) or 'true'}))" for words, found in groups.items())


def _keywords_sql(text: str, words: list[str]) -> str:
    of = lambda w: f"regexp_matches({text}, '(?i)(^|[^A-Za-z0-9]){w}($|[^A-Za-z0-9])')" if re.fullmatch("[A-Za-z0-9]+", w) else f"contains(lower({text}), '{w.lower()}')"
    return "(" + " OR ".join(map(of, words)) + ")"


@query(f"WITH {TITLES} SELECT seq, {_named_sql('title')} OR ({_keywords_sql('title', [w for words in reader.CATEGORIES.values() for w in words])} AND NOT {_keywords_sql('title', reader.STRUCTURAL)}) AS noise FROM ti")
def reader_noise(spark, sf_dir):
    rows = titles(spark, sf_dir)
    return rows.select("seq", reader.is_noise(F.col("title"), F.array("title"), F.lit(False), no_games=True).alias("noise"))


@query("SELECT conv_id, turn, CASE WHEN contains(lower(role), 'user') THEN 'user' WHEN contains(lower(role), 'assistant') THEN 'assistant' WHEN contains(lower(role), 'tool') THEN 'tool' WHEN contains(lower(role), 'system') THEN 'system' ELSE 'unknown' END AS role FROM conversations")
def record_roles(spark, sf_dir):
    record = F.to_json(F.struct(F.struct("role", F.col("text").alias("content")).alias("payload")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", records.role_of(record).alias("role"))


@query("SELECT conv_id, turn, CASE WHEN contains(lower(role), 'tool') OR contains(lower(role), 'system') OR text IS NULL OR length(trim(text)) < 2 THEN NULL ELSE md5(text) END AS said FROM conversations WHERE text IS NOT NULL AND length(trim(text)) >= 2")
def record_texts(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("text IS NOT NULL AND length(trim(text)) >= 2")
    record = F.to_json(F.struct(F.struct("role", F.col("text").alias("content")).alias("payload")))
    said = F.get(records.spoken(record, records.role_of(record)), F.lit(0))
    return rows.select("conv_id", "turn", F.md5(said.cast("binary")).alias("said"))


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN contains(lower(text), 'the') OR contains(lower(text), 'der') OR contains(lower(text), 'los') THEN 'articles' END,
 CASE WHEN contains(lower(text), 'and') OR contains(lower(text), 'und') OR contains(lower(text), 'y ') THEN 'joins' END, CASE WHEN contains(lower(text), 'the') OR contains(lower(text), 'und') THEN 'both' END], lambda x: x IS NOT NULL), ',') AS hits FROM documents""")
def pattern_hits(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(records.pattern_hits(F.col("text"), PATTERNS), ",").alias("hits"))


@query("""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), 'the|der|los|and|und|y ')) AS term FROM documents),
o AS (SELECT unnest(['the', 'der', 'los', 'and', 'und', 'y ', 'the', 'und']) AS term, unnest(['articles', 'articles', 'articles', 'joins', 'joins', 'joins', 'both', 'both']) AS name)
SELECT name, count(*) AS matches, count(DISTINCT doc_id) AS files FROM t JOIN o USING (term) GROUP BY 1""")
def pattern_totals(spark, sf_dir):
    return E.pattern_stats(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), "text"), PATTERNS)


@query("""WITH d AS (SELECT *, DATE '2024-01-01' + CAST(page_id % 30 AS INT) AS day FROM pages), k AS (SELECT *, regexp_extract(url, '^[a-z]+://([^/]+)/', 1) AS host FROM d)
SELECT 'project_' || substr(sha256(host), 1, 16) AS project, count(*) AS n, min(day) AS first, max(day) AS last, array_to_string(list_sort(list(DISTINCT 't' || page_id % 4)), ',') AS tools FROM k WHERE host <> '' GROUP BY host""")
def project_lifecycles(spark, sf_dir):
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 30).cast("int"))
    files = table(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.concat(F.lit("t"), F.col("page_id") % 4).alias("tool"), day.alias("modified"))
    return E.project_lifecycles(files, "^[a-z]+://([^/]+)/").withColumn("tools", F.array_join("tools", ","))


LEVEL = "CASE WHEN rank % 10 = 0 THEN 'suppress' WHEN score >= 80 THEN 'urgent' WHEN score >= 60 THEN 'alert' ELSE 'watch' END"


@query(f"""WITH {TITLES}, c AS (SELECT *, seq * 13 % 101 AS score FROM ti), l AS (SELECT *, {LEVEL} AS level FROM c)
SELECT CAST(section AS BIGINT) AS section, s.level, count(l.level) AS n, count(*) FILTER (score >= 80) AS high FROM (VALUES (0, 'urgent'), (1, 'alert'), (2, 'watch'), (3, 'suppress')) s(section, level) LEFT JOIN l ON s.level = l.level GROUP BY 1, 2""")
def level_sections(spark, sf_dir):
    rows = titles(spark, sf_dir).withColumn("score", F.col("seq") * 13 % 101).withColumn("level", F.expr(LEVEL))
    return E.level_sections(rows)


@query(f"""WITH {TITLES}, g AS (SELECT seq, 'w' || rank AS word, title FROM ti WHERE seq % 3 > 0), a AS (SELECT seq, title, CASE WHEN seq % 2 = 0 THEN 'e' || seq END AS known FROM ti WHERE seq % 3 < 2),
n AS (SELECT title, min(seq) AS seq, arg_min(known, seq) FILTER (known IS NOT NULL) AS known FROM a GROUP BY 1), m AS (SELECT title, max(seq) AS last FROM g GROUP BY 1)
SELECT g.seq, word, CASE WHEN g.seq = last THEN known END AS entities FROM g JOIN m USING (title) LEFT JOIN n USING (title) UNION ALL SELECT seq, NULL, known FROM n WHERE title NOT IN (SELECT title FROM g)""")
def merged_feeds(spark, sf_dir):
    rows = titles(spark, sf_dir).select("seq", F.concat(F.lit("w"), "rank").alias("word"), F.lit("").alias("url"), F.lit("f").alias("feed"), "title", F.lit("2024").alias("published_at"))
    grouped = rows.where("seq % 3 > 0").withColumn("entities", F.lit(None).cast("string"))
    admitted = rows.where("seq % 3 < 2").drop("word").withColumn("entities", F.when(F.col("seq") % 2 == 0, F.concat(F.lit("e"), "seq")))
    return E.merged_feed_items(grouped, admitted).select("seq", "word", "entities")


@query()
def bound_events(spark, sf_dir):
    """Titles that claim the two hundreds their numbers fall in by two rules: the first by number takes both."""
    rows = titles(spark, sf_dir)
    ids = F.array(F.concat(F.lit("a"), (F.col("seq") * 7 % 1009).cast("string")), F.concat(F.lit("b"), (F.col("seq") * 11 % 997).cast("string")))
    proposed = rows.select(F.col("seq").alias("place"), F.col("source_id").alias("topic"), "title", ids.alias("evidence_ids"))
    known = proposed.select(F.explode("evidence_ids").alias("evidence_id")).distinct()
    return E.bound_events(proposed, known).select("place", "topic", "event_id")


@query(f"""WITH {TITLES}, r AS (SELECT seq, trim(regexp_replace(title, '(?i)https?://[^ \\t\\n\\x0B\\f\\r]+', '', 'g')) AS raw FROM ti),
b AS (SELECT seq, raw, trim(regexp_replace(raw, '^(?:高热未归类|未归类)\\s*[·:：|｜-]\\s*', '')) AS bare FROM r) SELECT seq, CASE WHEN bare = '' THEN raw ELSE bare END AS topic FROM b""")
def display_topics(spark, sf_dir):
    return titles(spark, sf_dir).select("seq", D.display_topic(F.col("title")).alias("topic"))
