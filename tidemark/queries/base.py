"""The registry of queries, and the driver's tables as the engine's relations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import latin_words
from tidemark.plans.scratch import tidy

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the same query in SQL.

    When it is called, tables that it wrote and its result doesn't read are deleted.
    """

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: tidy(lambda: f(spark, sf_dir))[0]
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List observations: the kind of event is the source, the user the item, the day the batch."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("source_id"),
        F.col("user_id").alias("item_id"),
        F.date_trunc("day", "ts").alias("batch"),
        (1 + F.floor(F.abs("value")).cast("long") % 100).alias("rank"),
        F.col("event_id").alias("seq"),
        F.col("props").alias("title"),
    )


EVENTS = """ev AS (SELECT event_type AS source_id, user_id AS item_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS batch,
    1 + CAST(floor(abs(value)) AS BIGINT) % 100 AS rank, event_id AS seq, props AS title FROM events)"""
OBS = (
    EVENTS
    + """,
obs AS (SELECT source_id, item_id, batch, rank, seq FROM (SELECT *, row_number() OVER (PARTITION BY source_id, item_id, batch ORDER BY rank, seq) AS k FROM ev) WHERE k = 1)"""
)
OFF = """bt AS (SELECT batch, lag(batch) OVER (ORDER BY batch) AS previous FROM (SELECT DISTINCT batch FROM obs)),
gone AS (SELECT o.source_id, o.item_id, bt.batch FROM obs o JOIN bt ON o.batch = bt.previous
    WHERE EXISTS (SELECT 1 FROM obs s WHERE s.source_id = o.source_id AND s.batch = bt.batch)
      AND NOT EXISTS (SELECT 1 FROM obs p WHERE p.source_id = o.source_id AND p.item_id = o.item_id AND p.batch = bt.batch)),
hist AS (SELECT source_id, item_id, batch, rank, seq FROM obs UNION ALL SELECT source_id, item_id, batch, 0, 0 FROM gone)"""


def words_of(title: Column) -> Column:
    return F.filter(latin_words(title), lambda w: F.length(w) >= 2)


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles: each line of a document that isn't blank, whole, dealt over 30 days, with its words.

    seq is unique to document and line.
    """
    each = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("source_id"), "lang", F.posexplode(F.split("text", "\n")).alias("line", "title"))
    rows = each.where(r"rlike(title, '[^ \t\n\x0B\f\r]')").select(
        (F.shiftleft("doc_id", 32) + F.col("line")).alias("seq"),
        "source_id",
        "lang",
        "title",
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).alias("day"),
        (F.col("doc_id") * 7 % 60 + 1).alias("rank"),
    )
    return rows.withColumn("words", words_of(F.col("title")))


TITLES = """ln AS (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS title, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents),
ti AS (SELECT (doc_id << 32) + line AS seq, source AS source_id, lang, title,
    DATE '2024-01-01' + CAST(doc_id % 30 AS INT) AS day, doc_id * 7 % 60 + 1 AS rank FROM ln WHERE regexp_matches(title, '[^ \\t\\n\\x0B\\f\\r]')),
ws AS (SELECT seq, source_id, day, title, unnest(list_filter(regexp_extract_all(lower(title), '\\p{L}+'), lambda w: length(w) >= 2)) AS word FROM ti)"""


def tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources in tiers by their number: 0-4 A, 5-9 B, 10-14 C, 15-19 D."""
    n = F.regexp_extract("id", r"(\d+)$", 1).cast("int")
    ids = table(spark, sf_dir, "documents").select(F.col("source").alias("id")).distinct()
    tier = F.element_at(F.array(*map(F.lit, "ABCD")), (n / 5).cast("int") + 1)
    return ids.select("id", F.upper("id").alias("name"), tier.alias("tier"), F.when(n % 2 == 0, "lead").otherwise("follow").alias("role"))


TIER = "substr('ABCD', CAST(CAST(regexp_extract(source_id, '(\\d+)$', 1) AS INT) // 5 AS INT) + 1, 1)"

#: Rules that the queries apply to titles.
RULES = """
[GLOBAL_FILTER]
/^\\W*$/

[WORD_GROUPS]
[English]
+the
+and
@4

[Articles]
the
der
las
@3

# prefixes
[Patterns]
/(^|[^\\p{L}])th\\p{L}+ed($|[^\\p{L}])/
/(^|[^\\p{L}])ge\\p{L}/

[Single]
que
una

!zzz
[Rest]
+in
es
en
"""
