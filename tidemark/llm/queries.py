"""The queries of the numbered operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, exact_dedup, fingerprints, lexical, mixing, near_dedup, packing, sharding, substring_dedup, token_files, toxicity, warc, whitening
from tidemark.plans.scratch import new_path, tidy
from tidemark.session import ship


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_documents(spark, sf_dir), 40)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), 4096)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_documents(spark, sf_dir)).drop("row_id")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(_documents(spark, sf_dir), shingle_words=4, percent=80).drop("row_id", "component")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(_documents(spark, sf_dir))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_documents(spark, sf_dir), window=50).drop("kept")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    net = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_documents(docs.select("doc_id", "text"), net).select("doc_id", "held_out", "score", "predicted")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "token-files")
    token_files.write_token_files(_documents(spark, sf_dir), folder)
    return token_files.read_token_files(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").cast("long").alias("ids_crc32"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    files = warc.write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), new_path(spark, "warc"))
    return warc.read_warc(spark, files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(_documents(spark, sf_dir)).drop("row_id")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    rows = whitening.whiten_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), components=8)
    return rows.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=20)


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = bpe.round_trip(_documents(spark, sf_dir))
    digest = lambda c: F.sha2(c, 256)
    return decoded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), digest("ids").alias("ids_sha256"), digest("text").alias("decoded_sha256"))


Query = Callable[[SparkSession, str], DataFrame]


def _tidied(query: Query) -> Query:
    """query, deleting the tables of its own that its result doesn't read."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tidy(lambda: query(spark, sf_dir))[0]

    return run


QUERIES: dict[str, Query] = {
    "op1_sharding": _tidied(op1_sharding),
    "op2_packing": _tidied(op2_packing),
    "op3_exact_dedup": _tidied(op3_exact_dedup),
    "op4_near_dedup": _tidied(op4_near_dedup),
    "op5_fingerprints": _tidied(op5_fingerprints),
    "op6_substring_dedup": _tidied(op6_substring_dedup),
    "op7_toxicity": _tidied(op7_toxicity),
    "op8_token_files": _tidied(op8_token_files),
    "op9_warc": _tidied(op9_warc),
    "op10_mixing": _tidied(op10_mixing),
    "op11_whitening": _tidied(op11_whitening),
    "op12_lexical_search": _tidied(op12_lexical_search),
    "op13_bpe": _tidied(op13_bpe),
}

ORACLES: dict[str, str] = {
    "op3_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm)
    """,
    "op9_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS hex, max(page_id) OVER (PARTITION BY body) AS best FROM p)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + CAST((CAST('0x' || substr(hex, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INT), 1)), '') AS payload_digest,
               CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = best THEN NULL ELSE best END AS refers_to
        FROM d
    """,
    "op10_mixing": r"""
        WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM d GROUP BY source),
        w AS (SELECT *, CAST([5, 2, 1][1 + no % 3] AS DOUBLE) AS weight, 3.0::DOUBLE * source_size AS cap FROM s),
        f AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS share
              FROM w WINDOW b AS (ORDER BY cap / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        l AS (SELECT arg_min(share, (cap / weight, no)) AS level FROM f WHERE share * weight <= cap),
        t AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * weight) END AS target FROM w, l),
        k AS (SELECT d.doc_id, d.size, d.source, t.source_size, t.target,
                     CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || CAST(size AS VARCHAR)), 1, 15) AS BIGINT) AS key
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        b AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                     CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM k)
        SELECT doc_id, size, source, source_size, target,
               CAST(epochs * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - epochs * source_size - before)) AS BIGINT) AS taken
        FROM b
    """,
    "op12_lexical_search": r"""
        WITH d AS (SELECT row_number() OVER () AS row, doc_id,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
        sizes AS (SELECT row, doc_id, CAST(len(words) AS HUGEINT) AS n FROM d),
        total AS (SELECT count(*) FILTER (n > 0) AS docs, CAST(sum(n) AS HUGEINT) AS terms FROM sizes),
        tf AS (SELECT row, term, CAST(count(*) AS HUGEINT) AS tf FROM (SELECT row, unnest(words) AS term FROM d) GROUP BY row, term),
        q AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
        w AS (SELECT item_id, term, CAST(count(*) AS HUGEINT) * CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS HUGEINT) AS weight
              FROM q JOIN df USING (term), total GROUP BY item_id, term, docs, df),
        s AS (SELECT item_id, row, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) AS score
              FROM w JOIN tf USING (term) JOIN sizes USING (row), total GROUP BY item_id, row, doc_id)
        SELECT item_id, CAST(row_number() OVER p AS INT) AS rank, doc_id, CAST(score AS BIGINT) AS score
        FROM s WHERE score > 0 WINDOW p AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER p <= 20
    """,
}
