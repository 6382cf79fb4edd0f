"""Ranked lexical search by a two-level quantised index and exact integer rescoring."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tokens import utf8
from tidemark.plans.scratch import cut

#: A block of the index has at most so many documents and, but for its last document, bytes of text.
BLOCK_DOCS, BLOCK_BYTES = 1024, 4 << 20
#: Bytes of blocks that a task holds at a time, besides a block that is larger.
HELD = 8 << 20
#: Queries that one pass over the index serves; more queries are taken in groups of about this size.
QUERY_BLOCK = 512
#: An exact impact is below MILLION; a byte b stands for impacts in (STEP * (b - 1), STEP * b].
MILLION, STEP = 1_000_000, 3_922
#: Long texts are split into words by so many bytes at a time.
PIECE = 1 << 20

_SEPARATORS = [c for c in range(128) if not chr(c).isalnum()]
_FOLD = bytes(32 if c in set(_SEPARATORS) else c + 32 if 65 <= c <= 90 else c for c in range(256))


def term_counts(data: bytes) -> Counter[bytes]:
    """Occurrences of each term: letters and digits of ASCII and all other characters, A-Z in lower case."""
    folded, counts, at = data.translate(_FOLD), Counter(), 0
    while at < len(folded):
        end = folded.find(b" ", at + PIECE)
        end = len(folded) if end < 0 else end
        counts.update(folded[at:end].split())
        at = end
    return counts


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = [sum(term_counts(x).values()) if len(x) > PIECE else len(x.translate(_FOLD).split()) for x in utf8(batch.column(0))]
        yield pa.RecordBatch.from_pydict({"documents": [sum(n > 0 for n in sizes)], "terms": [sum(sizes)]})


INDEX = "doc_ids array<long>, lengths array<long>, terms array<binary>, sizes array<int>, tops binary, docs binary, impacts binary, counts binary"


def impacts(tf: np.ndarray, length: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """The exact integer impact of tf occurrences in documents of so many terms."""
    m = 75 + (25 * length * documents) // terms
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def _index_row(ids: list, texts: list[bytes], documents: int, terms: int) -> list:
    """One block: for each of its terms, in byte order, the documents that hold it with their counts and impact bytes."""
    vocabulary: dict[bytes, int] = {}
    lengths, term, doc, tf = [], [], [], []
    for k, text in enumerate(texts):
        counts = term_counts(text)
        lengths.append(sum(counts.values()))
        term += [vocabulary.setdefault(w, len(vocabulary)) for w in counts]
        tf += counts.values()
        doc += [k] * len(counts)
    words = list(vocabulary)
    order = sorted(range(len(words)), key=words.__getitem__)
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    term, doc, tf, length = place[np.array(term, np.int64)], np.array(doc, np.int64), np.array(tf, np.int64), np.array(lengths, np.int64)
    by = np.lexsort((doc, term))
    term, doc, tf = term[by], doc[by], tf[by]
    quantised = -(-impacts(tf, length[doc], documents, terms) // STEP)
    sizes = np.bincount(term, minlength=len(words))
    starts = np.cumsum(sizes) - sizes
    tops = np.maximum.reduceat(quantised, starts) if len(words) else quantised
    parts = [tops.astype("u1"), doc.astype("<u2"), quantised.astype("u1"), tf.astype("<u4")]
    return [ids, lengths, [words[k] for k in order], sizes.tolist(), *(x.tobytes() for x in parts)]


def _blocks(documents: int, terms: int):
    names = ["doc_ids", "lengths", "terms", "sizes", "tops", "docs", "impacts", "counts"]
    kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int32()), *[pa.binary()] * 4]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0

        def row() -> pa.RecordBatch:
            values = _index_row(ids, texts, documents, terms)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                ids.append(doc)
                texts.append(text)
                size += len(text)
                if len(ids) == BLOCK_DOCS or size >= BLOCK_BYTES:
                    yield row()
                    ids, texts, size = [], [], 0
        if ids:
            yield row()

    return made


@dataclass(frozen=True)
class Index:
    """blocks: a table with a row for each block of documents; documents with a term, and terms with repeats, in all."""

    blocks: DataFrame
    documents: int
    terms: int


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """The index of all whole texts: two scans of docs, the first for the counts that impacts need, and no shuffle.

    A block holds the documents that follow each other in a task. Its upper level is one byte a term, the greatest
    impact in the block; the lower level one byte for each term and document. Both round up, so sums of them bound
    scores from above, and sums of the steps below them from below. Term counts stand beside for exact scores.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    total = rows.select("text").mapInArrow(_sizes, "documents long, terms long").agg(F.sum("documents").alias("n"), F.sum("terms").alias("l")).first()
    n, terms = int(total["n"] or 0), int(total["l"] or 0)
    return Index(cut(rows.mapInArrow(_blocks(n, max(1, terms)), INDEX), "index", codec="zstd", group=HELD), n, terms)


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(no, term, times) for no, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True) for term, times in term_counts(text).items()]
        no, term, times = zip(*found, strict=True) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(no, pa.int64()), pa.array(term, pa.binary()), pa.array(times, pa.int64())], ["item", "term", "times"])


CANDIDATES = "item long, doc_id long, upper long, lower long, length long, weights array<long>, tfs array<long>"


def _candidates(queries: dict[int, list[tuple[bytes, int]]], k: int):
    """Of each query, the documents whose upper bound reaches the k-th lower bound that the task has seen so far."""
    wanted = sorted({term for terms in queries.values() for term, _ in terms})

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {item: np.zeros(k, np.int64) for item in queries}
        for batch in batches:
            for row in batch.to_pylist():
                yield from of_block(row, best)

    def of_block(row: dict, best: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        place = {w: at for at, w in enumerate(row["terms"])}
        at = {w: place[w] for w in wanted if w in place}
        ends = np.cumsum(row["sizes"]).tolist()
        tops, docs = np.frombuffer(row["tops"], "u1"), np.frombuffer(row["docs"], "<u2")
        bytes_, counts = np.frombuffer(row["impacts"], "u1"), np.frombuffer(row["counts"], "<u4")
        spans = {w: slice(ends[p] - row["sizes"][p], ends[p]) for w, p in at.items()}
        ids, lengths = row["doc_ids"], row["lengths"]
        for item, terms in queries.items():
            held = [(spans[w], weight, int(tops[at[w]])) for w, weight in terms if w in at]
            least = best[item].min()
            if not held or STEP * sum(weight * top for _, weight, top in held) < max(1, least):
                continue
            upper, matched = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            for span, weight, _ in held:
                upper[docs[span]] += weight * bytes_[span].astype(np.int64)
                matched[docs[span]] += weight
            lower, upper = STEP * (upper - matched), STEP * upper
            some = np.flatnonzero(upper >= max(1, least))
            if not len(some):
                continue
            all_lower = np.concatenate([best[item], np.maximum(lower[some], 0)])
            best[item] = np.partition(all_lower, len(all_lower) - k)[-k:]
            some = some[upper[some] >= max(1, best[item].min())]
            tf = np.zeros((len(some), len(held)), np.int64)
            for j, (span, _, _) in enumerate(held):
                here = docs[span]
                where = np.minimum(np.searchsorted(here, some), len(here) - 1)
                tf[:, j] = np.where(here[where] == some, counts[span][where], 0)
            weights = np.array([weight for _, weight, _ in held], np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(some), item)),
                    pa.array([ids[d] for d in some], pa.int64()),
                    pa.array(upper[some]),
                    pa.array(lower[some]),
                    pa.array([lengths[d] for d in some], pa.int64()),
                    pa.array([weights[x > 0].tolist() for x in tf], pa.list_(pa.int64())),
                    pa.array([x[x > 0].tolist() for x in tf], pa.list_(pa.int64())),
                ],
                ["item", "doc_id", "upper", "lower", "length", "weights", "tfs"],
            )

    return found


def _first(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each item with their place from 1: in parts of an item first, then of those."""
    salt = F.pmod(F.xxhash64("doc_id", "length"), F.lit(64))
    rows = rows.withColumn("_part", salt).withColumn("place", F.row_number().over(Window.partitionBy("item", "_part").orderBy(*order)))
    rows = rows.where(F.col("place") <= k).drop("_part", "place")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("place") <= k)


def _ranked(index: Index, terms: DataFrame, k: int) -> DataFrame:
    """(item, rank, doc_id, score) of the queries in terms: (item, term, weight), few enough for one pass."""
    queries: dict[int, list[tuple[bytes, int]]] = {}
    for r in terms.toLocalIterator():
        queries.setdefault(r["item"], []).append((bytes(r["term"]), r["weight"]))
    found = cut(index.blocks.mapInArrow(_candidates(queries, k), CANDIDATES), "candidates")
    lowest = _first(found.select("item", "doc_id", "length", "lower"), [F.desc("lower")], k)
    kth = lowest.where(F.col("place") == k).select("item", F.col("lower").alias("least"))
    reached = found.join(kth, "item", "left").where(F.col("upper") >= F.coalesce("least", F.lit(1)))
    m = F.expr(f"75 + (25 * length * {index.documents}L) div {max(1, index.terms)}L")
    hits = F.zip_with("weights", "tfs", lambda w, tf: F.struct(w.alias("w"), tf.alias("tf")))
    score = F.expr("aggregate(hits, 0L, (s, h) -> s + h.w * ((1000000000L * h.tf) div (1000L * h.tf + 12L * m)))")
    scored = reached.withColumn("m", m).withColumn("hits", hits).select("item", "doc_id", "length", score.alias("score"))
    return _first(scored.where("score > 0"), [F.desc("score"), F.col("doc_id").asc_nulls_last()], k).select("item", F.col("place").alias("rank"), "doc_id", "score")


def search(index: Index, queries: DataFrame, key: str = "item_id", text: str = "text", k: int = 20) -> DataFrame:
    """The k documents with the highest scores above 0 for each row of queries: key as item_id, rank, doc_id, score.

    Tasks read the index block by block: a block whose upper level can't reach the k-th lower bound of a query is passed
    over, the others' bytes give bounds of each document, and documents that reach the lower bound seen so far are kept
    with the counts of the query's terms. Of them all the k-th lower bound over all tasks is found, and every document
    whose upper bound reaches it is scored exactly in integers. Equal scores go by doc_id, null last. Queries are taken
    in groups of about QUERY_BLOCK, whose terms the driver holds, one pass over the index each.

    Null texts, and texts without terms, find nothing and are never found. Repeated queries are answered each, repeated
    documents are found each, null keys too. No queries or no documents give no rows. Other columns are not read.
    """
    numbered = cut(queries.select(F.monotonically_increasing_id().alias("item"), F.col(key).cast("long").alias("item_id"), F.col(text).cast("string").alias("text")), "queries")
    terms = cut(numbered.select("item", "text").mapInArrow(_query_terms, "item long, term binary, times long"), "query-terms")
    each = index.blocks.select(F.explode(F.arrays_zip("terms", "sizes")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.sizes").alias("size"))
    known = each.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("size").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(index.documents) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weighed = cut(terms.join(known, "term").select("item", "term", (F.col("times") * weight).alias("weight")).where("weight > 0"), "weights")
    groups = max(1, -(-numbered.count() // QUERY_BLOCK))
    group = F.pmod(F.xxhash64("item"), F.lit(groups))
    out = None
    for g in range(groups):
        some = _ranked(index, weighed.where(group == g), k)
        out = some if out is None else out.unionByName(some)
    return out.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """search() of queries (item_id, text) over the index of docs (doc_id, text)."""
    return search(build_index(docs), queries, k=k)
