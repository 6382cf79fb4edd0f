"""Exact dedup by content-defined chunk recipes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tokens import utf8
from tidemark.plans.scratch import cut

#: A chunk ends after a byte whose rolling hash has these bits zero: about one in 2048.
CUT_BITS = 11
#: Bytes that the rolling hash looks back on, and so the least length of a chunk.
WINDOW = 32
LONGEST = 1 << 15

_GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)


def chunk_ends(data: bytes) -> list[int]:
    """Where the chunks of data end. A boundary depends on the 32 bytes before it, so an edit moves only those near it.

    The gear hash of all positions comes from five doublings of its window. Chunks are at most 32768 bytes long.
    """
    n = len(data)
    if n <= WINDOW:
        return [n] if n else []
    rolling = _GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8, 16):
        rolling[step:] += rolling[:-step] << np.uint32(step)
    found = np.flatnonzero((rolling[WINDOW - 1 :] >> np.uint32(32 - CUT_BITS)) == 0) + WINDOW
    ends, last = [], 0
    for end in [*found.tolist(), n]:
        while end - last > LONGEST:
            last += LONGEST
            ends.append(last)
        if end - last >= WINDOW or end == n and end > last:
            ends.append(end)
            last = end
    return ends


def one_spaced(data: bytes) -> bytes:
    """data with each run of ASCII white space replaced by one space."""
    words = b" ".join(data.split())
    if not words:
        return b" " if data else b""
    return b" " * data[:1].isspace() + words + b" " * data[-1:].isspace()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, row_id, text) to (doc_id, row_id, text_sha256, chunks): digest and chunks of the text with single spaces."""
    for batch in batches:
        shas, cut_up = [], []
        for data in map(one_spaced, utf8(batch.column(2))):
            ends = chunk_ends(data)
            shas.append(hashlib.sha256(data).hexdigest())
            cut_up.append([data[a:b] for a, b in zip([0, *ends], ends, strict=False)])
        columns = [batch.column(0), batch.column(1), pa.array(shas, pa.string()), pa.array(cut_up, pa.list_(pa.binary()))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row_id", "text_sha256", "chunks"])


def spare(name: str, docs: DataFrame) -> str:
    """name, with underscores before it until docs has no such column."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_row_id(docs: DataFrame, key: str) -> tuple[DataFrame, str]:
    """docs with a column more, and its name: together with the key it tells rows apart that are equal in all others.

    It is 0 for rows whose key no other row has. Only rows with repeated or null keys are copied to a table, where they
    get numbers, unless docs isn't a table itself: then all are, so that it is computed once.
    """
    name, repeated = spare("row_id", docs), spare("repeated_key", docs)
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        docs = cut(docs, "rows")
    keys = docs.select(F.col(key).cast("long").alias(repeated)).groupBy(repeated).agg(F.count("*").alias("_n")).where(F.col(repeated).isNull() | (F.col("_n") > 1))
    keys = cut(keys.select(repeated), "repeated-keys")
    if keys.isEmpty():
        return docs.withColumn(name, F.lit(0).cast("long")), name
    same = F.col(key).cast("long").eqNullSafe(F.col(repeated))
    some = cut(docs.join(keys, same, "left_semi").withColumn(name, F.monotonically_increasing_id() + 1), "repeated-rows")
    return docs.join(keys, same, "left_anti").withColumn(name, F.lit(0).cast("long")).unionByName(some), name


def of_rows(rows: DataFrame, key: str, name: str, picked: DataFrame, how: str) -> DataFrame:
    """Join rows from with_row_id to a table picked, (doc_id, row_id) and more, whose columns mustn't clash."""
    doc, row = spare("picked_doc", rows), spare("picked_row", rows)
    picked = picked.withColumnsRenamed({"doc_id": doc, "row_id": row})
    return rows.join(picked, F.col(key).cast("long").eqNullSafe(F.col(doc)) & (F.col(name) == F.col(row)), how)


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", row_id: str | None = None, hash_bits: int = 64) -> DataFrame:
    """Groups of equal texts, where any run of ASCII white space counts as one space; one row for each row of docs.

    Each text is cut once into content-defined chunks, which go into a table with their hashes. Chunks are deduplicated
    by content, combined before the shuffle, to identifiers: the chunk's hash, and where different contents share one,
    the content's rank among them; so equal identifiers mean equal bytes. Texts are then equal exactly when their
    ordered lists of identifiers are. A chunk's content moves once; texts don't. hash_bits makes the hash weaker, for
    tests of that rank.

    Returns key as doc_id, keep_id (doc_id of the row that stays), group_size, kept, text_sha256 (of the text with
    its white space replaced) and row_id. The row with the smallest key stays, null last; of rows with that same key
    one stays. Null and empty texts equal each other. Other columns are not read.
    """
    mask = (1 << (hash_bits - 1)) - 1 if hash_bits < 64 else -1
    own = F.col(row_id) if row_id else F.monotonically_increasing_id()
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), own.cast("long").alias("row_id"), F.col(text).cast("string").alias("text"))
    chunked = rows.mapInArrow(_chunks, "doc_id long, row_id long, text_sha256 string, chunks array<binary>")
    low_bits = lambda c: F.xxhash64(c).bitwiseAND(F.lit(mask).cast("long"))
    chunked = cut(chunked.withColumn("names", F.transform("chunks", low_bits)), "chunks")
    name = low_bits("chunk")
    contents = chunked.select(F.explode("chunks").alias("chunk")).select(name.alias("name"), "chunk").groupBy("name", "chunk").agg(F.count("*").alias("_times"))
    shared = cut(contents.groupBy("name").agg(F.count("*").alias("contents")).where("contents > 1").select("name"), "clashes")
    if shared.isEmpty():
        recipes = cut(chunked.select("doc_id", "row_id", "text_sha256", F.col("names").alias("recipe")), "recipes")
    else:
        place = F.row_number().over(Window.partitionBy("name").orderBy("chunk")) - 1
        ranks = cut(contents.join(shared, "name", "left_semi").select("name", "chunk", place.alias("rank")), "ranks")
        each = chunked.select("doc_id", "row_id", "text_sha256", F.posexplode_outer("chunks").alias("at", "chunk")).withColumn("name", name)
        named = each.join(ranks, ["name", "chunk"], "left").select(
            "doc_id", "row_id", "text_sha256", F.struct("at", "name", F.coalesce("rank", F.lit(0)).cast("long").alias("rank")).alias("id")
        )
        lists = F.sort_array(F.collect_list(F.when(F.col("id.at").isNotNull(), F.col("id"))))
        recipes = named.groupBy("doc_id", "row_id", "text_sha256").agg(F.flatten(F.transform(lists, lambda i: F.array(i["name"], i["rank"]))).alias("recipe"))
        recipes = cut(recipes, "recipes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")).alias("first")
    groups = recipes.groupBy("recipe").agg(first, F.count("*").alias("group_size")).where("group_size > 1")
    groups = cut(groups, "copies").select(F.col("recipe").alias("_recipe"), "first", "group_size")
    out = recipes.join(groups, F.col("recipe") == F.col("_recipe"), "left")
    alone = F.col("first").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("first.row_id") == F.col("row_id")) & F.col("first.doc_id").eqNullSafe(F.col("doc_id"))).alias("kept"),
        "text_sha256",
        "row_id",
    )


def drop_exact_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns, without those whose text equals that of a row with a smaller key.

    Null and empty texts are copies of each other. Null keys count as the largest; of rows with the same key and text
    one stays, whichever. Columns may have any names; no rows give none.
    """
    rows, name = with_row_id(docs, key)
    gone = exact_groups(rows, key, text, row_id=name).where("NOT kept").select("doc_id", "row_id")
    return of_rows(rows, key, name, cut(gone, "gone"), "left_anti").select(*docs.columns)
