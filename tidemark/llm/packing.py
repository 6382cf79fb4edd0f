"""Best-fit decreasing packing of token pieces into sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tokens import default_tokenizer, encoder, utf8
from tidemark.plans.prefix_sums import hash_key, running_totals
from tidemark.plans.scratch import cut

END_ID = (1).to_bytes(4, "little")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
BLOCK = 256


class OpenBins:
    """Bins by remaining capacity under a segment tree; finds the tightest that fits in logarithmic time.

    Leaf r holds the ranges (first bin, count) of open bins with r tokens left; a node tells whether any leaf below
    it has one.
    """

    def __init__(self, capacity: int):
        self.leaves = 1
        while self.leaves <= capacity:
            self.leaves *= 2
        self.any = bytearray(2 * self.leaves)
        self.bins: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _mark(self, left: int) -> None:
        at = left + self.leaves
        self.any[at] = bool(self.bins[left])
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] | self.any[2 * at + 1]

    def tightest(self, need: int) -> int | None:
        """The least remaining capacity of at least need that some bin has."""
        at = need + self.leaves
        if self.any[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None

    def add(self, left: int, first: int, count: int) -> None:
        if left and count:
            self.bins[left].append((first, count))
            self._mark(left)

    def take(self, left: int) -> tuple[int, int]:
        out = self.bins[left].pop()
        self._mark(left)
        return out


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Pack counts[size] pieces of each size into bins of the given capacity, longest first, each into the tightest bin.

    Pieces of a size are interchangeable, so runs of them are placed together. Returns runs (size, lo, hi, per_bin,
    first_bin, offset): of the pieces of that size, number k with lo <= k < hi goes to bin first_bin + (k - lo) //
    per_bin, at offset + (k - lo) % per_bin * size. A size uses each range of bins once and splits at most one, so
    the ranges, and with them the work, depend on the capacity and not on the number of pieces.
    """
    open_bins, made, runs = OpenBins(capacity), 0, []
    for size in sorted(counts, reverse=True):
        at, end = 0, counts[size]
        while at < end:
            left = open_bins.tightest(size)
            if left is None:
                left = capacity
                need = -(-(end - at) // (capacity // size))
                first, bins, made = made, need, made + need
            else:
                first, bins = open_bins.take(left)
            per_bin = left // size
            full = min(bins, (end - at) // per_bin)
            if full:
                runs.append((size, at, at + full * per_bin, per_bin, first, capacity - left))
                open_bins.add(left - per_bin * size, first, full)
                at += full * per_bin
            if full < bins and at < end:
                runs.append((size, at, end, per_bin, first + full, capacity - left))
                open_bins.add(left - (end - at) * size, first + full, 1)
                at, full = end, full + 1
            open_bins.add(left, first + full, bins - full)
    return runs


def token_pieces(docs: DataFrame, key: str, text: str, capacity: int, tokenizer: str, with_ids: bool = False) -> DataFrame:
    """Token ids of each text and an end id, cut every capacity tokens: one row for each piece, if asked with its ids."""
    names, kinds = ["doc_id", "piece", "start", "length", "ids_crc32"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    if with_ids:
        names, kinds = [*names, "ids"], [*kinds, pa.binary()]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, wide = encoder(tokenizer), 4 * capacity
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), coder.encode(utf8(batch.column(1))), strict=True):
                ids += END_ID
                for piece, at in enumerate(range(0, len(ids), wide)):
                    part = ids[at : at + wide]
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part), part)[: len(names)])
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(pieces, PIECES + ", ids binary" * with_ids)


def pack_documents(docs: DataFrame, capacity: int = 4096, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pack all documents into as few sequences of at most capacity tokens as best-fit decreasing can.

    One row for each piece: key as doc_id, piece, start, length, ids_crc32 (of the piece's ids as little-endian
    unsigned 32-bit integers), sequence_id and offset (place in the sequence, gapless from 0). Null and empty texts
    are one piece with the end id alone; a null key stays null; repeated rows are packed each; other columns are not
    read. With with_ids the ids of each piece come along, for packed_sequences. What reaches the driver is the number of pieces of each length: at most capacity numbers.
    """
    spark = docs.sparkSession
    made = token_pieces(docs, key, text, capacity, tokenizer or default_tokenizer(), with_ids)
    pieces = cut(made.withColumn("_key", hash_key("doc_id", "piece", "ids_crc32")), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = best_fit_decreasing(counts, capacity)
    plan = spark.createDataFrame(runs, "_length long, _lo long, _hi long, _per_bin long, _bin long, _offset long")
    plan = plan.withColumn("_block", F.explode(F.expr(f"sequence(_lo div {BLOCK}, (_hi - 1) div {BLOCK})")))
    ranked = running_totals(pieces, "length", "_key", ["doc_id", "piece", "ids_crc32"], F.lit(1), "_rank")
    ranked = ranked.withColumn("_of", F.expr(f"_rank div {BLOCK}"))
    inside = (F.col("length") == F.col("_length")) & (F.col("_of") == F.col("_block")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))
    return ranked.join(plan, inside).select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        F.expr("_bin + (_rank - _lo) div _per_bin").alias("sequence_id"),
        F.expr("_offset + (_rank - _lo) % _per_bin * length").alias("offset"),
        *["ids"] * with_ids,
    )


def packed_sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids, doc_ids) of packed pieces with ids: the sequences themselves.

    ids are little-endian unsigned 32-bit integers; doc_ids has the document of each piece in order, null where its key
    was. Pieces of repeated rows are pieces like any other; no pieces give no sequences; columns beyond those of
    pack_documents are not read. A sequence has at most as many pieces as tokens, so a group is bounded.
    """
    rows = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("pieces"))
    joined = F.aggregate("pieces", F.lit(b""), lambda all_ids, p: F.concat(all_ids, p["ids"]))
    return rows.select("sequence_id", "length", joined.alias("ids"), F.transform("pieces", lambda p: p["doc_id"]).alias("doc_ids"))
