"""BPE encoding that reuses chunks which documents share, and decoding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.exact_dedup import chunk_ends, of_rows, with_row_id
from tidemark.llm.tokens import WordEncoder, default_tokenizer, encoder, utf8
from tidemark.plans.scratch import cut

#: Bits of the map of shared chunks that every task gets: 4 MB, whatever the input. Where more chunks are shared than it
#: can tell apart, chunks that are not shared are taken for shared ones too, and moved; results don't change.
MAP_BITS = 1 << 25
#: Words of a chunk next to its ends that are kept for comparison when a join is encoded again.
MARGIN = 8
#: Ids that are decoded at a time.
RUN = 1 << 16


def chunks(data: bytes) -> list[bytes]:
    """Content-defined chunks of whole characters."""
    out, last = [], 0
    for end in chunk_ends(data):
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        if end > last:
            out.append(data[last:end])
            last = end
    return out


def _named(data: bytes, bits: int) -> tuple[bytes, int]:
    """A chunk's 128-bit name and its bit in a map."""
    name = xxhash.xxh3_128_digest(data)
    return name, int.from_bytes(name[:8], "little") % bits


def _names(bits: int):
    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = [_named(c, bits) for text in utf8(batch.column(0)) for c in chunks(text)]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in named], pa.binary()), pa.array([b + 1 for _, b in named], pa.int64())], ["chunk", "bit"])

    return names


def _map_of_shared(texts: DataFrame, bits: int) -> np.ndarray:
    """A map of so many bits, set where a chunk occurs twice or more in all texts."""
    shared = texts.mapInArrow(_names(bits), "chunk binary, bit long").groupBy("chunk", "bit").agg(F.count("*").alias("times")).where("times > 1")
    parts = shared.groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in parts.toLocalIterator():
        own = np.frombuffer(bytes(r["bits"]), np.uint8)
        at = (r["part"] - 1) * 4096
        out[at : at + len(own)] |= own
    return out


def _cut_up(data: bytes, shared: np.ndarray) -> list[tuple[bytes | None, bytes]]:
    """Runs of chunks that aren't shared as (None, text), and each chunk that is, by the map, as (name, text)."""
    out: list[tuple[bytes | None, bytes]] = []
    for chunk in chunks(data):
        name, bit = _named(chunk, 8 * len(shared))
        if shared[bit >> 3] >> (bit & 7) & 1:
            out.append((name, chunk))
        elif out and out[-1][0] is None:
            out[-1] = (None, out[-1][1] + chunk)
        else:
            out.append((None, chunk))
    return out


PIECE = "head binary, ids binary, tail binary, closed boolean, first array<binary>, first_sizes array<int>, last array<binary>, last_sizes array<int>"
_PIECE = [pa.binary(), pa.binary(), pa.binary(), pa.bool_(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.int32())]
_PIECE_NAMES = ["head", "ids", "tail", "closed", "first", "first_sizes", "last", "last_sizes"]
SPACE = b" \t\n\r\x0b\x0c"


def _piece(coder: WordEncoder, data: bytes, margin: int) -> list:
    """data encoded on its own: ids of its whole words, the parts of words at its ends, and the words next to those.

    A piece without white space is a part of a word only; closed is false.
    """
    words = data.split()
    if not words or len(words) == 1 and len(words[0]) == len(data):
        return [b"" if not words else data, b"", b"", bool(data) and not words, [], [], [], []]
    head = b"" if data[:1] in SPACE else words[0]
    tail = b"" if data[-1:] in SPACE else words[-1]
    whole = words[bool(head) : len(words) - bool(tail)]
    first, last = whole[:margin], whole[-margin:] if margin else []
    ids, *sizes = coder.encode([b" ".join(whole), *first, *last])
    sizes = [len(x) // 4 for x in sizes]
    return [head, ids, tail, True, first, sizes[: len(first)], last, sizes[len(first) :]]


def _chunk_texts(shared: np.ndarray):
    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {name: chunk for text in utf8(batch.column(0)) for name, chunk in _cut_up(text, shared) if name}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], ["chunk", "data"])

    return texts


def _chunk_pieces(path: str, margin: int):
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            rows = [_piece(coder, data, margin) for data in utf8(batch.column(1))]
            columns = zip(*rows, strict=True) if rows else [[] for _ in _PIECE]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, _PIECE, strict=True))], ["chunk", *_PIECE_NAMES])

    return encoded


_TABLES: dict[str, list[bytes]] = {}


def _tokens(path: str) -> list[bytes]:
    """The tokens of a file without a decoder by their ids, once for each Python worker, which needs no more of the file."""
    if path not in _TABLES:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        _TABLES[path] = [tokenizer.id_to_token(i).encode() for i in range(tokenizer.get_vocab_size())]
    return _TABLES[path]


def _decodes(path: str):
    """How a list of ids as bytes decodes, to bytes: without a decoder in the file its tokens are joined by spaces."""
    by_table = encoder(path).tokenizer.decoder is None

    def decode(ids: bytes | None) -> bytes:
        numbers = np.frombuffer(ids or b"", "<u4")
        if not by_table:
            return encoder(path).tokenizer.decode(numbers.tolist(), skip_special_tokens=False).encode()
        table = _tokens(path)
        return b" ".join([b" ".join([table[i] for i in numbers[at : at + RUN].tolist()]) for at in range(0, len(numbers), RUN)])

    return decode


def _whole(path: str, shared: np.ndarray | None, decode):
    """(doc_id, row_id, text) to ids, and with decode what they decode to; of documents without shared chunks only where
    shared is given."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            texts = utf8(batch.column(2))
            keep = [shared is None or not any(name for name, _ in _cut_up(x, shared)) for x in texts]
            batch = batch.filter(pa.array(keep, pa.bool_()))
            ids = list(coder.encode([x for x, k in zip(texts, keep, strict=True) if k]))
            columns = [batch.column(0), batch.column(1), pa.array(ids, pa.binary())]
            if decode:
                columns.append(pa.array([decode(x) for x in ids], pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row_id", "ids", "text"][: len(columns)])

    return encoded


def _parts(path: str, shared: np.ndarray, margin: int):
    """(doc_id, row_id, text) of documents with shared chunks to their parts in order: names of chunks, or pieces."""
    open_piece = [None] * len(_PIECE)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            rows = []
            for doc, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True):
                cut_up = _cut_up(text, shared)
                if any(name for name, _ in cut_up):
                    rows += [[doc, row, at, name, *(open_piece if name else _piece(coder, data, margin))] for at, (name, data) in enumerate(cut_up)]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), *_PIECE]
            columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "row_id", "at", "chunk", *_PIECE_NAMES])

    return parts


def _joined(coder: WordEncoder, words: list[bytes], before: dict | None, after: dict | None) -> bytes | None:
    """Ids of the words between two pieces, encoded again with words of both pieces around them.

    One word of either side is taken, then two, four and so on, until the ids around agree with those that the pieces
    have. None if they don't within the words that the pieces kept.
    """
    reach = 1
    while True:
        sides = [(x[f"{side}"], x[f"{side}_sizes"]) if x else ([], []) for x, side in ((before, "last"), (after, "first"))]
        left, right = sides[0][0][-reach:], sides[1][0][:reach]
        if (before and not left) or (after and not right):
            return None
        a, z = sum(sides[0][1][-reach:]), sum(sides[1][1][:reach])
        got = coder._ids(b" ".join([*left, *words, *right]).decode("utf-8", "replace")).tobytes()
        end = len(got) - 4 * z
        if end >= 4 * a and (not before or before["ids"].endswith(got[: 4 * a])) and (not after or after["ids"].startswith(got[end:])):
            return got[4 * a : end]
        if reach >= max(len(sides[0][0]), len(sides[1][0])):
            return None
        reach *= 2


def joined_ids(coder: WordEncoder, pieces: list[dict]) -> bytes | None:
    """Ids of the text that the pieces are in order; None if a join doesn't come to agreement, so that the whole text has
    to be encoded."""
    out: list[bytes] = []
    before, words, part = None, [], b""
    for piece in pieces:
        word = part + piece["head"]
        if not piece["closed"]:
            part = word
            continue
        words, part = [*words, word] if word else words, piece["tail"]
        if piece["ids"]:
            ids = _joined(coder, words, before, piece) if words or before else b""
            if ids is None:
                return None
            out += [ids, piece["ids"]]
            before, words = piece, []
    words = [*words, part] if part else words
    ids = _joined(coder, words, before, None) if words else b""
    return None if ids is None else b"".join([*out, ids])


def _stitched(path: str):
    """Parts sorted by document and place to (doc_id, row_id, ids), one document at a time; ids are null if not settled."""

    def stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, own, pieces = encoder(path), None, []

        def row(done: list[tuple]) -> None:
            if own is not None:
                done.append((*own, joined_ids(coder, pieces)))

        def batch_of(done: list[tuple]) -> pa.RecordBatch:
            doc, number, ids = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(number, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "row_id", "ids"])

        for batch in batches:
            done: list[tuple] = []
            for r in batch.to_pylist():
                if own != (r["doc_id"], r["row_id"]):
                    row(done)
                    own, pieces = (r["doc_id"], r["row_id"]), []
                pieces.append(r)
            if done:
                yield batch_of(done)
        done = []
        row(done)
        if done:
            yield batch_of(done)

    return stitched


IDS = "doc_id long, row_id long, ids binary"


def _coded(docs: DataFrame, key: str, text: str, path: str, margin: int, map_bits: int, with_text: bool) -> DataFrame:
    """(doc_id, ids) of encode_documents, and with_text also what the ids decode to, from the task that made them."""
    decode = _decodes(path) if with_text else None
    schema, out = (f"{IDS}, text string", ["doc_id", "ids", "text"]) if with_text else (IDS, ["doc_id", "ids"])
    rows, name = with_row_id(docs, key)
    texts = rows.select(F.col(key).cast("long").alias("doc_id"), F.col(name).alias("row_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    if not encoder(path).by_words:
        return texts.mapInArrow(_whole(path, None, decode), schema).select(*out)
    shared = _map_of_shared(texts.select("text"), map_bits)
    alone = texts.mapInArrow(_whole(path, shared, decode), schema).select(*out)
    if not shared.any():
        return alone
    contents = texts.select("text").mapInArrow(_chunk_texts(shared), "chunk binary, data binary").groupBy("chunk").agg(F.first("data").alias("data"))
    encoded = cut(contents.mapInArrow(_chunk_pieces(path, margin), f"chunk binary, {PIECE}"), "chunks", codec="zstd")
    parts = cut(texts.mapInArrow(_parts(path, shared, margin), f"doc_id long, row_id long, at int, chunk binary, {PIECE}"), "parts", codec="zstd")
    place, pieces = ["doc_id", "row_id", "at"], parts.where("chunk IS NULL").drop("chunk")
    reused = parts.where("chunk IS NOT NULL").select(*place, "chunk").join(encoded, "chunk").drop("chunk")
    ordered = reused.unionByName(pieces).repartition("doc_id", "row_id").sortWithinPartitions(*place)
    put = cut(ordered.mapInArrow(_stitched(path), IDS), "joined", codec="zstd")
    settled, unsettled = put.where("ids IS NOT NULL").select("doc_id", "ids"), put.where("ids IS NULL").select("doc_id", "row_id")
    whole = alone.unionByName(decode_documents(settled, path) if with_text else settled)
    if not unsettled.isEmpty():
        again = of_rows(texts, "doc_id", "row_id", unsettled, "left_semi")
        whole = whole.unionByName(again.mapInArrow(_whole(path, None, decode), schema).select(*out))
    return whole


def encode_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, margin: int = MARGIN, map_bits: int = MAP_BITS) -> DataFrame:
    """(doc_id, ids) of every row: the ids of its whole text, little-endian unsigned 32-bit integers.

    They equal Tokenizer.encode(text, add_special_tokens=False) of the tokenizers library. Texts are cut into chunks
    where a rolling hash says so. Only the chunks' 128-bit names are shuffled to find those that occur more than once;
    a bit map of fixed size, map_bits (a multiple of 32768), tells tasks of them. Each of those chunks is moved and
    encoded once, by name. A document without one is encoded where it is. The other documents are put together from ids
    of shared chunks and of the text between them; at each join the words there are encoded again, until the ids around
    agree.

    A tokenizer that doesn't take words (runs without ASCII white space) one by one gets whole texts, and so does a
    document with a join without agreement within margin words. Null texts are empty and have no ids; null keys and
    repeated rows are rows like any other, of equal texts with equal ids. No rows give none. Other columns are not read.
    """
    return _coded(docs, key, text, tokenizer or default_tokenizer(), margin, map_bits, with_text=False)


def decode_documents(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, ids) with the text that the ids decode to, as the library's decode(ids, skip_special_tokens=False).

    A tokenizer file without a decoder has its tokens joined by spaces. Null ids are none and decode to an empty text.
    """
    decode = _decodes(tokenizer or default_tokenizer())

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([decode(ids) for ids in batch.column(1).to_pylist()], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], ["doc_id", "ids", "text"])

    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids")
    return rows.mapInArrow(decoded, "doc_id long, ids binary, text string")


def round_trip(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, margin: int = MARGIN, map_bits: int = MAP_BITS) -> DataFrame:
    """(doc_id, ids, text): decode_documents of encode_documents, but with one Python worker a task for both."""
    return _coded(docs, key, text, tokenizer or default_tokenizer(), margin, map_bits, with_text=True)
