"""Token ids in flat unsigned integer files with 64-bit document offsets."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.tokens import default_tokenizer, encoder, utf8
from tidemark.plans.scratch import mounted

END_ID = 1
READ_DOCS = 2048


def write_token_files(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> dict:
    """Write the ids of every whole text, each followed by the end id, in ascending key order; returns the manifest.

    folder must be mounted on the driver and all executors. Each range partition p writes three files:
    part-p.bin, the ids, uint16 where the vocabulary allows it, else uint32; part-p.idx, int64 offsets of documents
    in it and their end; part-p.doc, int64 keys, and one byte for each key that tells if it is null. Null keys come
    first, equal keys by text; a null text is empty; other columns are not read. A task writes under a name of its
    own and renames, so a retried task replaces whole files. manifest.json has the id type and for each partition
    its documents, tokens, and its base: the prefix sum of the tokens before it, one number for each partition.
    """
    spark, path = docs.sparkSession, tokenizer or default_tokenizer()
    place = mounted(folder)
    os.makedirs(place, exist_ok=True)
    from tokenizers import Tokenizer

    kind = "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own = TaskContext.get().partitionId(), uuid.uuid4().hex
        names = [f"{place}/part-{part:06d}.{x}" for x in ("bin", "idx", "doc")]
        coder, docs_seen, tokens = encoder(path), 0, 0
        files = [open(f"{x}.{own}", "wb") for x in names]
        try:
            keys_out, nulls_out = [], []
            for batch in batches:
                lengths = []
                for ids in coder.encode(utf8(batch.column(1))):
                    out = np.append(np.frombuffer(ids, "<u4"), END_ID).astype(kind)
                    files[0].write(out.tobytes())
                    lengths.append(len(out))
                ends = tokens + np.cumsum(lengths, dtype="<i8")
                files[1].write((ends - np.array(lengths, "<i8")).astype("<i8").tobytes())
                tokens, docs_seen = int(ends[-1]) if lengths else tokens, docs_seen + len(lengths)
                keys_out.append(np.array(batch.column(0).fill_null(0), dtype="<i8"))
                nulls_out.append(np.array(batch.column(0).is_null(), dtype="u1"))
            files[1].write(np.array([tokens], "<i8").tobytes())
            for some in (*keys_out, *nulls_out):
                files[2].write(some.tobytes())
        finally:
            for f in files:
                f.close()
        for x in names:
            os.replace(f"{x}.{own}", x)
        yield pa.RecordBatch.from_pydict({"part": [part], "docs": [docs_seen], "tokens": [tokens]})

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    done = sorted(ordered.mapInArrow(written, "part long, docs long, tokens long").collect())
    bases = np.cumsum([0, *(r["tokens"] for r in done)]).tolist()
    manifest = {"ids": kind, "tokenizer": os.path.basename(path), "end_id": END_ID, "parts": [[r["part"], r["docs"], r["tokens"], b] for r, b in zip(done, bases, strict=False)]}
    with open(f"{place}/manifest.json", "w") as f:
        json.dump(manifest, f)
    return manifest


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Read the files back through memory maps: doc_id, start (ids before the document in all), n_tokens, ids.

    ids are little-endian unsigned 32-bit integers. Each task maps the files of one partition.
    """
    place = mounted(folder)
    with open(f"{place}/manifest.json") as f:
        manifest = json.load(f)
    kind = manifest["ids"]
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, n, tokens, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name = f"{place}/part-{part:06d}"
                if not n:
                    continue
                ids = np.memmap(f"{name}.bin", kind, "r", shape=(tokens,))
                at = np.memmap(f"{name}.idx", "<i8", "r", shape=(n + 1,))
                keys = np.memmap(f"{name}.doc", "<i8", "r", shape=(n,))
                null = np.memmap(f"{name}.doc", "u1", "r", offset=8 * n, shape=(n,))
                for lo in range(0, n, READ_DOCS):
                    hi = min(n, lo + READ_DOCS)
                    bounds = at[lo : hi + 1].tolist()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.array(keys[lo:hi]), mask=np.array(null[lo:hi], dtype=bool)),
                            pa.array(base + np.array(at[lo:hi])),
                            pa.array(np.diff(at[lo : hi + 1])),
                            pa.array([ids[a:b].astype("<u4").tobytes() for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary()),
                        ],
                        schema=schema,
                    )

    files = spark.createDataFrame([tuple(p) for p in manifest["parts"]], "part long, docs long, tokens long, base long")
    return files.repartition(max(1, len(manifest["parts"]))).mapInArrow(mapped, "doc_id long, start long, n_tokens long, ids binary")
