"""WARC archives with revisit records, and a reader whose tasks scan byte ranges."""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.scratch import cut, mounted

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
ID_SPACE = uuid.UUID("6f0d9e4c-53c8-5a0f-9d0e-2b8f6f1d7a11")
HTTP_OK = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
BLOCK = 1 << 18
DATE = "2024-01-01T00:00:00Z"
READ_SCHEMA = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, file string, offset long"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(ID_SPACE, str(page_id))}>"


def _one_line(text: str | None) -> str:
    return " ".join((text or "").split())


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member of its own. A revisit has the HTTP header, with the length, and no payload."""
    http = HTTP_OK.format(len(payload)).encode()
    body = http if revisit else http + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_one_line(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def revisits(pages: DataFrame, key: str, html: str, least_bytes: int) -> DataFrame:
    """(page, sha, refers_to) of the rows that repeat the payload of the row with the largest key.

    A row of a group with no key at all refers to nothing, and then all of the group are responses.
    """
    body = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    light = cut(pages.select(F.col(key).cast("long").alias("page"), F.sha2(body, 256).alias("sha"), F.octet_length(body).alias("bytes")).where(F.col("bytes") >= least_bytes), "payloads")
    groups = light.groupBy("sha").agg(F.max("page").alias("refers_to"), F.count("*").alias("n")).where("n > 1 AND refers_to IS NOT NULL")
    groups = cut(groups.select(F.col("sha").alias("_sha"), "refers_to"), "repeated")
    found = light.join(groups, F.col("sha") == F.col("_sha"))
    return found.where(~F.col("page").eqNullSafe(F.col("refers_to"))).select("page", "sha", "refers_to").distinct()


def write_warc(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> list[str]:
    """Write a record for each page; returns the files, one for each partition that has pages.

    Of pages with equal payloads (the html in UTF-8, null: empty) of at least least_bytes, that with the largest key
    is a response and the others revisit it; all smaller ones are responses. Groups are found by SHA-256. Rows that
    repeat a key and payload are records of the same type each; null keys revisit if the group has a key; no rows give no
    files. Other columns, whatever their names, are not read. folder must be mounted on the driver and all executors; tasks
    write under names of their own and rename.
    """
    place = mounted(folder)
    os.makedirs(place, exist_ok=True)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own, n = TaskContext.get().partitionId(), uuid.uuid4().hex, 0
        name = f"{place}/part-{part:06d}.warc.gz"
        with open(f"{name}.{own}", "wb") as f:
            for batch in batches:
                n += batch.num_rows
                for page, where, body, refers, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    f.write(encode_record(page, where, body or b"", refers, again))
        os.replace(f"{name}.{own}", name)
        yield pa.RecordBatch.from_pydict({"file": [name], "records": [n]})

    link = F.col(url).cast("string") if url in pages.columns else F.lit(None).cast("string")
    body = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), link.alias("url"), body.alias("body"), F.sha2(body, 256).alias("payload_sha"))
    again = revisits(pages, key, html, least_bytes).withColumn("_again", F.lit(True))
    marked = rows.join(again, F.col("page_id").eqNullSafe(F.col("page")) & (F.col("payload_sha") == F.col("sha")), "left")
    out = marked.select("page_id", "url", "body", "refers_to", F.coalesce("_again", F.lit(False)).alias("again"))
    return sorted(r["file"] for r in out.mapInArrow(written, "file string, records long").collect() if r["records"])


class _Window:
    """A file read in blocks from a place on."""

    def __init__(self, f, at: int):
        self.f, self.at, self.data = f, at, bytearray()
        f.seek(at)

    def fill(self, need: int) -> bool:
        while len(self.data) < need:
            more = self.f.read(BLOCK)
            if not more:
                return False
            self.data += more
        return True

    def skip(self, n: int) -> None:
        del self.data[:n]
        self.at += n


def _member(w: _Window) -> tuple[bytes, int] | None:
    """The gzip member at the start of w and its length, if it's whole and begins with a WARC header."""
    packed, out, size, used, seen = zlib.decompressobj(31), [], 0, 0, False
    try:
        while not packed.eof:
            if not w.fill(used + 1):
                return None
            block = w.data[used : used + BLOCK]
            out.append(packed.decompress(block))
            used += len(block) - len(packed.unused_data)
            size += len(out[-1])
            if not seen and size >= len(VERSION):
                if not b"".join(out).startswith(b"WARC/1."):
                    return None
                seen = True
    except zlib.error:
        return None
    return (b"".join(out), used) if seen else None


def records_in(path: str, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header, block) of each record whose gzip member starts in [start, end) of the file.

    The task looks for the gzip magic from its start on and takes a place as a member only if it inflates to a WARC
    header; by chance compressed bytes hold the magic too. After a member, the next is tried at once; where none
    is, for instance after damage, the search goes on byte by byte.
    """
    with open(path, "rb") as f:
        w = _Window(f, start)
        while w.at < end:
            if not w.fill(len(MAGIC)):
                return
            hit = w.data.find(MAGIC)
            if hit < 0:
                w.skip(len(w.data) - len(MAGIC) + 1)
                continue
            w.skip(hit)
            if w.at >= end:
                return
            got = _member(w)
            if got is None:
                w.skip(1)
                continue
            data, used = got
            head, _, rest = data.partition(b"\r\n\r\n")
            lines = [x.partition(": ") for x in head.decode("utf-8", "replace").split("\r\n")[1:]]
            header = {k.lower(): v for k, _, v in lines}
            yield w.at, header, rest[: int(header.get("content-length", 0))]
            w.skip(used)


def read_warc(spark: SparkSession, files: list[str], split_bytes: int = 32 << 20) -> DataFrame:
    """The records of the files, with splits of split_bytes: a row for each response and revisit record.

    payload is that of the record itself: null for a revisit, empty for an empty one. payload_bytes is the full
    payload's, from the HTTP header; payload_digest is bare. A record without a key or URL has null there; repeated
    records come as often as they are stored; no files, or empty ones, give no rows. Tasks look up the files' sizes,
    and a record of any length is read whole by the task in whose split it starts. Damaged members are passed over.
    """
    def splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column(0).to_pylist():
                size = os.path.getsize(path)
                found += [(path, at, min(size, at + split_bytes)) for at in range(0, size, split_bytes)]
            yield pa.RecordBatch.from_pylist([dict(zip(("file", "start", "stop"), x, strict=True)) for x in found], pa.schema({"file": pa.string(), "start": pa.int64(), "stop": pa.int64()}))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int64()]
        out: list[tuple] = []
        held = 0

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for at, header, block in records_in(path, start, end):
                    kind = header.get("warc-type")
                    if kind not in ("response", "revisit"):
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
                    page, refers = header.get("x-page-id", ""), header.get("x-refers-to-page", "")
                    digest = header.get("warc-payload-digest", "").removeprefix("sha1:")
                    out.append((int(page) if page else None, header.get("warc-target-uri"), kind, length, digest, int(refers) if refers else None, payload if kind == "response" else None, path, at))
                    held += len(payload)
                    if len(out) >= 4096 or held > 16 << 20:
                        yield flushed()
                        out, held = [], 0
        if out:
            yield flushed()

    tasks = max(len(files), int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    named = spark.createDataFrame([(f,) for f in files], "file string").repartition(tasks)
    return named.mapInArrow(splits, "file string, start long, stop long").repartition(tasks).mapInArrow(scanned, READ_SCHEMA)
