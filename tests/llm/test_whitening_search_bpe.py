"""Whitening, lexical search and BPE against plain loops, on odd rows of any kind."""

import hashlib
import math
import re
from collections import Counter
from fractions import Fraction
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.conftest import long_text
from tidemark.llm import bpe, lexical, whitening
from tidemark.llm.tokens import encoder
from tidemark.llm.queries import op11_whitening, op12_lexical_search, op13_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
VECTORS = "vec_id long, embedding array<float>"


def exact(vectors, components=8):
    """(n, deviations, eigenvalues, trace) by fractions; eigenvalues from the covariance rounded once."""
    x = [[math.floor(Fraction(float(np.float32(c))) * 1024) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(col) for col in zip(*x, strict=True)]
    deviations = [sum((n * c - t) ** 2 for c, t in zip(v, s, strict=True)) for v in x]
    cov = np.array([[float(Fraction(n * sum(v[i] * v[j] for v in x) - s[i] * s[j], n * n)) for j in range(d)] for i in range(d)])
    return n, deviations, np.linalg.eigvalsh(cov)[::-1], np.trace(cov)


def check_whitened(rows, vectors, components=8):
    n, deviations, values, trace = exact(vectors)
    by = {}
    for r in rows:
        by.setdefault(r["component"], []).append(r)
    assert sorted(by) == list(range(1, min(components, len(values)) + 1))
    for k, of in by.items():
        assert len(of) == n and {r["n"] for r in of} == {n}
        assert sorted(int(r["deviation"]) for r in of) == sorted(deviations)
        assert abs(of[0]["explained"] / (values[k - 1] / trace) - 1) < 1e-6
        w = np.array([r["whitened"] for r in of])
        assert abs(w.mean()) < 1e-6 and abs((w * w).mean() - 1) < 1e-6
    assert {r["identity_error"] for r in rows} == {rows[0]["identity_error"]} and rows[0]["identity_error"] < 1e-6


def test_whitening_of_odd_rows(spark):
    r = np.random.default_rng(3)
    good = [(i, [float(x) for x in r.normal(size=5) * [9, 5, 3, 2, 1]]) for i in range(60)]
    good += [(7, good[7][1]), (None, good[3][1]), (80, [1e6, -1e6, 0.0, 5.0, 1.0])]
    odd = [(90, None), (91, [1.0, None, 1.0, 1.0, 1.0]), (92, [float("nan")] + [0.0] * 4), (93, [float("-inf")] + [0.0] * 4), (94, [1.0, 2.0]), (95, [])]
    docs = spark.createDataFrame([*good, *odd], VECTORS).withColumns({c: F.lit("mine") for c in ("component", "n", "whitened", "vector", "line")})
    rows = whitening.whiten_embeddings(docs).collect()
    check_whitened(rows, [v for _, v in good])
    assert sorted({r["vec_id"] for r in rows} - {None}) == [*range(60), 80]
    one = {r["vec_id"]: r for r in rows if r["component"] == 1}
    assert sum(r["vec_id"] == 7 for r in rows) == 10 and one[7]["deviation"] > 0


def test_whitening_is_exact_for_large_numbers(spark):
    """Entries whose squares no double or long holds, over many batches and partitions."""
    r = np.random.default_rng(5)
    vectors = [[float(np.float32(x)) for x in r.normal(size=3) * [3e13, 1e9, 3]] for _ in range(400)]
    n, deviations, values, trace = exact(vectors)
    docs = spark.createDataFrame(list(enumerate(vectors)), VECTORS).repartition(7)
    vecs = whitening._vectors(docs, "vec_id", "embedding")
    net = whitening.fit(vecs, 3)
    x = [[math.floor(Fraction(c) * 1024) for c in v] for v in vectors]
    assert net.n == n and net.sums == [sum(c) for c in zip(*x, strict=True)]
    assert np.allclose(net.values, values, rtol=1e-12) and abs(net.trace / trace - 1) < 1e-12
    got = {row["vec_id"]: row["deviation"] for row in whitening.whiten_embeddings(docs).where("component = 1").collect()}
    assert all(got[i] == (dev if dev < 10**38 else None) for i, dev in enumerate(deviations)) and any(dev >= 10**38 for dev in deviations)


@pytest.mark.parametrize("vectors", [[], [[]], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [[float(i), 2.0 * i] for i in range(9)]])
def test_whitening_without_variance(spark, vectors):
    rows = whitening.whiten_embeddings(spark.createDataFrame(list(enumerate(vectors)), VECTORS)).collect()
    size = len(vectors[0]) if vectors else 0
    assert len(rows) == len(vectors) * min(8, size)
    live = {r["component"] for r in rows if r["whitened"] is not None}
    assert live == ({1} if len(vectors) == 9 else set())
    if rows and not live:
        assert {(r["identity_error"], r["explained"]) for r in rows} == {(None, None)}


def test_whitening_of_the_table(spark, sf_dir):
    vectors = [r["embedding"] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect() if r["embedding"] is not None]
    check_whitened(op11_whitening(spark, sf_dir).collect(), vectors)


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def ranked(docs, queries, k=20):
    counts = [Counter(TERM.findall((text or "").translate(LOWER))) for _, text in docs]
    n_docs, total = sum(bool(c) for c in counts), sum(sum(c.values()) for c in counts)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in queries:
        terms = Counter(TERM.findall((text or "").translate(LOWER)))
        scores = []
        for (doc, _), c in zip(docs, counts, strict=True):
            n, score = sum(c.values()), 0
            m = 75 + (25 * n * n_docs) // max(1, total)
            for t, times in terms.items():
                if t in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += times * w * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scores.append((-score, doc is None, doc if doc is not None else 0))
        out += [(item, place, None if none else doc, -s) for place, (s, none, doc) in enumerate(sorted(scores)[:k], 1)]
    return Counter(out)


def found(spark, docs, queries, k=20):
    a = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("item_id", "score", "rank", "term", "item")})
    b = spark.createDataFrame(queries, "item_id long, text string").withColumn("doc_id", F.lit("mine"))
    return Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in lexical.rank_documents(a.repartition(3), b, k).collect())


QUERIES = [(1, "one two THREE four"), (1, "one two THREE four"), (None, "seven seven w12"), (3, ""), (4, None), (5, "?! --"), (6, "nowhere"), (7, "Ä 中文热搜 one")]


def test_search_of_odd_rows(spark, edge_rows):
    docs = [(r[0], r[1]) for r in edge_rows] + [(None, "one seven"), (None, None), (40, "seven " * 40_000), (41, "a_b one-two THREE\x00four")]
    docs += [(100 + i, "one two three four five") for i in range(45)]
    assert found(spark, docs, QUERIES) == ranked(docs, QUERIES)
    assert found(spark, docs, QUERIES, 3) == ranked(docs, QUERIES, 3)
    assert not found(spark, docs[:0], QUERIES) and not found(spark, docs, QUERIES[:0]) and not found(spark, [(1, None), (2, " ")], QUERIES)


def test_search_over_many_blocks_and_query_groups(spark, monkeypatch):
    """Thresholds fall short of none of the best, with small blocks, many tasks and more queries than a pass takes."""
    r = np.random.default_rng(9)
    words = [f"w{i}" for i in range(120)]
    text = lambda n: " ".join(words[int(x)] for x in np.minimum(r.geometric(0.05, n), 119))
    docs = [(int(i), text(int(r.integers(1, 60)))) for i in r.permutation(900)] + [(2000 + i, "w1 w2 w3 w4") for i in range(300)]
    queries = [(i, text(6)) for i in range(25)] + [(99, "w1 w2 w3 w4")]
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 37)
    monkeypatch.setattr(lexical, "QUERY_BLOCK", 9)
    assert found(spark, docs, queries, 5) == ranked(docs, queries, 5)


def test_bounds_hold_for_every_impact():
    tf = np.arange(1, 3000)
    for length in (1, 7, 400, 10**6):
        exact = lexical.impacts(tf, np.full(len(tf), length), 1000, 90_000)
        byte = -(-exact // lexical.STEP)
        assert byte.max() <= 255 and (lexical.STEP * byte >= exact).all() and (lexical.STEP * (byte - 1) <= exact).all()


def test_long_texts_have_all_their_terms(monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 11)
    data = long_text(500).encode() + b" \xc3\x84\xc3\x96x-Y9"
    assert lexical.term_counts(data) == Counter(t.encode() for t in TERM.findall(data.decode().translate(LOWER)))


def test_search_of_the_tables(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    queries = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in op12_lexical_search(spark, sf_dir).collect())
    assert got == ranked(docs, queries)


TOKENIZER = Tokenizer.from_file(PATH)


def library(texts, tokenizer=TOKENIZER):
    out = []
    for doc, text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        out.append((doc, np.array(ids, "<u4").tobytes(), tokenizer.decode(ids, skip_special_tokens=False)))
    return Counter(out)


def coded(spark, texts, **how):
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("ids", "chunk", "row_id", "at", "head", "data")})
    docs, one = docs.repartition(3), lambda r: (r["doc_id"], bytes(r["ids"]), r["text"])
    rows = Counter(map(one, bpe.round_trip(docs, **how).collect()))
    assert Counter(map(one, bpe.decode_documents(bpe.encode_documents(docs, **how), how.get("tokenizer")).collect())) == rows
    return rows


def shared_texts():
    """Passages that many texts share at any place, also within words, long words without white space, odd characters."""
    r = np.random.default_rng(2)
    word = lambda: "".join(chr(int(c)) for c in r.integers(97, 123, int(r.integers(1, 9))))
    passages = [" ".join(word() for _ in range(900)) for _ in range(3)] + ["中文" * 2000 + "é" * 3000, "ha" * 20_000, "don't  stop\n\nÉté́ <|endoftext|>\t" * 300]
    rows = []
    for i in range(40):
        parts = [word() * int(r.integers(0, 4)) for _ in range(3)]
        picked = [passages[int(k)] for k in r.integers(0, len(passages), 2)]
        rows.append((i, parts[0] + picked[0][int(r.integers(0, 300)) :] + parts[1] + picked[1][: int(r.integers(2000, 60_000))] + parts[2]))
    return rows


def test_ids_equal_the_library_with_shared_chunks(spark, edge_rows):
    texts = [(r[0], r[1]) for r in edge_rows] + [(None, "no key"), (None, None), *shared_texts()]
    want = library(texts)
    assert coded(spark, texts) == want


@pytest.mark.parametrize(("margin", "full"), [(0, False), (8, True), (1, True)])
def test_ids_without_agreement_or_with_a_full_map(spark, monkeypatch, margin, full):
    """Without words to compare every join is left to whole texts; with a full map chunks that aren't shared move too."""
    if full:
        monkeypatch.setattr(bpe, "_map_of_shared", lambda texts, bits: np.full(bits // 8, 255, np.uint8))
    texts = shared_texts()[:15]
    assert coded(spark, texts, margin=margin, map_bits=1 << 15) == library(texts)


def test_no_rows_and_other_tokenizers(spark):
    assert not coded(spark, [])
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [*shared_texts()[:4], (50, "Two words, and  more\n"), (51, None)]
    assert coded(spark, texts, tokenizer=path) == library(texts, Tokenizer.from_file(path))


def test_joins_are_encoded_again_until_they_agree():
    coder = encoder(PATH)
    names = ["head", "ids", "tail", "closed", "first", "first_sizes", "last", "last_sizes"]
    piece = lambda data, margin=8: dict(zip(names, bpe._piece(coder, data, margin), strict=True))
    text = b"the quick brown fox jumps over the lazy dog " * 3
    for at in range(len(text)):
        for to in (at, at + 1, at + 30):
            parts = [text[:at], text[at:to], text[to:]]
            got = bpe.joined_ids(coder, [piece(p) for p in parts])
            assert got == coder._ids(text.decode()).tobytes()
    assert bpe.joined_ids(coder, [piece(text[:60], 0), piece(text[60:], 0)]) is None
    wrong = piece(text[60:])
    wrong["ids"] = b"\x00" * len(wrong["ids"])
    assert bpe.joined_ids(coder, [piece(text[:60]), wrong]) is None


def test_bpe_of_the_table(spark, sf_dir):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = Counter((d, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for d, ids, t in library(texts).elements())
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in op13_bpe(spark, sf_dir).collect()) == want


def test_no_task_holds_many_blocks_of_the_index(spark):
    docs = spark.range(0, 14, numPartitions=1).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(70_000)), lambda i: F.substring(F.sha2(F.concat_ws("-", i, "id"), 256), 1, 60))).alias("text"))
    index = lexical.build_index(docs)
    path = index.blocks._tidemark_path.removeprefix("file:")
    groups = [g for f in Path(path).glob("*.parquet") for m in [pq.ParquetFile(f).metadata] for g in (m.row_group(k) for k in range(m.num_row_groups))]
    assert sum(g.num_rows for g in groups) == 14 and max(g.num_rows for g in groups) <= 3 and max(g.total_byte_size for g in groups) <= lexical.HELD + (8 << 20)
