import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.packing import OpenBins, best_fit_decreasing, pack_documents, packed_sequences
from tidemark.llm.token_files import read_token_files, write_token_files
from tidemark.llm.tokens import WordEncoder, default_tokenizer


def library_ids(text):
    from tokenizers import Tokenizer

    if not hasattr(library_ids, "t"):
        library_ids.t = Tokenizer.from_file(default_tokenizer())
    return library_ids.t.encode(text or "", add_special_tokens=False).ids


CODER = WordEncoder(default_tokenizer())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aAzZéÉßİΣ.,!'#0 \n\t<|>sdẞ\x01\x85 中éendoftx"), max_size=40))
def test_ids_equal_the_librarys(text):
    assert np.frombuffer(next(CODER.encode([text.encode()])), "<u4").tolist() == library_ids(text)


def test_ids_stay_right_when_words_are_forgotten(monkeypatch):
    monkeypatch.setattr("tidemark.llm.tokens.REMEMBERED", 5)
    coder = WordEncoder(default_tokenizer())
    texts = ["the quick brown fox jumps over it", "the lazy dog, Straße x\x01y \x01", "a b c d e f g h"]
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode([t.encode() for t in texts])] == [library_ids(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_runs_place_each_piece_as_best_fit_decreasing_does(sizes):
    capacity, counts = 50, defaultdict(int)
    for s in sizes:
        counts[s] += 1
    bins = defaultdict(list)
    for size, lo, hi, per, first, offset in best_fit_decreasing(counts, capacity):
        for k in range(lo, hi):
            bins[first + (k - lo) // per].append((offset + (k - lo) % per * size, size))
    assert sorted(s for b in bins.values() for _, s in b) == sorted(sizes)
    for b in bins.values():
        at = 0
        for offset, size in sorted(b):
            assert offset == at
            at += size
        assert at <= capacity
    plain = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, left in enumerate(plain) if left >= s]
        if fits:
            plain[min(fits, key=lambda i: plain[i])] -= s
        else:
            plain.append(capacity - s)
    assert len(bins) == len(plain)
    assert sorted(capacity - sum(s for _, s in b) for b in bins.values()) == sorted(plain)


def test_segment_tree_finds_the_tightest():
    bins = OpenBins(100)
    for left in (3, 40, 41, 100):
        bins.add(left, left, 1)
    assert [bins.tightest(n) for n in (1, 3, 4, 40, 41, 42, 100)] == [3, 3, 40, 40, 41, 100, 100]
    bins.take(100)
    assert bins.tightest(42) is None


def check_pack(rows, docs):
    per_doc = defaultdict(list)
    for d in docs:
        ids = [*library_ids(d["text"]), 1]
        per_doc[d["doc_id"]] += [(p, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())) for p, at in enumerate(range(0, len(ids), 4096))]
    got, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in per_doc.items()}
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096


def test_pack_edge_rows(null_key_docs, clashing_docs, no_docs, spark, sf_dir):
    for docs in (null_key_docs, clashing_docs, no_docs, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        check_pack(pack_documents(docs).collect(), docs.collect())


def test_files_round_trip(null_key_docs, clashing_docs, no_docs, spark, sf_dir, tmp_path):
    for n, docs in enumerate((null_key_docs, clashing_docs, no_docs, spark.read.parquet(f"{sf_dir}/documents.parquet"))):
        manifest = write_token_files(docs, str(tmp_path / str(n)))
        assert manifest["ids"] == "<u2"
        rows = sorted(read_token_files(spark, str(tmp_path / str(n))).collect(), key=lambda r: r["start"])
        keys = [r["doc_id"] for r in rows]
        assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
        at = 0
        for r in rows:
            assert r["start"] == at and len(r["ids"]) == 4 * r["n_tokens"]
            at += r["n_tokens"]
        want = sorted(((d["doc_id"] is not None, d["doc_id"] or 0), [*library_ids(d["text"]), 1]) for d in docs.collect())
        assert sorted(((r["doc_id"] is not None, r["doc_id"] or 0), np.frombuffer(r["ids"], "<u4").tolist()) for r in rows) == want


def test_writing_again_replaces_whole_files(edge_docs, spark, tmp_path):
    for _ in range(2):
        write_token_files(edge_docs, str(tmp_path))
    assert read_token_files(spark, str(tmp_path)).count() == edge_docs.count()
    assert not [p for p in tmp_path.iterdir() if p.suffix not in (".bin", ".idx", ".doc", ".json")]


def test_the_sequences_themselves(edge_docs):
    rows = packed_sequences(pack_documents(edge_docs, capacity=64, with_ids=True)).collect()
    assert all(len(r["ids"]) == 4 * r["length"] <= 256 for r in rows)
    want = sorted(i for d in edge_docs.collect() for i in [*library_ids(d["text"]), 1])
    assert sorted(i for r in rows for i in np.frombuffer(r["ids"], "<u4").tolist()) == want
    assert sum(len(r["doc_ids"]) for r in rows) == pack_documents(edge_docs, capacity=64).count()
