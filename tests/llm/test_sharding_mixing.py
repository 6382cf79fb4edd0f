import zlib
from collections import defaultdict

import numpy as np

from tidemark.llm.mixing import mix_documents, mixed_documents
from tidemark.llm.sharding import jump_hash, shard_documents
from tests.llm.conftest import WORD


def test_jump_hash_moves_only_into_the_new_shard_and_is_even():
    keys = np.arange(200_000)
    old, new = jump_hash(keys, 40), jump_hash(keys, 41)
    moved = old != new
    assert set(new[moved]) == {40}
    assert abs(moved.mean() - 1 / 41) < 0.002
    assert np.bincount(old).min() > 0.9 * 5000
    assert (jump_hash(keys, 1) == 0).all()


def test_jump_hash_step_by_step():
    def plain(key, shards):
        x = (key + 0x9E3779B97F4A7C15) % 2**64
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
        x ^= x >> 31
        at = ahead = 0
        while ahead < shards:
            at = ahead
            x = (x * 2862933555777941757 + 1) % 2**64
            ahead = int((at + 1) * (2.0**31 / ((x >> 33) + 1)))
        return at

    keys = [0, 1, 2, 17, -1, 2**62, 12345]
    for n in (1, 2, 40, 41):
        assert jump_hash(np.array(keys), n).tolist() == [plain(k, n) for k in keys]


def check_shards(rows, docs):
    assert len(rows) == len(docs)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 40) and r["law"] == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = sorted(((d["doc_id"] is not None, d["doc_id"] or 0), len((d["text"] or "").encode()) + 16, zlib.crc32((d["text"] or "").encode())) for d in docs)
    assert sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r["size"], r["text_crc32"]) for r in rows) == want


def test_shards_of_edge_rows(null_key_docs, clashing_docs, no_docs):
    for docs in (null_key_docs, clashing_docs, no_docs):
        check_shards(shard_documents(docs, 40).collect(), docs.collect())


def test_many_equal_rows_get_a_slot_each(spark):
    docs = spark.range(5000).selectExpr("7L AS doc_id", "'x' AS text")
    assert sorted(r["slot"] for r in shard_documents(docs, 40).collect()) == list(range(5000))


def reshared(sizes, weights, most):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, full = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in full]
        total = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / total > most * sizes[s] + 1e-9] if free else []
        if not over:
            return {**full, **{s: left * w[s] / total for s in free}}
        for s in over:
            full[s] = most * sizes[s]
            left -= full[s]


def check_mix(rows, docs):
    sizes = defaultdict(int)
    for d in docs:
        sizes[d["source"]] += len(WORD.findall(d["text"] or ""))
    targets = reshared(sizes, [5, 2, 1], 3)
    taken = defaultdict(int)
    assert len(rows) == len(docs)
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - targets[r["source"]]) < 1e-6
        taken[r["source"]] += r["taken"]
    assert all(targets[s] - 1 <= taken[s] <= targets[s] + 1e-6 for s in sizes)


def test_mix_of_edge_rows(null_key_docs, clashing_docs, no_docs, spark, sf_dir):
    for docs in (null_key_docs, clashing_docs, no_docs, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        check_mix(mix_documents(docs).collect(), docs.collect())


def test_reruns_agree_whatever_the_partitions(null_key_docs):
    one = sorted(map(str, mix_documents(null_key_docs).collect()))
    assert one == sorted(map(str, mix_documents(null_key_docs.repartition(7)).collect()))


def test_sources_that_all_stop_at_three_times(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, "c", "y"), (3, None, "z")], "doc_id long, text string, source string")
    check_mix(mix_documents(docs, weights=[5, 2, 1]).collect(), docs.collect())


def test_the_mix_itself(clashing_docs, no_docs):
    plan = {(r["doc_id"], r["source"]): 0 for r in clashing_docs.collect()}
    for r in mix_documents(clashing_docs).collect():
        plan[r["doc_id"], r["source"]] += r["taken"]
    out = mixed_documents(clashing_docs)
    assert out.columns == clashing_docs.columns
    got = dict.fromkeys(plan, 0)
    for r in out.collect():
        got[r["doc_id"], r["source"]] += len(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"]) and r["size"] == "mine"
    assert got == plan
    assert mixed_documents(no_docs).count() == 0
