import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import near_dedup, substring_dedup
from tidemark.llm.exact_dedup import chunk_ends, drop_exact_copies, exact_groups
from tidemark.llm.near_dedup import drop_near_copies, minhashes, near_groups, odd_sketch, sketch_similarity
from tidemark.llm.shingling import sequence_hashes
from tidemark.llm.substring_dedup import PREFIX, deep_nodes, remove_repeats, shared_words, suffix_ranks, window_samples
from tests.llm.conftest import WORD, long_text

LOWER = {c: c + 32 for c in range(65, 91)}
BIG = 1 << 62


def key(doc_id):
    return BIG if doc_id is None else doc_id


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_chunks_cover_the_text_and_edits_move_few():
    data = np.random.default_rng(1).integers(97, 123, 300_000, dtype=np.uint8).tobytes()
    ends = chunk_ends(data)
    assert ends == sorted(set(ends)) and ends[-1] == len(data)
    chunks = lambda d: [d[a:b] for a, b in zip([0, *chunk_ends(d)], chunk_ends(d), strict=False)]
    edited = data[:1000] + b"INSERTED" + data[1000:]
    assert len(set(chunks(edited)) - set(chunks(data))) <= 2
    assert max(map(len, chunks(b"a" * 200_000))) <= 1 << 15
    assert chunk_ends(b"") == [] and chunk_ends(b"abc") == [3]


def check_exact(rows, docs):
    groups = {}
    for d in docs:
        groups.setdefault(norm(d["text"]), []).append(d["doc_id"])
    assert len(rows) == len(docs)
    sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = Counter()
    for r in rows:
        ids = sha[r["text_sha256"]]
        assert key(r["keep_id"]) == min(map(key, ids)) and r["group_size"] == len(ids)
        if r["kept"]:
            assert r["doc_id"] == r["keep_id"]
            kept[r["text_sha256"]] += 1
    assert set(kept) == set(sha) and set(kept.values()) <= {1}


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_groups(null_key_docs, clashing_docs, no_docs, spark, sf_dir, bits):
    for docs in (null_key_docs, clashing_docs, no_docs, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        check_exact(exact_groups(docs, hash_bits=bits).collect(), docs.collect())


def test_dropping_copies_keeps_columns_and_one_row_of_each(clashing_docs, no_docs):
    out = drop_exact_copies(clashing_docs)
    assert out.columns == clashing_docs.columns
    rows = out.collect()
    assert sorted(r["doc_id"] for r in rows) == [1, 3, 4, 6, 7, 9, 10, 11, 12, 13, 14]
    assert {r["row_id"] for r in rows} == {"mine"}
    assert drop_exact_copies(no_docs).count() == 0


def sets_of(docs, length):
    out = []
    for d in docs:
        w = WORD.findall((d["text"] or "").translate(LOWER))
        out.append(frozenset(tuple(w[k : k + length]) for k in range(max(1, len(w) - length + 1))) if w else frozenset())
    return out


def brute_components(docs, length, percent=80):
    sets, parent = sets_of(docs, length), {}

    def find(a):
        while parent.get(a, a) != a:
            a = parent[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    low = {}
    for i, d in enumerate(docs):
        low[find(i)] = min(low.get(find(i), BIG), key(d["doc_id"]))
    return [(d["doc_id"], len(sets[i]), low[find(i)]) for i, d in enumerate(docs)]


def check_near(docs, length):
    local = docs.collect()
    got = [(r["doc_id"], r["n_shingles"], key(r["component_id"])) for r in near_groups(docs, shingle_words=length).collect()]
    assert Counter(got) == Counter(brute_components(local, length))


@pytest.mark.parametrize("small", [1024, 4])
def test_near_groups_equal_brute_force(null_key_docs, no_docs, spark, sf_dir, monkeypatch, small):
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", small)
    r = random.Random(9)
    near = []
    for g in range(6):
        words = [f"g{g}w{i}" for i in range(200)]
        for c in range(25):
            mine = list(words)
            for _ in range(r.randint(0, 14)):
                mine[r.randrange(200)] = f"x{r.random()}"
            near.append((1000 + g * 100 + c, " ".join(mine)))
    chain = [" ".join(f"c{i}" for i in range(k * 9, k * 9 + 120)) for k in range(10)]
    made = spark.createDataFrame([*near, *((5000 + k, t) for k, t in enumerate(chain))], "doc_id long, text string")
    for docs in (null_key_docs, no_docs, made):
        check_near(docs, 4)
    if small == 1024:
        check_near(spark.read.parquet(f"{sf_dir}/documents.parquet"), 5)


def test_sketches_tell_similarity():
    r = np.random.default_rng(4)
    for share in (0.7, 0.8, 0.9):
        common = r.integers(0, 1 << 63, 4000).astype(np.uint64)
        own = int(4000 * (1 - share) / (2 * share))
        one, other = (np.unique(np.concatenate([common, r.integers(0, 1 << 63, own).astype(np.uint64)])) for _ in range(2))
        bits = int(np.bitwise_count((odd_sketch(minhashes(one)) ^ odd_sketch(minhashes(other))).view(np.uint64)).sum())
        assert abs(sketch_similarity(bits) - share) < 0.15
    assert near_dedup.most_differing(0.8) > 60


def test_dropping_near_copies(clashing_docs, no_docs):
    out = drop_near_copies(clashing_docs)
    assert out.columns == clashing_docs.columns
    ids = [r["doc_id"] for r in out.collect()]
    # texts without words stay; 9 has the words of 7 in another turn, and 13 those of 12 in other case
    assert sorted(map(key, ids)) == [1, 4, 5, 6, 7, 10, 11, 12, 14]
    assert drop_near_copies(no_docs).count() == 0


def test_documents_without_keys_are_no_copies_of_each_other(spark, tmp_path):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(None, words), (None, words + " more"), (None, "quite another text that has some words"), (None, None), (None, None), (7, "a b c d e f g"), (8, "h i j k l m n")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    for docs in (spark.read.parquet(str(tmp_path / "t")), spark.createDataFrame(rows, "doc_id long, text string")):
        left = [tuple(r) for r in drop_near_copies(docs).collect()]
        assert Counter(left) - Counter({(None, words): 1, (None, words + " more"): 1}) == Counter({rows[2]: 1, (None, None): 2, rows[5]: 1, rows[6]: 1})
        assert len(left) == 6
        assert Counter(tuple(r) for r in drop_exact_copies(docs).collect()) == Counter({x: 1 for x in rows})


def brute_removed(docs, window):
    first, out = {}, []
    words = [WORD.findall(d["text"] or "") for d in docs]
    for d, w in zip(docs, words, strict=True):
        for k in range(len(w) - window + 1):
            t = tuple(w[k : k + window])
            first[t] = min(first.get(t, BIG), key(d["doc_id"]))
    for d, w in zip(docs, words, strict=True):
        keep = [True] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < key(d["doc_id"]):
                keep[k : k + window] = [False] * window
        left = " ".join(x for x, y in zip(w, keep, strict=True) if y)
        out.append((d["doc_id"], len(w), keep.count(False), hashlib.sha256(left.encode()).hexdigest()))
    return out


def check_substrings(docs, **how):
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in remove_repeats(docs, **how).collect()]
    assert Counter(got) == Counter(brute_removed(docs.collect(), how.get("window", 50)))


@pytest.mark.parametrize("tree_words", [100_000, 2_000, 300, 0])
def test_repeats_equal_brute_force(null_key_docs, no_docs, spark, tree_words):
    r = random.Random(2)
    passage = [f"p{i}" for i in range(70)]
    rows = []
    for d in range(60):
        w = [f"r{r.randrange(10**6)}" for _ in range(r.randint(0, 200))]
        at = r.randint(0, len(w))
        cut = r.choice([70, 70, 50, 49, 60])
        rows.append((d, " ".join([*w[:at], *passage[70 - cut :], *w[at:]])))
    rows += [(100, " ".join(passage * 3)), (101, " ".join(["a"] * 300)), (102, " ".join(["a"] * 120)), (103, "\n".join(passage))]
    for docs in (null_key_docs, no_docs, spark.createDataFrame(rows, "doc_id long, text string")):
        check_substrings(docs, tree_words=tree_words)


@pytest.mark.parametrize("tree_words", [100_000, 0])
def test_long_periodic_texts(spark, monkeypatch, tree_words):
    """Texts of one word or a few, of many lengths, beside others: one run of thousands of windows each."""
    rows = [(d, " ".join(["ha"] * n)) for d, n in enumerate([10_000, 3_000, 49, 50, 7_001, 12_345, 3_000])]
    rows += [(20 + d, " ".join(f"{'abc'[k % (2 + d)]}" for k in range(4_000 + d))) for d in range(2)]
    rows += [(30, " ".join(f"w{k}" for k in range(5_000))), (31, " ".join(f"w{k}" for k in range(2_100, 4_900))), (32, "x " * 60 + " ".join(["ha"] * 60))]
    check_substrings(spark.createDataFrame(rows, "doc_id long, text string"), tree_words=tree_words)


def test_groups_are_bounded_in_words():
    words = np.full(30_000, 7, np.uint64)
    parts = list(substring_dedup._split(words[:29_951].view(np.int64), substring_dedup.RUN_WINDOWS))
    assert parts[0][0] == 0 and parts[-1][1] == 29_951 and max(b - a for a, b in parts) == substring_dedup.RUN_WINDOWS
    assert all(b == c for (_, b), (c, _) in zip(parts, parts[1:], strict=False))
    assert list(substring_dedup._split(np.array([1, 1, 2, 2, 2, 1]), 2)) == [(0, 2), (2, 4), (4, 5), (5, 6)]


def test_kept_words_and_clashing_columns(clashing_docs):
    kept = {r["doc_id"]: r["kept"] for r in remove_repeats(clashing_docs).collect()}
    assert kept[3] == b"eleven" or kept[3] is not None
    check_substrings(clashing_docs)


def test_ranks_order_suffixes_by_their_first_words():
    r = np.random.default_rng(0)
    words = r.integers(0, 2, 500).astype(np.uint64)
    for depth in (1, 3, 7, 50):
        rank = suffix_ranks(words, depth)
        assert len(rank) == len(words) - depth + 1
        ordered = sorted((tuple(words[k : k + depth].tolist()), int(rank[k])) for k in range(len(rank)))
        assert [x[1] for x in ordered] == sorted(rank.tolist())
        assert len({x[0] for x in ordered}) == len(set(ordered)) == int(rank.max()) + 1


def test_deep_nodes_hold_the_suffixes_that_share_a_window():
    r = np.random.default_rng(1)
    words = r.integers(0, 3, 400).astype(np.uint64)
    places = np.sort(r.choice(390, 300, replace=False))
    leaves, firsts = deep_nodes(words, places, 5)
    got = {frozenset(places[x].tolist()) for x in np.split(leaves, firsts[1:])}
    want = {}
    for k in places.tolist():
        want.setdefault(tuple(words[k : k + 5].tolist()), set()).add(k)
    assert got == {frozenset(x) for x in want.values()}


@pytest.mark.parametrize("length", [10, 30, 40, 47, 50])
def test_longer_prefixes_are_words_that_all_windows_of_a_part_share(length):
    """Equal windows get equal prefixes, whatever stands around them; windows with equal prefixes share that many words."""
    r = random.Random(5)
    passage = [r.randrange(1, 1 << 62) for _ in range(75)]
    texts = [[r.randrange(1, 1 << 62) for _ in range(r.randint(0, 60))] + passage[r.randint(0, 5) :] + [7] * r.randint(0, 90) for _ in range(30)]
    prefix_of, share = {}, {}
    for text in texts:
        words = np.array(text, np.uint64)
        samples = window_samples(words, 50)
        edges = [0, *(np.flatnonzero(np.diff(samples)) + 1).tolist(), len(samples)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            part = words[a : b + 49]
            for k, p in enumerate(shared_words(part, int(samples[a]), b - a, 50, length).tolist()):
                window = tuple(part[k : k + 50].tolist())
                assert prefix_of.setdefault(window, p) == p
                pieces = {window[i : i + length] for i in range(51 - length)}
                share[p] = share.get(p, pieces) & pieces
    assert all(share.values()) and len(share) >= 5
    assert len(sequence_hashes(np.arange(60, dtype=np.uint64), PREFIX)) == 51


def test_very_long_texts(spark):
    docs = spark.createDataFrame([(1, long_text(60_000)), (2, "x " + long_text(60_000))], "doc_id long, text string")
    check_substrings(docs)
    check_near(docs, 5)


def test_texts_of_a_million_words(spark):
    """Exact copies among them, and substrings that they share, are found as in any other."""
    words = [f"w{(i * 7919) % 400_009}" for i in range(1_000_000)]
    rows = [(1, " ".join(words)), (2, "\n".join(words)), (3, " ".join(words[:-1])), (4, "x " + " ".join(words[500_000:500_070]) + " y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_groups(docs).collect()) == [(1, 1, 2), (2, 1, 2), (3, 3, 1), (4, 4, 1)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in remove_repeats(docs).collect()}
    assert got == {1: (1_000_000, 0), 2: (1_000_000, 1_000_000), 3: (999_999, 999_999), 4: (72, 70)}
