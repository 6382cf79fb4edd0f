"""Token sets meet at their rarest tokens, not at those that most of them have."""

import random

import numpy as np
import pyarrow as pa

from tidemark.operators import cluster


def part_of(sets, often):
    words = np.array([w for s in sets for w in s], np.int64)
    return cluster._Part(np.arange(len(sets)) * 10, np.array([len(s) for s in sets]), words, often)


def similar(a, b):
    return (n := len({*a} & {*b})) >= 2 and 100 * n >= 55 * min(len(a), len(b))


def often_of(sets):
    words, times = np.unique([w for s in sets for w in s], return_counts=True)
    return cluster._Often(words.astype(np.int64), times)


def test_sets_that_share_frequent_tokens_only_are_not_looked_at(monkeypatch):
    sets = [[1, 2, 3, 4, *range(100 * k, 100 * k + 6)] for k in range(1, 300)] + [[1, 2, *range(100, 105), 7]]
    looked, met = [], cluster._Part._met
    monkeypatch.setattr(cluster._Part, "_met", lambda self, *a: (looked.append(len(x)) or x for x in met(self, *a)))
    part = part_of(sets, often_of(sets))
    one, other = part.similar(part.sizes, part.tokens[part.word])
    assert {(a, b) for a, b in zip(one.tolist(), other.tolist(), strict=True) if a != b} == {(0, 299), (299, 0)}
    assert sum(looked) < 2000  # of 90,000


def test_similar_sets_are_found_as_by_all_pairs(monkeypatch):
    monkeypatch.setattr(cluster, "STEP", 50)
    draw = random.Random(3)
    for tokens in (9, 40):
        sets = [draw.sample(range(tokens), draw.randint(0, min(tokens, 15))) for _ in range(120)]
        part, others = part_of(sets[:70], often_of(sets[:30])), sets[40:]
        found = part.similar(np.array([len(s) for s in others]), np.array([w for s in others for w in s], np.int64))
        assert sorted(zip(*(x.tolist() for x in found), strict=True)) == [(j, k) for j, b in enumerate(others) for k, a in enumerate(sets[:70]) if similar(a, b)]


def test_tasks_connect_what_all_links_would():
    """Rows in two tasks, sets in two parts; a task forgets sets once they are linked to the largest component."""
    draw = random.Random(8)
    sets = [draw.sample(range(30), draw.randint(1, 8)) for _ in range(200)]
    label = [0 if k % 4 == 0 else 10 * k for k in range(200)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for k in range(2):
        places = [i for i in range(1, 200) if i % 4 and i % 2 == k]
        for rows in (range(0, 120), range(120, 200)):
            part = cluster._Part(np.array(places) * 10, np.array([len(sets[i]) for i in places]), np.array([w for i in places for w in sets[i]], np.int64), often_of(sets))
            batch = pa.RecordBatch.from_arrays([pa.array([10 * i for i in rows], pa.int64()), pa.array([sets[i] for i in rows], pa.list_(pa.int64())), pa.array([label[i] for i in rows], pa.int64())], ["set_id", "words", "label"])
            for out in part.links(iter([batch])):
                for a, of, b in zip(*(c.to_pylist() for c in out.columns), strict=True):
                    assert similar(sets[a // 10], sets[b // 10])
                    root[find(of)] = find(b)
    got = {i: find(label[i]) for i in range(200)}
    want = {}
    root.clear()
    for i in range(200):
        for j in range(i):
            if similar(sets[i], sets[j]):
                root[find(label[i])] = find(label[j])
    want = {i: find(label[i]) for i in range(200)}
    groups = lambda of: {frozenset(i for i in of if of[i] == x) for x in of.values()}
    assert groups(got) == groups(want)


def test_a_task_may_have_any_number_of_batches():
    batches = [pa.RecordBatch.from_arrays([pa.array(range(200 * k, 200 * k + 200), pa.int64())], ["x"]) for k in range(100)]
    parts = list(cluster._growing(iter(batches)))
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(20_000)) and [p.num_rows for p in parts][:3] == [64, 128, 8]
