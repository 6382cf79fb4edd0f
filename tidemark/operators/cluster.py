"""Clusters of items that tell of the same event, over sources."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import normal_title, tokens_of_normal
from tidemark.operators.components import connected_components
from tidemark.plans.scratch import cut, release


LEAST_SHARED, PERCENT = 2, 55
#: Common tokens whose smallest sets are compared with all sets, the largest such set, and the sets of a part.
HUBS, HUB_SIZE, PART = 2048, 8, 131_072
#: Tokens whose frequency is known to tasks, and how many of a set's rarest tokens a similar set holds for sure.
OFTEN, SURE = 1 << 18, 2
#: Pairs that a task looks at together, and the bits of a mark that says whether a set may hold a token.
STEP, MARKS = 1 << 21, 22


def _need(m: np.ndarray) -> np.ndarray:
    """How many tokens a set of m has to share with one that isn't smaller."""
    return np.maximum(LEAST_SHARED, -(-PERCENT * m // 100))


def _expanded(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size says."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def _steps(work: np.ndarray) -> Iterator[slice]:
    """Neighbours of about STEP work together, or one that has more."""
    done = np.cumsum(work)
    first = 0
    while first < len(work):
        end = max(first + 1, int(np.searchsorted(done, (done[first - 1] if first else 0) + STEP, "right")))
        yield slice(first, end)
        first = end


def _mark(numbers: np.ndarray) -> np.ndarray:
    return ((numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - MARKS)).astype(np.int64)


class _Often:
    """Frequent tokens, by their hashes, from the rarest to the most frequent; others count as rarer."""

    def __init__(self, hashes: np.ndarray, times: np.ndarray) -> None:
        order = np.argsort(hashes)
        rank = np.empty(len(hashes), np.int64)
        rank[np.argsort(times, kind="stable")] = np.arange(1, len(hashes) + 1)
        self.hashes, self.rank = hashes[order], rank[order]

    def rarest(self, words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Which words of sets, one after the other, are so many of the set's rarest that a similar set holds SURE of them."""
        rank = np.zeros(len(words), np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
            rank = np.where(self.hashes[at] == words, self.rank[at], 0)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        place = np.empty(len(words), np.int64)
        place[np.argsort(owner * (OFTEN + 1) + rank, kind="stable")] = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return place < np.repeat(sizes - _need(sizes) + SURE, sizes)


class _Part:
    """Some token sets as arrays, few enough for memory; other sets are compared with all of them where they lie.

    If two sets are similar, the larger has SURE at least of any m - need + SURE tokens of the smaller, so only pairs are
    looked at where it has as many of the smaller's rarest ones.
    """

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, words: np.ndarray, often: _Often) -> None:
        self.ids, self.sizes, self.often = ids, sizes, often
        self.by_id = np.argsort(ids)
        self.tokens, word = np.unique(words, return_inverse=True)
        self.word, self.starts = word.astype(np.int32), np.cumsum(sizes) - sizes
        owner, rare = np.repeat(np.arange(len(ids), dtype=np.int32), sizes), often.rarest(words, sizes)
        self.all, self.rare = self._holders(self.word, owner), self._holders(self.word[rare], owner[rare])

    def _holders(self, word: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token the first place, the number and then, one after the other, the places of sets that hold it."""
        n = np.bincount(word, minlength=len(self.tokens))
        return np.cumsum(n) - n, n, owner[np.argsort(word, kind="stable")]

    def similar(self, sizes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of sets, one after the other, their places and those of the part's sets that are similar to them."""
        if not len(self.tokens):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.tokens, words), len(self.tokens) - 1)
        known = self.tokens[at] == words
        owner, at, rare = np.repeat(np.arange(len(sizes)), sizes)[known], at[known], self.often.rarest(words, sizes)[known]
        held = np.sort(owner * len(self.tokens) + at)
        larger = [self._shared(x, sizes, held) for x in self._met(owner, at, self.rare) if len(x)]
        smaller = [self._shared(x, sizes, held) for x in self._met(owner[rare], at[rare], self.all) if len(x)]
        found = [x[self.sizes[x % len(self.ids)] <= sizes[x // len(self.ids)]] for x in larger] + [x[self.sizes[x % len(self.ids)] > sizes[x // len(self.ids)]] for x in smaller]
        pairs = np.concatenate([np.empty(0, np.int64), *found])
        return pairs // len(self.ids), pairs % len(self.ids)

    def _met(self, owner: np.ndarray, at: np.ndarray, holders: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[np.ndarray]:
        """Pairs, as owner times sets plus the part's set, that meet at SURE tokens."""
        first, n, places = holders
        bounds = np.flatnonzero(np.diff(owner, prepend=-1))
        ends = np.append(bounds[1:], len(owner))
        work = np.add.reduceat(n[at], bounds) if len(bounds) else bounds
        for some in _steps(work):
            span = slice(bounds[some][0], ends[some][-1])
            times = n[at[span]]
            pairs = np.repeat(owner[span] * len(self.ids), times) + places[_expanded(first[at[span]], times)]
            pairs.sort()
            enough = pairs[SURE - 1 :][pairs[SURE - 1 :] == pairs[: len(pairs) - SURE + 1]]
            yield enough[np.diff(enough, prepend=-1) > 0]

    def _shared(self, pairs: np.ndarray, sizes: np.ndarray, held: np.ndarray) -> np.ndarray:
        """The pairs that share enough tokens; held: the sets' tokens, as owner times tokens plus token, in order."""
        marks = np.zeros(1 << MARKS, bool)
        marks[_mark(held)] = True
        tests = [lambda x: marks[_mark(x)], lambda x: held[np.minimum(np.searchsorted(held, x), len(held) - 1)] == x]  # the first may say too much
        for has in tests:
            out = [np.empty(0, np.int64)]
            for some in _steps(self.sizes[pairs % len(self.ids)]):
                own, place = np.divmod(pairs[some], len(self.ids))
                m = self.sizes[place]
                each = np.repeat(own * len(self.tokens), m) + self.word[_expanded(self.starts[place], m)]
                shared = np.add.reduceat(has(each), np.cumsum(m) - m, dtype=np.int64)
                out.append(pairs[some][shared >= _need(np.minimum(m, sizes[own]))])
            pairs = np.concatenate(out)
        return pairs

    def groups(self) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """The first place of each set's group of linked sets, and links (a, b) that make the groups."""
        root, links = list(range(len(self.ids))), []

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = k = root[root[k]]
            return k

        for k, other in zip(*(x.tolist() for x in self.similar(self.sizes, self.tokens[self.word])), strict=True):
            one, two = find(k), find(other)
            if one != two:
                root[max(one, two)] = min(one, two)
                links.append((int(self.ids[k]), int(self.ids[other])))
        return np.array([find(k) for k in range(len(root))], np.int64), links

    def grouped(self, root: np.ndarray):
        """Sets (set_id, tokens, words) with near, a similar set of each group, and groups, the smallest sets of those and of its own group."""

        def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes, words = _arrays(batch.column(2))
                one, other = self.similar(sizes, words)
                keys, first = np.unique(one * len(self.ids) + root[other], return_index=True)
                of, near = keys // len(self.ids), self.ids[other[first]]
                foreign = near != batch.column(0).to_numpy()[of]
                lists = [_lists(of[foreign], near[foreign], batch.num_rows), _lists(of, self.ids[keys % len(self.ids)], batch.num_rows)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["set_id", "tokens", "near", "groups"])

        return grouped

    def _without(self, gone: np.ndarray) -> None:
        """From now on sets that are gone aren't found."""
        for name in ("all", "rare"):
            first, n, places = getattr(self, name)
            stays = ~gone[places]
            before = np.append(0, np.cumsum(stays))
            setattr(self, name, (before[first], before[first + n] - before[first], places[stays]))

    def links(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of sets (set_id, words, label) links (a, label, b) that connect them with all parts' sets as all links would.

        The sets with another's label are connected. A task links a set to one of the part's sets that it has connected
        so far, and looks no more for sets that it has connected with those: two sets that no task links, as one takes the
        second to be gone and one the first, are both linked to them.
        """
        n, left = len(self.ids), len(self.ids)
        root = np.arange(n + 1)  # the last stands for the sets with another's label
        for batch in _growing(batches):
            ids, label = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
            sizes, words = _arrays(batch.column(1))
            at = self.by_id[np.minimum(np.searchsorted(self.ids, ids, sorter=self.by_id), n - 1)]
            own = np.where(label != ids, n, np.where(self.ids[at] == ids, at, -1))
            one, other = self.similar(sizes, words)
            mine, group = np.where(own >= 0, root[own], -1)[one], root[other]
            new = np.flatnonzero(mine != group)
            _, first = np.unique(one[new] * (n + 1) + group[new], return_index=True)
            new = new[first]
            merged: dict[int, int] = {}

            def find(g: int) -> int:
                while (up := merged.get(g, g)) != g:  # noqa: B023
                    merged[g] = g = merged.get(up, up)  # noqa: B023
                return g

            last: dict[int, int] = {}
            for k, m, g in zip(one[new].tolist(), mine[new].tolist(), group[new].tolist(), strict=True):
                with_ = find(m if m >= 0 else last.setdefault(k, g))
                if (g := find(g)) != with_:
                    merged[max(g, with_)] = min(g, with_)
            if merged:
                into = np.arange(n + 1)
                into[list(merged)] = [find(g) for g in merged]
                root = into[root]
                gone = root[:n] == root[n]
                if n - gone.sum() < 0.9 * left:
                    self._without(gone)
                    left = n - gone.sum()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[one[new]], label[one[new]], self.ids[other[new]])], ["a", "label", "b"])


def _growing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, few of them in the first batches."""
    most = 64
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            yield batch.slice(at, most)
            at, most = at + most, min(STEP, 2 * most)


def _lists(owner: np.ndarray, numbers: np.ndarray, n: int) -> pa.Array:
    """For each of n owners the list of its numbers, which are in its order."""
    ends = np.append(0, np.cumsum(np.bincount(owner, minlength=n)))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(numbers, pa.int64()))


def _arrays(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of lists of numbers, and the numbers one after the other."""
    return np.diff(words.offsets.to_numpy()).astype(np.int64), words.flatten().to_numpy(zero_copy_only=False)


def _part(some: DataFrame, often: _Often) -> _Part:
    rows = some.toArrow()
    each = [_arrays(x) for x in rows.column("words").chunks]
    joined = (np.concatenate([np.empty(0, np.int64), *x]) for x in ([s for s, _ in each], [w for _, w in each]))
    return _Part(rows.column("set_id").to_numpy(), *joined, often)


def _main(hubbed: DataFrame) -> list[int]:
    """The groups of the index that sets connect to the one with most sets; as few numbers as the index has groups, and their pairs."""
    first = F.get("groups", F.lit(0))
    often = {r["g"]: r["n"] for r in hubbed.where("size(groups) > 0").groupBy(first.alias("g")).agg(F.count("*").alias("n")).collect()}
    pairs = hubbed.where("size(groups) > 1").select(first.alias("a"), F.explode(F.slice("groups", 2, HUBS)).alias("b")).distinct().collect()
    root = {g: g for g in [*often, *(r["b"] for r in pairs)]}

    def find(g: int) -> int:
        while root[g] != g:
            root[g] = g = root[root[g]]
        return g

    for a, b in ((find(r["a"]), find(r["b"])) for r in pairs):
        root[find(max(a, b))] = find(min(a, b))
    sets: dict[int, int] = {}
    for g, n in often.items():
        sets[find(g)] = sets.get(find(g), 0) + n
    main = max(sets, key=lambda g: (sets[g], -g), default=None)
    return [g for g in root if find(g) == main]


def _compared(sets: DataFrame) -> tuple[DataFrame, Column, DataFrame, DataFrame]:
    """(a table of the sets, their label, links inside the largest component, links (a, label, b) that connect the labels).

    The sets that the hubs show to be in the largest component have its smallest one as label, all others themselves.
    """
    spark = sets.sparkSession
    each = sets.select("set_id", F.size("tokens").alias("m"), F.explode("tokens").alias("token"))
    able = F.when(F.col("m").between(LEAST_SHARED, HUB_SIZE), F.struct("m", "set_id"))
    tokens = cut(each.groupBy("token").agg(F.count("*").alias("often"), F.min(able).alias("c")).where("often > 1"), "tokens", "zstd")
    common = tokens.where("c IS NOT NULL").orderBy(F.desc("often"), "token").limit(HUBS)
    known_often = tokens.select(F.xxhash64("token").alias("word"), "often").orderBy(F.desc("often")).limit(OFTEN).toArrow()
    often = _Often(*(known_often.column(k).to_numpy() for k in (0, 1)))
    words = F.transform("tokens", lambda t: F.xxhash64(t)).alias("words")
    hubs = _part(sets.join(F.broadcast(common.select("c.set_id").distinct()), "set_id", "left_semi").select("set_id", words).orderBy("set_id"), often)
    release(tokens)
    root, inner = hubs.groups()
    with_groups = "set_id long, tokens array<string>, near array<long>, groups array<long>"
    hubbed = cut(sets.select("set_id", "tokens", words).mapInArrow(hubs.grouped(root), with_groups), "sets-by-hubs", "zstd")
    inside = F.coalesce(F.get("groups", F.lit(0)).isin(_main(hubbed)), F.lit(False))
    least = hubbed.where(inside).agg(F.min("set_id").alias("label")).first()["label"]
    label = F.when(inside, F.lit(least).cast("long")).otherwise(F.col("set_id")).alias("label")
    known = hubbed.where(inside).select(F.col("set_id").alias("a"), F.explode("near").alias("b")).unionByName(spark.createDataFrame(inner, "a long, b long"))
    outside = hubbed.where(~inside)
    total = outside.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("tokens")).first()
    parts = max(-(-total["n"] // PART), -(-total["tokens"] // (24 * PART)))
    each = hubbed.select("set_id", words, label, inside.alias("inside"))
    links = [spark.createDataFrame([], "a long, label long, b long")]
    for k in range(parts):
        part = _part(each.where(~F.col("inside") & (F.pmod(F.xxhash64("set_id"), F.lit(parts)) == k)).select("set_id", "words"), often)
        if len(part.tokens):
            links.append(cut(each.select("set_id", "words", "label").mapInArrow(part.links, "a long, label long, b long"), "part-links"))
    return hubbed, label, known, reduce(DataFrame.unionByName, links)


def token_links(sets: DataFrame) -> DataFrame:
    """Links (a, b) that connect the token sets (set_id, tokens) as all links of similar ones would.

    Sets are similar that share at least max(2, ceil(.55 m)) tokens, m being the smaller size. First all sets are compared
    with a bounded number of small ones that have the most common tokens; in prose these connect most. All pairs of which
    not both are in the largest component then are looked at: sets outside go to the tasks part by part, as an index of
    bounded size, and all sets are compared with it where they lie. Neither a pair nor a set is ever moved, so neither disk
    nor memory grows with the pairs; the time grows with sets times sets outside, as no token of similar sets needs to be rare.
    """
    *_, known, links = _compared(sets)
    return known.unionByName(links.select("a", "b"))


def _digest(text: Column) -> Column:
    """16 bytes that stand for a text."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def clusters_of(items: DataFrame) -> DataFrame:
    """(seq, cluster) of items (seq, title, url): the smallest seq of the items linked, in any number of steps.

    Items are linked by equal normal titles, by equal links that aren't empty, or by similar tokens. Titles of equal
    tokens are one node from the start, named by its smallest seq, so copies don't multiply the pairs. What is shuffled
    are digests and numbers; tokens travel once, when a node's are found.
    """
    normal = items.select("seq", F.nullif("url", F.lit("")).alias("url"), normal_title(F.col("title")).alias("norm"))
    tokens = normal.withColumn("tokens", F.array_sort(tokens_of_normal(F.col("norm"))))
    text = F.when(F.size("tokens") >= LEAST_SHARED, F.array_join("tokens", " "))  # fewer tokens have no links
    name = F.coalesce(F.concat(F.lit("t"), "text"), F.concat(F.lit("n"), F.nullif("norm", F.lit(""))))
    rows = cut(tokens.withColumn("text", text).select("seq", "url", _digest(name).alias("key"), "text"), "keys-of-items", "zstd")
    nodes = cut(rows.where("key IS NOT NULL").groupBy("key").agg(F.min("seq").alias("node"), F.first("text").alias("text")), "nodes", "zstd")
    unnamed = rows.where("key IS NULL").select("seq", "url", F.col("seq").alias("node"))
    named = cut(rows.where("key IS NOT NULL").select("seq", "url", "key").join(nodes.select("key", "node"), "key").select("seq", "url", "node").unionByName(unnamed), "nodes-of-items", "zstd")
    release(rows)
    sets, label, _, links = _compared(nodes.where("text IS NOT NULL").select(F.col("node").alias("set_id"), F.split("text", " ").alias("tokens")))
    labels = sets.select(F.col("set_id").alias("node"), label).where("label <> node")
    items_labelled = cut(named.join(labels, "node", "left").select("seq", "url", F.coalesce("label", "node").alias("label")), "labels-of-items")
    release(nodes, named, sets)
    by_url = items_labelled.where("url IS NOT NULL")
    by_link = by_url.join(by_url.groupBy("url").agg(F.min("label").alias("a")), "url").select("a", F.col("label").alias("b"))
    found = connected_components(links.select(F.col("label").alias("a"), "b").unionByName(by_link))
    out = items_labelled.join(found.withColumnRenamed("node", "label"), "label", "left")
    return out.groupBy("seq").agg(F.min(F.coalesce("component", "label")).alias("cluster"))


def clustered(items: DataFrame) -> DataFrame:
    """items (seq, title, url) with their cluster (clusters_of)."""
    return items.join(clusters_of(items), "seq")
