"""Substring dedup by prefix-partitioned suffix trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shingling import each_text, mixed, sequence_hashes
from tidemark.llm.tokens import utf8
from tidemark.plans.scratch import cut

#: Words of the shortest prefix, with which a suffix's group begins.
PREFIX = 10
#: Windows of a run; longer ones are cut, as the windows are what is compared.
RUN_WINDOWS = 2_000
#: Words of all runs of one prefix that a subtree holds; the prefixes of groups beyond it are lengthened.
TREE_WORDS = 100_000
#: Words of the trees that a task holds at once; whole groups are put together up to it.
TASK_WORDS = 1_000_000
NO_ID = (1 << 63) - 1


def window_samples(words: np.ndarray, window: int) -> np.ndarray:
    """For each window of words, the least hash of the PREFIX-word sequences in it.

    Equal windows have equal values, and neighbours mostly share one; so of the suffixes of a window only that which
    begins with the sampled sequence is kept, and a run of windows around it travels once.
    """
    if len(words) < window:
        return np.zeros(0, np.int64)
    best, span, reach = sequence_hashes(words, PREFIX), window - PREFIX + 1, 1
    while 2 * reach <= span:
        best = np.minimum(best[:-reach], best[reach:])
        reach *= 2
    if span > reach:
        best = np.minimum(best[: len(best) - (span - reach)], best[span - reach :])
    return best.view(np.int64)


def _joined(data: bytes, starts: np.ndarray, ends: np.ndarray, keep: np.ndarray | None = None) -> bytes:
    at = range(len(starts)) if keep is None else np.flatnonzero(keep).tolist()
    s, e = starts.tolist(), ends.tolist()
    return b" ".join([data[s[i] : e[i]] for i in at])


def _profiles(window: int):
    """(doc_id, text) to (doc_id, n_words, sha, prefixes): words, their digest, and the distinct prefixes of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(1))
            n, shas, prefixes = [], [], []
            for data, (starts, ends, words) in zip(texts, each_text(texts), strict=True):
                n.append(len(words))
                shas.append(hashlib.sha256(b" ".join(data.split())).hexdigest())
                prefixes.append(np.unique(window_samples(words, window)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(shas, pa.string()), pa.array(prefixes, pa.list_(pa.int64()))], ["doc_id", "n_words", "sha", "prefixes"]
            )

    return run


#: Of runs that are equal in their words, low and high are the least and greatest key; at and of name the run. sample
#: is the hash of the sequence that all its windows share, prefix a hash of the shared words that its group begins with.
RUNS = "prefix long, sample long, low long, high long, at long, of long, start long, windows long, words binary"
RUN_TYPES = [pa.int64()] * 8 + [pa.binary()]
RUN_NAMES = [x.split()[0] for x in RUNS.split(", ")]
#: Windows of a run, and the least key whose text starts one with the same words.
MARKS = "at long, of long, start long, windows long, first long"


def _batch(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def _split(values: np.ndarray, most: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of equal values, none longer than most."""
    edges = (np.flatnonzero(np.diff(values)) + 1).tolist()
    for a, b in zip([0, *edges], [*edges, len(values)], strict=True):
        step = most or b - a
        yield from ((c, min(c + step, b)) for c in range(a, b, step)) if b > a else [(a, b)]


def _runs(window: int):
    """(doc_id, row_id, text, hits) to a row for each run of windows that share a prefix found elsewhere too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out, held = utf8(batch.column(2)), [], 0
            ids, rows, hits = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)
            for k, (data, (starts, ends, words)) in enumerate(zip(texts, each_text(texts), strict=True)):
                low = window_samples(words, window)
                if not len(low):
                    continue
                hit = np.isin(low, hits[k].values.to_numpy(zero_copy_only=False))
                for a, b in _split(low, RUN_WINDOWS):
                    if hit[a]:
                        part = data[int(starts[a]) : int(ends[b - 1 + window - 1])]
                        out.append((int(low[a]), int(low[a]), ids[k], ids[k], rows[k], a, 0, b - a, part))
                        held += len(part)
                if held > 8 << 20:
                    yield _batch(out, RUN_TYPES, RUN_NAMES)
                    out, held = [], 0
            yield _batch(out, RUN_TYPES, RUN_NAMES)

    return run


def shared_words(words: np.ndarray, sample: int, windows: int, window: int, length: int) -> np.ndarray:
    """For each of the first windows of words, all with the same sample, a hash of length words that it lengthens it to.

    The first place of the sample in a window tells how far into the window it begins, 0 to window - PREFIX words.
    Windows whose distances are in the same range of window - length + 1 numbers share length words around the sample:
    from the start of the last such window on. Equal windows have equal shared words.
    """
    span = window - length + 1
    at = np.flatnonzero(sequence_hashes(words, PREFIX).view(np.int64) == sample)
    start = np.arange(windows)
    place = at[np.searchsorted(at, start)]
    range_of = (place - start) // span
    begin = place - range_of * span
    return mixed(sequence_hashes(words, length)[begin] + range_of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _lengthened(window: int, length: int):
    """Runs to the parts of them whose windows share length words, under these words as prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            for (_, sample, low, high, at, of, start, windows, data), (starts, ends, words) in zip(rows, each_text([r[8] for r in rows]), strict=True):
                prefix = shared_words(words, sample, windows, window, length)
                for a, b in _split(prefix, RUN_WINDOWS):
                    part = data[int(starts[a]) : int(ends[b - 1 + window - 1])]
                    out.append((int(prefix[a]), sample, low, high, at, of, start + a, b - a, part))
                    held += len(part)
                if held > 8 << 20:
                    yield _batch(out, RUN_TYPES, RUN_NAMES)
                    out, held = [], 0
            yield _batch(out, RUN_TYPES, RUN_NAMES)

    return run


def suffix_ranks(words: np.ndarray, depth: int) -> np.ndarray:
    """The rank of each suffix in the order of its first depth words: equal ranks, equal words.

    Ranks by 1, 2, 4 and so on words come from pairs of ranks by half as many, and those by depth from two that
    overlap. Suffixes that are shorter have no rank; the result is that much shorter.
    """
    ranks = np.unique(words, return_inverse=True)[1].astype(np.int64)
    reach = 1
    while reach < depth:
        step = min(reach, depth - reach)
        pair = ranks[:-step] * np.int64(len(words) + 1) + ranks[step:]
        ranks = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        reach += step
    return ranks


def deep_nodes(words: np.ndarray, places: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix tree of the suffixes at places, from depth down: (leaves, firsts).

    leaves are the places' numbers in the order of a suffix array; where neighbours share fewer than depth words one
    internal node ends and the next begins, at firsts. So the leaves between two firsts are those below the highest
    node of that depth or more; a node with one leaf is no repeat.
    """
    rank = suffix_ranks(words, depth)[places]
    leaves = np.argsort(rank, kind="stable")
    ordered = rank[leaves]
    return leaves, np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))


def _tree_marks(window: int):
    """Runs, ordered by prefix, to those of their windows that also start under a smaller key."""

    def marks(runs: list[tuple]) -> list[tuple]:
        firsts, hashes, n = [], [], 0
        for _, _, words in each_text([r[8] for r in runs]):
            firsts.append(n)
            hashes.append(words)
            n += len(words)
        counts = np.array([r[7] for r in runs])
        ends = np.cumsum(counts)
        place = np.arange(int(ends[-1])) - np.repeat(ends - counts, counts) + np.repeat(firsts, counts)
        leaves, nodes = deep_nodes(np.concatenate(hashes), place, window)
        keys = np.repeat(np.array([r[2] for r in runs], np.int64), counts)
        least = np.minimum.reduceat(keys[leaves], nodes)
        first = np.empty(len(leaves), np.int64)
        first[leaves] = np.repeat(least, np.diff(np.append(nodes, len(leaves))))
        found = []
        for (_, _, _, high, at, run_of, start, windows, _), end in zip(runs, ends.tolist(), strict=True):
            own = first[end - windows : end]
            found += [(at, run_of, start + a, b - a, int(own[a])) for a, b in _split(own) if own[a] < high]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, kinds, names = [], 0, [pa.int64()] * 5, [x.split()[0] for x in MARKS.split(", ")]
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= TASK_WORDS and row[0] != held[-1][0]:
                    yield _batch(marks(held), kinds, names)
                    held, size = [], 0
                held.append(row)
                size += row[7] + window - 1
        if held:
            yield _batch(marks(held), kinds, names)

    return run


def _windows(window: int):
    """Runs to single windows, each with a 128-bit name of all its words: the prefix lengthened to the tree's depth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            for lo in range(0, len(rows), 100):  # at most 100 * RUN_WINDOWS windows
                some = rows[lo : lo + 100]
                names, again = [], []
                for _, _, words in each_text([r[8] for r in some]):
                    names.append(sequence_hashes(words, window).view(np.int64))
                    again.append(sequence_hashes(words ^ np.uint64(0x5851F42D4C957F2D), window).view(np.int64))
                counts = [len(x) for x in names]
                start = np.concatenate([r[6] + np.arange(c) for r, c in zip(some, counts, strict=True)])
                columns = [np.repeat(np.array([r[k] for r in some], np.int64), counts) for k in (2, 3, 4, 5)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (np.concatenate(names), np.concatenate(again), *columns, start.astype(np.int64))], ["name", "again", "low", "high", "at", "of", "start"]
                )

    return run


def _repeated_windows(runs: DataFrame, window: int, tree_words: int) -> DataFrame:
    """MARKS of runs: from subtrees where few share a prefix, else with prefixes of more words, at last of whole windows."""
    parts = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = runs.columns

    def parted(some: DataFrame) -> tuple[DataFrame, DataFrame]:
        groups = some.groupBy("prefix").agg(F.sum(F.col("windows") + window - 1).alias("n"), F.min("low").alias("_low"), F.max("high").alias("_high"))
        groups = cut(groups.where("_low < _high").select("prefix", "n"), "groups")
        few, many = (groups.where(x).select("prefix") for x in (F.col("n") <= tree_words, F.col("n") > tree_words))
        dealt = some.join(few, "prefix").select(*names).repartition(parts, "prefix").sortWithinPartitions("prefix")
        return dealt.mapInArrow(_tree_marks(window), MARKS), some.join(many, "prefix").select(*names)

    in_trees, large = parted(runs)
    # runs of a large group that are equal in their words are one from here on
    large = cut(large.withColumns({"_one": F.xxhash64("prefix", "words"), "_two": F.xxhash64("words", F.lit(1))}), "large-runs")
    grouped = large.groupBy("_one", "_two", "prefix", "sample", "windows").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.first("words").alias("words"))
    distinct = cut(grouped.select("prefix", "sample", "low", "high", F.col("_one").alias("at"), F.col("_two").alias("of"), F.lit(0).cast("long").alias("start"), "windows", "words"), "distinct-runs")
    again, still = parted(distinct)
    longer = cut(still.mapInArrow(_lengthened(window, max(window - PREFIX, PREFIX)), RUNS), "longer-runs")
    lengthened, rest = parted(longer)
    single = cut(rest.mapInArrow(_windows(window), "name long, again long, low long, high long, at long, of long, start long"), "windows")
    nodes = cut(single.groupBy("name", "again").agg(F.min("low").alias("first"), F.max("high").alias("_high")).where("first < _high").drop("_high"), "nodes")
    in_nodes = single.join(nodes, ["name", "again"]).where("first < high").select("at", "of", "start", F.lit(1).cast("long").alias("windows"), "first")
    found = cut(again.unionByName(lengthened).unionByName(in_nodes), "large-marks")
    back = large.select("_one", "_two", "low", F.col("at").alias("_at"), F.col("of").alias("_start"))
    of_large = back.join(found, (F.col("_one") == F.col("at")) & (F.col("_two") == F.col("of"))).where("first < low")
    return in_trees.select("at", (F.col("of") + F.col("start")).alias("start"), "windows").unionByName(
        of_large.select(F.col("_at").alias("at"), (F.col("_start") + F.col("start")).alias("start"), "windows")
    )


def _cut_texts(window: int):
    """(doc_id, text, marks) to the digest of all words, how many are in marked windows, and the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, shas, removed, kept = utf8(batch.column(1)), [], [], []
            at, marks = batch.column(2).offsets.to_numpy(), batch.column(2).values
            begins, counts = (marks.field(c).to_numpy() for c in ("start", "windows"))
            for k, (data, (starts, ends, _)) in enumerate(zip(texts, each_text(texts), strict=True)):
                begin, count = begins[at[k] : at[k + 1]], counts[at[k] : at[k + 1]]
                step = np.bincount(begin, minlength=len(starts) + 1) - np.bincount(begin + count + window - 1, minlength=len(starts) + 1)
                keep = np.cumsum(step)[:-1] == 0
                shas.append(hashlib.sha256(b" ".join(data.split())).hexdigest())
                removed.append(int(len(keep) - keep.sum()))
                kept.append(_joined(data, starts, ends, keep))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(shas, pa.string()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], ["_doc", "_sha", "n_removed", "kept"]
            )

    return run


def remove_repeats(docs: DataFrame, window: int = 50, key: str = "doc_id", text: str = "text", tree_words: int = TREE_WORDS) -> DataFrame:
    """Documents without the words of any window of words that also starts in a document with a smaller key.

    1. Each text gets its word count, a digest, and the prefixes of its windows' sampled suffixes. Texts with the
       same words are compared once: all but those with the smallest key lose all words, if they fill a window.
    2. Only prefixes that occur under two keys lead to repeats. Texts with such prefixes are read again, and the runs
       of windows around the sampled suffixes are dealt by prefix to tasks, which build the suffix trees of whole
       groups, a bounded number of words at a time. The highest internal nodes as deep as a window know the smallest
       key below them; a maximal repeat is the union of such windows that follow each other.
    3. A prefix whose runs have more words than tree_words, such as that of a passage in very many texts, is lengthened: equal runs
       become one; where that isn't enough, from 10 words to 40 (window - 10), the runs being parted by how far into
       the window the sample begins; and at last to the whole window, where a group is one node and needs only its
       smallest key, combined before the shuffle.

    One row for each row of docs: key as doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one
    space, UTF-8) and kept (the words themselves as UTF-8 for texts that lost some but not all, else null). A null
    text has no words; null keys count as larger than all others; rows that share a key don't remove each other's
    words. Other columns are not read.
    """
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    profiles = cut(rows.mapInArrow(_profiles(window), "doc_id long, n_words long, sha string, prefixes array<long>"), "profiles")
    firsts = cut(profiles.where(F.col("n_words") >= window).groupBy("sha").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n"), "firsts")
    light = profiles.select("doc_id", "n_words", "sha").join(firsts, "sha", "left")
    copy = F.coalesce(F.col("first_id") < F.col("doc_id"), F.lit(False))
    light = cut(light.withColumn("copy", copy).drop("first_id"), "words")

    copies = light.where("copy").select("doc_id", "sha").distinct()
    alone = cut(profiles.select("doc_id", "sha", "prefixes").join(copies, ["doc_id", "sha"], "left_anti").select("doc_id", "prefixes"), "alone")
    each = alone.select("doc_id", F.explode("prefixes").alias("prefix"))
    spread = each.groupBy("prefix").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("prefix")
    hits = cut(each.join(cut(spread, "prefixes"), "prefix").groupBy("doc_id").agg(F.collect_set("prefix").alias("hits")), "hits")
    texts = cut(rows.join(hits, "doc_id").withColumn("row_id", F.monotonically_increasing_id()), "texts")

    runs = cut(texts.select("doc_id", "row_id", "text", "hits").mapInArrow(_runs(window), RUNS), "runs")
    marks = _repeated_windows(runs, window, tree_words).groupBy(F.col("at").alias("row_id")).agg(F.collect_list(F.struct("start", "windows")).alias("marks"))
    marked = texts.select("doc_id", "text", "row_id").join(cut(marks, "marks"), "row_id").select("doc_id", "text", "marks")
    changed = cut(marked.mapInArrow(_cut_texts(window), "_doc long, _sha string, n_removed long, kept binary"), "changed")
    changed = changed.dropDuplicates(["_doc", "_sha"])
    out = light.join(changed, (F.col("doc_id") == F.col("_doc")) & (F.col("sha") == F.col("_sha")), "left")
    removed = F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    digest = F.when(F.col("copy"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce(F.sha2("kept", 256), "sha"))
    return out.select(
        F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"),
        "n_words",
        removed.cast("long").alias("n_removed"),
        digest.alias("kept_sha256"),
        F.when(~F.col("copy"), F.col("kept")).alias("kept"),
    )
