"""MinHash near-dedup with odd sketches."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.exact_dedup import of_rows, with_row_id
from tidemark.llm.shingling import each_text, mixed, shingle_set
from tidemark.llm.tokens import utf8
from tidemark.operators.components import connected_components
from tidemark.plans.scratch import cut, release

BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
#: Buckets of up to so many classes compare their sketches inside a task; larger ones are compared in blocks.
SMALL_BUCKET = 1024

_RANDOM = np.random.default_rng(90210)
_A = _RANDOM.integers(0, 1 << 32, SAMPLES, dtype=np.uint32) | np.uint32(1)
_B = _RANDOM.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
_FOLD = _RANDOM.integers(0, 1 << 64, SAMPLES, dtype=np.uint64) | np.uint64(1)
SKETCHED = "n_shingles long, set_sum long, set_mix long, bands array<long>, sketch array<long>"


def minhashes(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of the sample functions over a set that isn't empty."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 1024):
        np.minimum(low, (short[at : at + 1024, None] * _A + _B).min(axis=0), out=low)
    return low


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """MinHash samples folded into a parity bitmap: sample j with value v flips one bit, drawn from (j, v)."""
    bit = (mixed(samples.astype(np.uint64) + _FOLD) >> np.uint64(64 - 9)).astype(np.int64)
    odd = (np.bincount(bit, minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(">i8").astype(np.int64)


def sketch_similarity(differing: int) -> float:
    """The similarity that two sketches with so many differing bits tell of.

    Of SAMPLES samples, those that differ flip two bits in the XOR, and n flips leave about
    SKETCH_BITS / 2 * (1 - exp(-2 n / SKETCH_BITS)) of them odd.
    """
    if 2 * differing >= SKETCH_BITS:
        return 0.0
    flips = -SKETCH_BITS / 2 * math.log(1 - 2 * differing / SKETCH_BITS)
    return max(0.0, 1 - flips / (2 * SAMPLES))


@cache
def _tail(similarity: float) -> np.ndarray:
    """Chances that sketches of texts at this similarity differ in more than 0, 1, 2, ... bits.

    Of SAMPLES samples a binomial number differ, and each of those flips two random bits.
    """
    bits, odd, tail = np.arange(SKETCH_BITS + 1), np.eye(1, SKETCH_BITS + 1)[0], np.zeros(SKETCH_BITS + 1)
    for m in range(SAMPLES + 1):
        tail += math.comb(SAMPLES, m) * (1 - similarity) ** m * similarity ** (SAMPLES - m) * np.append(odd[:0:-1].cumsum()[::-1], 0)
        for _ in range(2):
            up, down = odd * (SKETCH_BITS - bits) / SKETCH_BITS, odd * bits / SKETCH_BITS
            odd = np.append(0, up[:-1]) + np.append(down[1:], 0)
    return tail


def most_differing(similarity: float, chance: float = 2e-9) -> int:
    """Sketches of texts at this similarity differ in more bits than this with at most this chance, by the exact tail."""
    return int(np.flatnonzero(_tail(similarity) <= chance)[0])


def _band_keys(samples: np.ndarray) -> np.ndarray:
    wide = samples.astype(np.uint64).reshape(BANDS, ROWS) * _FOLD[:ROWS]
    return mixed(wide.sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _digests(s: np.ndarray) -> tuple[int, int]:
    again = mixed(s + np.uint64(0x632BE59BD9B4E019))
    return int(s.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(again).view(np.int64))


def _sketched(length: int, lower: bool, with_sets: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sums, mixes, bands, sketches, sets = [], [], [], [], [], []
            for _, _, words in each_text(utf8(batch.column(1)), lower):
                s = shingle_set(words, length)
                total, parity = _digests(s) if len(s) else (0, 0)
                n.append(len(s))
                sums.append(total)
                mixes.append(parity)
                if with_sets:
                    sets.append(s.view(np.int64))
                elif len(s):
                    samples = minhashes(s)
                    bands.append(_band_keys(samples).view(np.int64))
                    sketches.append(odd_sketch(samples))
                else:
                    bands.append(None)
                    sketches.append(None)
            columns, names = [batch.column(0), pa.array(n, pa.int64()), pa.array(sums, pa.int64()), pa.array(mixes, pa.int64())], ["doc_id", "n_shingles", "set_sum", "set_mix"]
            if with_sets:
                columns, names = [*columns[1:], pa.array(sets, pa.list_(pa.int64()))], [*names[1:], "shingles"]
            else:
                columns, names = [*columns, pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))], [*names, "bands", "sketch"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _close_pairs(band: np.ndarray, n: np.ndarray, of: np.ndarray, sketch: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(one, other, differing): places of rows of a bucket, in different components, that size and sketch don't rule out.

    All rows of a bucket are compared, buckets of the same size at once. Rows are ordered by band.
    """
    most = most_differing(percent / 100)
    begins = np.flatnonzero(np.concatenate(([True], band[1:] != band[:-1])))
    sizes = np.diff(np.append(begins, len(band)))
    for size in np.unique(sizes[sizes > 1]).tolist():
        rows = begins[sizes == size]
        for lo in range(0, len(rows), max(1, 100_000 // size)):
            some = rows[lo : lo + max(1, 100_000 // size)]
            for step in range(1, size):
                one = (some[:, None] + np.arange(size - step)).ravel()
                other = one + step
                fits = (100 * np.minimum(n[one], n[other]) >= percent * np.maximum(n[one], n[other])) & (of[one] != of[other])
                one, other = one[fits], other[fits]
                differing = np.bitwise_count(sketch[one] ^ sketch[other]).sum(axis=1)
                ok = differing <= most
                yield one[ok], other[ok], differing[ok]


def _by_bucket(whole_buckets):
    """A function of Arrow batches, ordered by their first column, from one of batches that hold whole buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            band = held.column(0).to_numpy()
            last = np.flatnonzero(band != band[-1])
            if len(last):
                yield whole_buckets(held.slice(0, last[-1] + 1))
                held = held.slice(last[-1] + 1)
        if held is not None:
            yield whole_buckets(held)

    return run


def _columns(table: pa.Table) -> list[np.ndarray]:
    """(band, class, n, component, sketch) of a table as arrays."""
    flat = table.column(4).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return [*(table.column(k).to_numpy() for k in range(4)), flat.view(np.uint64).reshape(-1, SKETCH_BITS // 64)]


def _mates(percent: int):
    """Rows (band, class, n, component, sketch) to one row for each class that has mates: its smallest and its closest."""

    def whole(table: pa.Table) -> pa.RecordBatch:
        band, cls, n, of, sketch = _columns(table)
        found = list(_close_pairs(band, n, of, sketch, percent))
        empty = np.zeros(0, np.int64)
        one, other, differing = (np.concatenate([*x, empty]).astype(np.int64) for x in (zip(*found, strict=True) if found else ([], [], [])))
        ends, others, d = np.concatenate([one, other]), cls[np.concatenate([other, one])], np.concatenate([differing, differing])
        smallest, closest = np.lexsort((others, ends)), np.lexsort((others, d, ends))
        ordered = ends[smallest]
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1])))
        at = ordered[first]
        columns = [band[at], cls[at], others[smallest[first]], others[closest[first]], d[closest[first]]]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["band", "a", "b", "near", "differing"])

    return _by_bucket(whole)


def _linked(percent: int):
    """Rows (band, class, n, component, sketch, own, bands, shingles) to confirmed links of different components.

    own is the band of the bucket: of the buckets that two classes share only the first by bands confirms the pair.
    """

    def whole(table: pa.Table) -> pa.RecordBatch:
        band, cls, n, of, sketch = _columns(table)
        own = table.column(5).to_numpy()
        bands = table.column(6).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS)
        lists = table.column(7).combine_chunks()
        values, bounds = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
        sets = [values[x:y] for x, y in zip(bounds, bounds[1:], strict=False)]
        links = []
        for one, other, _ in _close_pairs(band, n, of, sketch, percent):
            shared = bands[one] == bands[other]
            first = bands[one, shared.argmax(axis=1)] == own[one]
            for i, j in zip(one[first].tolist(), other[first].tolist(), strict=True):
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                    links.append((min(cls[i], cls[j]), max(cls[i], cls[j])))
        pairs = np.array(links, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return _by_bucket(whole)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar enough."""
    full = pairs.join(sets.select(F.col("class").alias("a"), F.col("shingles").alias("set_a")), "a").join(
        sets.select(F.col("class").alias("b"), F.col("shingles").alias("set_b")), "b"
    )
    common = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    whole = F.size("set_a").cast("long") + F.size("set_b") - common
    return cut(full.where(100 * common >= percent * whole).select("a", "b").distinct(), "links")


def _in_blocks(members: DataFrame) -> DataFrame:
    """Rows of large buckets once for each pair of blocks to be compared, under a band of that pair's own.

    Classes in the component of the bucket's centre needn't meet one another, so their blocks meet only those of the
    others: where all but a few are connected, that is in proportion to the bucket.
    """
    rows = members.withColumn("inside", F.col("component") == F.col("main"))
    sizes = cut(rows.groupBy("band").agg(F.count_if("inside").alias("n_in"), F.count_if(~F.col("inside")).alias("n_out")), "bucket-sizes")
    half = SMALL_BUCKET // 2
    rows = rows.join(sizes, "band").withColumns({"ins": F.expr(f"n_in div {half} + 1"), "outs": F.expr(f"n_out div {half} + 1")})
    block = F.pmod(F.xxhash64("class"), F.when(F.col("inside"), F.col("ins")).otherwise(F.col("outs")))
    rows = rows.withColumn("block", block)
    with_outs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("outs") - 1), lambda x: F.struct(F.lit("out").alias("kind"), F.least(x, F.col("block")).alias("x"), F.greatest(x, F.col("block")).alias("y")))
    with_ins = F.transform(F.sequence(F.lit(0).cast("long"), F.col("ins") - 1), lambda x: F.struct(F.lit("in").alias("kind"), F.col("block").alias("x"), x.alias("y")))
    of_ins = F.transform(F.sequence(F.lit(0).cast("long"), F.col("outs") - 1), lambda x: F.struct(F.lit("in").alias("kind"), x.alias("x"), F.col("block").alias("y")))
    each = rows.withColumn("meets", F.explode(F.when(F.col("inside"), of_ins).otherwise(F.concat(with_outs, with_ins))))
    return each.withColumn("band", F.xxhash64("band", "meets"))


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle_words: int = 5, percent: int = 80, row_id: str | None = None) -> DataFrame:
    """Groups of documents linked through shingle sets with 100 * intersection >= percent * union.

    A set has the distinct shingles of a text's words (runs without ASCII white space, A-Z lower-cased); fewer words
    than a shingle are one shingle. Equal sets form a class, so copies are compared once. MinHash samples of a class
    give band keys, which bring candidates together, and an odd sketch, whose XOR with another's rejects
    pairs that are surely below; what is left is confirmed on full sets. At similarity 0.8 the 32 bands of 4 miss a
    link once in 2 * 10**7. The sketches of a bucket meet in one task, or in blocks if it is large. First each class
    is tried with its smallest and its closest mate only; when those links are confirmed and connected, classes that
    have close mates in other components meet once more, with their full sets, and give the links that are left. So
    components are those of all pairs, without forming those inside a group.

    Returns key as doc_id, n_shingles, component_id (smallest key reachable; null only where no key is), kept
    (doc_id = component_id), row_id and component (a number of its own, for components that no key names). Texts without
    words are linked with nothing. Null keys come last; rows that share a key and a set are kept or not together. Other
    columns are not read.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), (F.col(row_id) if row_id else F.lit(None)).cast("long").alias("row_id"))
    packed = rows.select(F.struct("doc_id", "row_id").alias("doc_id"), "text")
    ids = "struct<doc_id: long, row_id: long>"
    sketched = packed.mapInArrow(_sketched(shingle_words, True, False), f"doc_id {ids}, {SKETCHED}")
    sketched = cut(sketched.select("doc_id.doc_id", "doc_id.row_id", "n_shingles", "set_sum", "set_mix", "bands", "sketch"), "sketches")
    same_set = ["n_shingles", "set_sum", "set_mix"]
    grouped = sketched.where("n_shingles > 0").groupBy(*same_set).agg(F.min("doc_id").alias("first_id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = cut(grouped.withColumn("class", F.monotonically_increasing_id()), "classes")
    banded = classes.select("class", F.explode("bands").alias("band"))
    buckets = cut(banded.groupBy("band").agg(F.count("*").alias("size"), F.min("class").alias("centre")).where("size > 1"), "buckets")
    members = cut(banded.join(buckets, "band").join(classes.select("class", "n_shingles", "sketch"), "class"), "members")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = ["band", "class", "n_shingles", "component", "sketch"]

    def dealt(labelled: DataFrame, *more: str) -> DataFrame:
        return labelled.select(*columns, *more).repartition(parts, "band").sortWithinPartitions("band")

    def with_mates(labelled: DataFrame) -> DataFrame:
        return dealt(labelled).mapInArrow(_mates(percent), "band long, a long, b long, near long, differing long")

    # first only what may connect most: each class with its smallest and its closest mate, or the centre of a large bucket
    small = members.where(F.col("size") <= SMALL_BUCKET)
    mate = with_mates(small.withColumn("component", F.col("class"))).groupBy("a").agg(F.min("b").alias("b"), F.min_by("near", F.struct("differing", "near")).alias("near"))
    mate = mate.select("a", F.explode(F.array("b", "near")).alias("b"))
    stars = members.where((F.col("size") > SMALL_BUCKET) & (F.col("class") != F.col("centre"))).select(F.col("class").alias("a"), F.col("centre").alias("b"))
    pairs = cut(mate.unionByName(stars).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct().join(classes.select("class", "first_id"), "class").select("first_id").distinct()
    texts = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi").select("doc_id", "text")
    sets = texts.mapInArrow(_sketched(shingle_words, True, True), "n_shingles long, set_sum long, set_mix long, shingles array<long>")
    sets = cut(sets.where("n_shingles > 0").join(classes.select("class", *same_set), same_set).select("class", "shingles"), "sets")
    links = _confirmed(pairs, sets, percent)
    components = cut(connected_components(links), "components")

    # then the close pairs between components; buckets of one component are done
    labelled = members.join(components.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    labelled = cut(labelled, "labelled")
    main = F.max(F.when(F.col("class") == F.col("centre"), F.col("component"))).alias("main")
    open_buckets = labelled.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), main).where("low <> high").select("band", "main")
    opened = cut(labelled.join(cut(open_buckets, "open"), "band"), "opened")
    left = opened.withColumn("own", F.col("band"))
    left = cut(left.where(F.col("size") <= SMALL_BUCKET).select(*columns, "own").unionByName(_in_blocks(left.where(F.col("size") > SMALL_BUCKET)).select(*columns, "own")), "compared")
    alive = cut(with_mates(left).select("band", F.col("a").alias("class")), "alive")
    whole_sets = sets.dropDuplicates(["class"]).join(classes.select("class", "bands"), "class")
    exact = left.join(alive, ["band", "class"]).join(whole_sets, "class")
    more = cut(dealt(exact, "own", "bands", "shingles").mapInArrow(_linked(percent), "a long, b long").distinct(), "links")
    if not more.isEmpty():
        components = cut(connected_components(links.unionByName(more)), "components")
    whole = classes.select("class", *same_set, "first_id").join(components.withColumnRenamed("node", "class"), "class", "left")
    whole = cut(whole.withColumn("component", F.coalesce("component", "class")), "whole")
    firsts = cut(whole.groupBy("component").agg(F.min("first_id").alias("component_id")), "firsts")
    known = cut(whole.join(firsts, "component").select(*same_set, "component", "component_id"), "known")
    release(classes, buckets, members, pairs, sets, links, labelled, opened, left, alive, more, whole, firsts)
    out = sketched.select("doc_id", "row_id", *same_set).join(known, same_set, "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), "row_id", "component").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of docs, all columns, with one document of each group of near copies: that with the smallest key.

    Of rows that share that key and the group, one stays. Texts without words, null ones too, all stay, as do repeated
    rows of them. Null keys count as the largest. Columns may have any names; no rows give none.
    """
    rows, name = with_row_id(docs, key)
    kept = near_groups(rows, key, text, row_id=name, **how).where("kept")
    linked = kept.where("n_shingles > 0").groupBy("doc_id", "component").agg(F.min("row_id").alias("row_id")).select("doc_id", "row_id")
    stay = kept.where("n_shingles = 0").select("doc_id", "row_id").unionByName(linked)
    return of_rows(rows, key, name, cut(stay.distinct(), "stay"), "left_semi").select(*docs.columns)
