"""Document fingerprints by one-permutation MinHash, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.scratch import cut

BINS = 128
BITS = 8
SPACE = r"[\x20\x09-\x0D]+"


def _bound(value: Column, use) -> Column:
    """use(value), with value computed once: higher-order functions evaluate what a lambda mentions for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _run_hashes(hashed: Column, length: int) -> Column:
    """A hash of each run of length words, from the hashes of the words: runs of 1, 2, 4, ... words, and two that overlap."""

    def joined(runs: Column, step: int) -> Column:
        both = lambda r: F.zip_with(F.slice(r, F.lit(1), F.size(r) - step), F.slice(r, F.lit(1 + step), F.size(r) - step), lambda a, b: F.xxhash64(a, b))
        return _bound(runs, both)

    done, runs = 1, hashed
    while done < length:
        step = min(done, length - done)
        runs = joined(runs, step)
        done += step
    return runs


def fingerprint(text: Column, shingle_words: int = 5, bins: int = BINS, bits: int = BITS) -> Column:
    """The packed fingerprint of a text as hexadecimal digits; of a text without words, ''.

    Each shingle is hashed once; the top bits of the hash name its bin, and a bin keeps its least hash. An empty bin
    takes over the bin that is full and comes first in an order of the bins drawn for the empty one (optimal
    densification), so its value too is a uniform draw from the set: eight bins are drawn one after the other, and
    where all of them are empty, the full bin with the least draw follows. Of each value the low bits are kept. Fewer
    words than a shingle are one shingle.
    """
    shift = 64 - (bins.bit_length() - 1)
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def bin_of(x: Column) -> Column:
        # in signed order, so that the bins come one after the other in sorted hashes
        return F.shiftright(x, shift) + bins // 2

    def shingles(h: Column) -> Column:
        many = _run_hashes(h, shingle_words)
        return F.when(F.size(h) >= shingle_words, many).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<long>"))

    def least(s: Column) -> Column:
        # the first of each bin is its least
        return F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, shift) != F.shiftright(F.get(s, i - 1), shift)))

    def drawn(at: Column, found: Column) -> Column:
        order = F.transform(found, lambda x: F.struct(F.xxhash64(at, bin_of(x)).alias("draw"), x.alias("value")))
        return F.array_min(order)["value"]

    def slots(found: Column) -> Column:
        at = F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))
        return _bound(F.transform(found, bin_of), lambda full: F.transform(at, lambda b: F.get(found, (F.array_position(full, b) - 1).cast("int"))))

    def dense(found: Column) -> Column:
        def filled(own: Column) -> Column:
            tries = [lambda b, k=k: F.get(own, F.shiftrightunsigned(F.xxhash64(b, F.lit(k)), shift).cast("int")) for k in range(8)]
            return F.transform(own, lambda x, b: F.coalesce(x, *[f(b) for f in tries], drawn(b, found)))

        return _bound(slots(found), filled)

    packed = lambda v: F.array_join(F.transform(v, lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit((1 << bits) - 1))), bits // 4, "0")), "")
    full = _bound(F.sort_array(_bound(hashed, shingles)), least)
    return F.lower(_bound(full, lambda f: F.when(F.size(f) == 0, F.lit("")).otherwise(packed(dense(f)))))


def likeness(one: Column, other: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """The similarity, 0 to 1, that two fingerprints tell of; values that meet by their few bits alone are taken off.

    Two texts without words are alike; a text without words and one with some are not.
    """
    digits, chance = bits // 4, 2.0**-bits
    at = F.sequence(F.lit(0), F.lit(bins - 1))
    equal = F.aggregate(at, F.lit(0), lambda n, i: n + F.when(F.substr(one, i * digits + 1, F.lit(digits)) == F.substr(other, i * digits + 1, F.lit(digits)), 1).otherwise(0))
    partly = F.greatest(F.lit(0.0), (equal / F.lit(float(bins)) - chance) / (1 - chance))
    return F.when(one == other, F.lit(1.0)).when((one == "") | (other == ""), F.lit(0.0)).otherwise(partly)


def next_keys(keys: DataFrame) -> DataFrame:
    """(key, next): for each distinct key the next smaller one, and for the smallest the largest.

    Keys are range-sorted into partitions; a key's neighbour is in its partition but for the last of each, which take
    the first of the next partition that has any: one row for each partition.
    """
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keys.select("key").distinct().repartitionByRange(parts, F.desc("key")).sortWithinPartitions(F.desc("key"))
    ordered = cut(ordered.withColumn("part", F.spark_partition_id()), "ordered-keys")
    inside = ordered.withColumn("next", F.lead("key").over(Window.partitionBy("part").orderBy(F.desc("key"))))
    firsts = ordered.groupBy("part").agg(F.max("key").alias("first"))
    whole = Window.orderBy("part")
    firsts = firsts.select(F.col("part").alias("_part"), F.coalesce(F.lead("first").over(whole), F.max("first").over(Window.partitionBy())).alias("after"))
    return inside.join(firsts, F.col("part") == F.col("_part")).select("key", F.coalesce("next", "after").alias("next"))


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of all documents and of their edited texts; one row for each row of docs.

    The edited text has the first ceil(n / 2) of the n code points of a text and then the first floor(n / 2), or all,
    of the next document in descending key order (after the last, the first). Returns key as doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next (likeness to the edited text and to the
    next document). A null text is empty; a null key counts as the smallest 64-bit integer; where several rows share
    the next key, their smallest text stands for it. Other columns are not read.
    """
    low = F.lit(-(1 << 63))
    rows = docs.select(F.coalesce(F.col(key).cast("long"), low).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    order = cut(next_keys(rows), "next-keys")
    lengths = cut(rows.select("key", F.char_length("text").cast("long").alias("n")).groupBy("key").agg(F.max("n").alias("longest"), F.count("*").alias("rows")), "lengths")
    wanted = cut(order.join(lengths, "key").select(F.col("key").alias("before"), F.col("next").alias("key"), "longest"), "wanted")
    # each text is fingerprinted where it is read; both joins shuffle the same rows, so Spark moves them once
    rows = rows.withColumn("print", fingerprint(F.col("text")))
    stand_in = rows
    if not lengths.where("rows > 1").isEmpty():
        stand_in = rows.groupBy("key").agg(F.min(F.struct("text", "print")).alias("least")).select("key", "least.text", "least.print")
    heads = wanted.join(stand_in.hint("merge"), "key").select(
        F.col("before").alias("key"), F.substr("text", F.lit(1), F.expr("int(longest div 2)")).alias("head"), F.col("print").alias("next_print")
    )
    joined = rows.hint("merge").join(heads, "key").withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.expr("int(n_chars div 2)")
    edited = F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substr("head", F.lit(1), half))
    both = joined.select("key", "n_chars", edited.alias("edited"), "print", "next_print")
    out = both.select("key", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.col("print").alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_print")
    return out.select(
        F.when(F.col("key") != low, F.col("key")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_print")).alias("near_next"),
    )
