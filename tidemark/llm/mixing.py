"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.exact_dedup import of_rows, spare, with_row_id
from tidemark.plans.prefix_sums import running_totals
from tidemark.plans.scratch import cut

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: list[float], most: float) -> DataFrame:
    """Targets of the sources: (source, source_no, source_size, target), from a table of (source, source_size).

    Sources in code point order, null last, take the weights in turn and share the whole size by weight. A target
    stops at most times its source's size and the excess is shared again by weight among the others. In the end each
    target is min(most * size, level * weight) for one level: with the sources in order of most * size / weight,
    those up to some place stop, and the level is what they leave divided by the weights after that place.
    One task orders the sources: a row of some 50 bytes for each, up to tens of millions, whatever they hold.
    """
    numbered = sizes.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    numbered = numbered.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    whole = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), "source_no").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = rest / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # the first source in that order whose share doesn't pass its cap sets the level; without one, all stop
    fits = numbered.withColumn("share", level).withColumn("fits", F.col("share") * F.col("weight") <= F.col("cap"))
    at = F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), F.col("source_no"), F.col("share")))).over(whole)
    fits = fits.withColumn("level", at["share"])
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))
    return fits.select("source", "source_no", "source_size", target.alias("target"))


def random_key(*columns: str) -> F.Column:
    """A hash-random key in [0, 2**60) that other SQL engines can state too."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def mix_documents(
    docs: DataFrame, weights: list[float] = (5, 2, 1), most: float = 3.0, key: str = "doc_id", text: str = "text", source: str = "source", row_id: str | None = None
) -> DataFrame:
    """How many words of each document a mix takes whose sources meet their targets; one row for each row of docs.

    Within its source, documents stand in the order of a hash of their key. A source whose target is q times its
    size and some words more gives each document q times and, from the start of that order, once more, until the
    budget (the target rounded down) is met exactly; the document at the cut gives its first words only. So taken is
    at most most times the size, rounded up.

    Returns key as doc_id, size (words), source, source_size, target, taken and row_id. A null text has no words, a
    null source is a source of its own, null keys and repeated rows are documents like any other. Other columns are
    not read. Everything runs in DataFrame operations.
    """
    rows = cut(
        docs.select(
            F.col(key).cast("long").alias("doc_id"),
            F.col(source).cast("string").alias("source"),
            F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
            (F.col(row_id) if row_id else F.lit(None)).cast("long").alias("row_id"),
        ),
        "sizes",
    )
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = cut(source_targets(totals, list(weights), most).withColumnRenamed("source", "_source"), "targets")
    known = rows.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("_key", random_key("doc_id", "size"))
    placed = running_totals(known, "source_no", "_key", ["doc_id", "size", "row_id"], F.col("size"), "_before")
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(0)
    left = budget - F.col("_epochs") * F.col("source_size") - F.col("_before")
    taken = F.col("_epochs") * F.col("size") + F.greatest(F.lit(0), F.least("size", left))
    placed = placed.withColumn("_epochs", epochs)
    return placed.select("doc_id", "size", "source", "source_size", "target", taken.cast("long").alias("taken"), "row_id")


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", n_chars: str = "n_chars", **how) -> DataFrame:
    """The mix itself, in the columns of docs: each document as often as the mix takes it.

    The document at a source's cut comes once more with its first words only, one space between them; documents of which
    nothing is taken are not in the mix, nor are those without words, null and empty texts too. A null source is a
    source of its own; null keys and repeated rows are documents like any other. n_chars, where it is a column, follows
    the text; other columns may have any names. No rows give none.
    """
    rows, row = with_row_id(docs, key)
    size, taken, some = (spare(x, rows) for x in ("size", "taken", "words"))
    plan = mix_documents(rows, key=key, text=text, source=source, row_id=row, **how).where("taken > 0")
    plan = cut(plan.select("doc_id", "row_id", F.col("size").alias(size), F.col("taken").alias(taken)), "plan")
    # the plan has a row for nearly each document, so both sides are sorted at any size
    joined = of_rows(rows.hint("merge"), key, row, plan, "inner")
    copies = joined.withColumn(some, F.explode(F.expr(f"transform(sequence(0L, (`{taken}` - 1) div `{size}`), i -> least(`{size}`, `{taken}` - i * `{size}`))")))
    words = F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))
    head = F.array_join(F.slice(words, F.lit(1), F.col(some).cast("int")), " ")
    copies = copies.withColumn(text, F.when(F.col(some) < F.col(size), head).otherwise(F.col(text)))
    if n_chars in docs.columns:
        copies = copies.withColumn(n_chars, F.char_length(text).cast(docs.schema[n_chars].dataType))
    return copies.select(*docs.columns)
