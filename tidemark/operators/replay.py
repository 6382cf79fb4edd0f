"""Feed entries put into a state one by one, where entries may change the keys by which later ones are found."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.components import connected_components
from tidemark.plans.scratch import cut

COLUMNS = ["entry_id", "feed_id", "guid", "url", "title", "summary", "author", "published_at", "first_batch", "last_batch", "crawl_count"]
LINKS = ("http://", "https://", "//")
#: Places before and after all entries of a batch.
BEFORE, AFTER = -1, (1 << 63) - 1


def _is_link(title: str | None) -> bool:
    return (title or "").strip().startswith(LINKS)


class Feed:
    """Entries of one component, by guid and by link, as entries of a batch come in order."""

    def __init__(self):
        self.entries: list[dict] = []
        self.by: dict[tuple[str, str, str], dict] = {}
        self.clash = False

    def known(self, row: dict) -> None:
        entry = {c: row[c] for c in COLUMNS} | {"blank_from": None if row["url"] else BEFORE, "blank_to": AFTER}
        self.entries.append(entry)
        self._found_by(entry)

    def _found_by(self, entry: dict) -> None:
        for kind in ("guid", "url"):
            if entry[kind] and self.by.setdefault((entry["feed_id"], kind, entry[kind]), entry) is not entry:
                self.clash = True

    def comes(self, row: dict) -> None:
        key = lambda kind: (row["feed_id"], kind, row[kind])
        entry = (row["guid"] and self.by.get(key("guid"))) or (row["url"] and self.by.get(key("url"))) or None
        if entry is None:
            name = "\x1f".join([row["feed_id"], row["guid"], row["url"], str(row["batch"]), str(row["seq"])])
            row = row | {"entry_id": hashlib.sha256(name.encode()).hexdigest(), "first_batch": row["batch"], "last_batch": row["batch"], "crawl_count": 1}
            entry = {c: row[c] for c in COLUMNS} | {"blank_from": None if row["url"] else row["seq"], "blank_to": AFTER}
            self.entries.append(entry)
            self._found_by(entry)
            return
        keep = _is_link(row["title"]) and entry["title"] and not _is_link(entry["title"])
        for kind in ("guid", "url"):
            if row[kind] and row[kind] != entry[kind]:
                self.by.pop((entry["feed_id"], kind, entry[kind]), None)
                if kind == "url" and not entry["url"]:
                    entry["blank_to"] = row["seq"]
                entry[kind] = row[kind]
        self._found_by(entry)
        entry.update({c: row[c] for c in ("summary", "author", "published_at")}, title=entry["title"] if keep else row["title"], last_batch=row["batch"], crawl_count=entry["crawl_count"] + 1)


OUT = "entry_id string, feed_id string, guid string, url string, title string, summary string, author string, published_at timestamp, first_batch timestamp, last_batch timestamp, crawl_count long, blank_from long, blank_to long, clash boolean"


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by component and seq to the component's entries; a task holds the entries of one component."""
    moment = pa.timestamp("us", tz="UTC")
    kinds = [*[pa.string()] * 7, *[moment] * 3, *[pa.int64()] * 3, pa.bool_()]
    names = [*COLUMNS, "blank_from", "blank_to", "clash"]
    own, feed = None, Feed()

    def made() -> pa.RecordBatch:
        rows = [e | {"clash": feed.clash} for e in feed.entries]
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

    for batch in batches:
        for row in batch.to_pylist():
            if row["component"] != own:
                if own is not None:
                    yield made()
                own, feed = row["component"], Feed()
            (feed.known if row["seq"] == BEFORE else feed.comes)(row)
    if own is not None:
        yield made()


def _uniform(rows: DataFrame) -> DataFrame:
    """Entries of components whose rows of the batch all have the same guid and link, and whose state is one row at most:
    all come to one entry, so the last values count, and the rows are aggregated."""
    link = lambda c: F.coalesce(F.trim(c), F.lit("")).rlike("^(https?:)?//")
    new, at = F.col("seq") != BEFORE, F.col("seq")
    last = lambda c: F.max_by(F.when(new, F.col(c)), F.when(new, at))
    old = lambda c: F.max(F.when(~new, F.col(c)))
    plain = ~link(F.col("title"))
    one = rows.groupBy("component").agg(
        F.max(F.when(~new, F.col("entry_id"))).alias("old_id"),
        F.min("feed_id").alias("feed_id"),
        *[last(c).alias(f"new_{c}") for c in ("guid", "url", "title", "summary", "author", "published_at", "batch")],
        *[old(c).alias(f"old_{c}") for c in ("guid", "url", "first_batch", "crawl_count")],
        F.max_by(F.when(plain, F.col("title")), F.when(plain, at)).alias("plain"),
        F.min(F.when(new, F.col("batch"))).alias("batch"),
        F.count_if(new).alias("n"),
        F.min(F.when(new, at)).alias("begun"),
    )
    kept = lambda c: F.when(F.col(f"new_{c}") != "", F.col(f"new_{c}")).otherwise(F.coalesce(f"old_{c}", F.lit("")))
    name = F.sha2(F.concat_ws("\x1f", "feed_id", "new_guid", "new_url", F.col("batch").cast("string"), F.col("begun").cast("string")), 256)
    title = F.when(link(F.col("new_title")) & (F.coalesce("plain", F.lit("")) != ""), F.col("plain")).otherwise(F.col("new_title"))
    blank_from = F.when(F.col("old_url") == "", F.lit(BEFORE)).when(F.col("old_id").isNull() & (F.col("new_url") == ""), F.col("begun"))
    return one.select(
        F.coalesce("old_id", name).alias("entry_id"), "feed_id", kept("guid").alias("guid"), kept("url").alias("url"), title.alias("title"),
        F.col("new_summary").alias("summary"), F.col("new_author").alias("author"), F.col("new_published_at").alias("published_at"),
        F.coalesce("old_first_batch", "batch").alias("first_batch"), F.col("new_batch").alias("last_batch"), (F.coalesce("old_crawl_count", F.lit(0)) + F.col("n")).cast("long").alias("crawl_count"),
        blank_from.cast("long").alias("blank_from"), F.when(F.col("new_url") != "", F.col("begun")).otherwise(F.lit(AFTER)).cast("long").alias("blank_to"), F.lit(False).alias("clash"),
    )


def _with_components(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of the state (seq BEFORE) and of the batch, with the component of rows that keys connect within a feed."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    old = state.select("entry_id", "feed_id", text("guid"), text("url"), "title", "summary", "author", "published_at", "first_batch", "last_batch", "crawl_count", F.lit(BEFORE).cast("long").alias("seq"), none("batch", "timestamp"))
    new = batch.where(F.col("feed_id").isNotNull()).select(none("entry_id", "string"), "feed_id", text("guid"), text("url"), "title", "summary", "author", "published_at", none("first_batch", "timestamp"), none("last_batch", "timestamp"), none("crawl_count", "long"), F.col("seq").cast("long").alias("seq"), F.col("batch").cast("timestamp").alias("batch"))
    rows = old.unionByName(new.where("guid <> '' OR url <> ''"))
    rows = cut(rows.withColumn("node", F.monotonically_increasing_id()), "entries")
    key = lambda c: F.when(F.col(c) != "", F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")))
    keys = rows.select("node", "feed_id", F.explode(F.array_compact(F.array(key("guid"), key("url")))).alias("key"))
    first = keys.groupBy("feed_id", "key").agg(F.min("node").alias("a"))
    links = keys.join(first, ["feed_id", "key"]).where("a <> node").select("a", F.col("node").alias("b"))
    found = connected_components(links)
    return cut(rows.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")).drop("node"), "components")


def replayed_entries(state: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The state (columns COLUMNS) after a batch (seq, feed_id, guid, url, title, summary, author, published_at, batch) came
    in entry by entry, in seq order, and the feeds (feed_id) in which two entries would have come to one key.

    An entry is that of its feed with its guid, or else the one with its link; without both or without feed it is left
    out. Blank guids and links replace nothing; a title that looks like a link doesn't replace another. Guids and links
    are each unique in a feed, where a blank link counts as one too: a batch that breaks that is to be rejected as a
    whole, which committed() does.

    Rows are dealt by the components that shared guids and links make of state and batch. Where all of a component's
    rows of the batch have the same keys they are aggregated, also if one key has most of the batch. In other components
    each entry may move the keys by which the next is found, so one task takes a component's rows in order; it holds the
    component's entries, not its rows.
    """
    rows = _with_components(state, batch)
    new = F.col("seq") != BEFORE
    shape = rows.groupBy("component").agg(
        F.count_if(new).alias("new"),
        F.count_if(~new).alias("old"),
        F.min(F.when(new, F.struct("guid", "url"))).alias("least"),
        F.max(F.when(new, F.struct("guid", "url"))).alias("most"),
    )
    kind = F.when(F.col("new") == 0, "same").when((F.col("old") <= 1) & (F.col("least") == F.col("most")), "uniform").otherwise("mixed")
    rows = cut(rows.join(shape.select("component", kind.alias("kind")), "component"), "kinds")
    same = rows.where("kind = 'same'").select(*COLUMNS, F.when(F.col("url") == "", F.lit(BEFORE)).cast("long").alias("blank_from"), F.lit(AFTER).alias("blank_to"), F.lit(False).alias("clash"))
    mixed = rows.where("kind = 'mixed'").drop("kind").repartition("component").sortWithinPartitions("component", "seq")
    after = cut(same.unionByName(_uniform(rows.where("kind = 'uniform'"))).unionByName(mixed.mapInArrow(_replayed, OUT)), "after")
    earlier = Window.partitionBy("feed_id").orderBy("blank_from", "blank_to").rowsBetween(Window.unboundedPreceding, -1)
    blank = after.where("blank_from IS NOT NULL").withColumn("until", F.max("blank_to").over(earlier))
    clashes = after.where("clash").select("feed_id").unionByName(blank.where("until > blank_from").select("feed_id")).distinct()
    return after.select(*COLUMNS), clashes


def committed(state: DataFrame, batch: DataFrame) -> tuple[DataFrame, bool]:
    """The state after a batch, and whether it was taken in: one that breaks a key leaves the state as it was."""
    after, clashes = replayed_entries(state, batch)
    return (after, True) if clashes.isEmpty() else (state.select(*COLUMNS), False)
