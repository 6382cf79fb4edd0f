"""Daily partitions, snapshots, transcripts and sinks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_day(rows: DataFrame, root: str, kind: str, day: str) -> None:
    """Replace the partition of one kind and day; others stay."""
    rows.write.mode("overwrite").parquet(f"{root}/db_type={kind}/dt={day}")


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return fs, p


def available_dates(spark: SparkSession, root: str, kind: str = "news") -> list[str]:
    """Days of a kind, newest first; names that are no days are not listed."""
    fs, p = _files(spark, f"{root}/db_type={kind}")
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted((n[3:] for n in names if re.fullmatch(r"dt=\d{4}-\d{2}-\d{2}", n)), reverse=True)


def read_snapshot(spark: SparkSession, root: str, day: str, kind: str = "news", sources: list[str] | None = None) -> DataFrame | None:
    """A day's rows, of some sources; None where the day isn't there."""
    if day not in available_dates(spark, root, kind):
        return None
    rows = spark.read.parquet(f"{root}/db_type={kind}/dt={day}")
    return rows if sources is None else rows.where(F.col("source_id").isin(sources))


def keyed_by_title(rows: DataFrame) -> DataFrame:
    """One row for each source and title: the last in seq order."""
    return rows.groupBy("source_id", "title").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("source_id", "title")]), "seq").alias("x")).select("source_id", "title", "x.*")


def drop_older(spark: SparkSession, root: str, kind: str, today: str, days: int) -> list[str]:
    """Delete partitions more than so many days before today; 0 keeps all."""
    from datetime import date, timedelta

    if days <= 0:
        return []
    limit = (date.fromisoformat(today) - timedelta(days=days)).isoformat()
    old = [d for d in available_dates(spark, root, kind) if d < limit]
    for d in old:
        fs, p = _files(spark, f"{root}/db_type={kind}/dt={d}")
        fs.delete(p, True)
    return old


def pull_missing(spark: SparkSession, remote: str, local: str, kind: str, today: str, days: int) -> dict[str, list[str]]:
    """Copy the last days that remote has and local hasn't: which were synced, skipped or are nowhere."""
    from datetime import date, timedelta

    wanted = [(date.fromisoformat(today) - timedelta(days=k)).isoformat() for k in range(days)]
    there, here = set(available_dates(spark, remote, kind)), set(available_dates(spark, local, kind))
    synced = [d for d in wanted if d in there - here]
    for d in synced:
        write_day(spark.read.parquet(f"{remote}/db_type={kind}/dt={d}"), local, kind, d)
    return {"synced": synced, "skipped": [d for d in wanted if d in here], "missing": [d for d in wanted if d not in there | here]}


def transcripts(spark: SparkSession, path: str, first_lines: int = 150, modified_before: str | None = None) -> DataFrame:
    """(file, line_no, line, parsed) of the first lines of JSON-lines files below a folder; bad lines have no parsed."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl")
    if modified_before:
        reader = reader.option("modifiedBefore", modified_before)
    files = reader.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value"))
    lines = files.select("file", F.posexplode(F.slice(F.split("value", "\n"), 1, first_lines)).alias("line_no", "line")).where("trim(line) <> ''")
    return lines.withColumn("parsed", F.try_parse_json("line"))


def samples(lines: DataFrame, stored: DataFrame) -> DataFrame:
    """Titles of text lines, without blank ones and comments, and of stored rows: each once with its least rank."""
    text = lines.where(~F.trim("value").startswith("#") & (F.trim("value") != "")).select(F.trim("value").alias("title"), F.lit(None).cast("long").alias("rank"))
    return text.unionByName(stored.select("title", F.col("rank").cast("long").alias("rank"))).groupBy("title").agg(F.min("rank").alias("rank"))


def evenly_sampled(files: DataFrame, order: str, first: int = 10, last: int = 15, between: int = 20) -> DataFrame:
    """The first, the last, and evenly spaced rows in an order; a list of files is few rows, which one task numbers."""
    n = F.count("*").over(Window.partitionBy())
    at = F.row_number().over(Window.orderBy(order)) - 1
    step = F.greatest(F.floor((F.col("n") - first - last) / between), F.lit(1))
    middle = (F.col("at") >= first) & (F.col("at") < F.col("n") - last) & ((F.col("at") - first) % step == 0) & ((F.col("at") - first) / step < between)
    return files.withColumn("n", n).withColumn("at", at).where((F.col("at") < first) | (F.col("at") >= F.col("n") - last) | middle).drop("n", "at")


def write_text_snapshot(rows: DataFrame, path: str) -> None:
    """Lines 'rank. title [url]' by source and rank."""
    line = F.concat_ws(" ", F.concat(F.col("rank").cast("string"), F.lit(".")), "title", F.concat(F.lit("[URL:"), F.col("url"), F.lit("]")))
    rows.repartitionByRange("source_id").sortWithinPartitions("source_id", "rank", "title").select(F.concat_ws("\t", "source_id", line).alias("value")).write.mode("overwrite").text(path)


def write_json_artifact(rows: DataFrame, path: str) -> None:
    """One JSON object a line, its fields in the order of their names."""
    rows.select(F.to_json(F.struct(*sorted(rows.columns))).alias("value")).write.mode("overwrite").text(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def plan_and_receipt(plans: DataFrame, receipts: DataFrame) -> DataFrame:
    """Plans and receipts of runs side by side, with how much can be trusted."""
    both = plans.withColumn("has_plan", F.lit(True)).join(receipts.withColumn("has_receipt", F.lit(True)), "run_id", "full_outer").na.fill(False, ["has_plan", "has_receipt"])
    return both.withColumn("confidence", F.when(F.col("has_plan") & F.col("has_receipt"), "high").when(F.col("has_receipt"), "medium").otherwise("low"))
