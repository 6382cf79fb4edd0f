"""Lineage cuts: intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir, or a folder of our own on a local master.

    On a cluster without that setting there is no folder that executors surely share, so it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "/tmp/checkpoints"
    return f"{base.rstrip('/')}/tidemark/{spark.sparkContext.applicationId}"


#: Paths of the tables that cut() has written since the innermost tidy() of this thread began.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str, codec: str = "snappy", group: int = 0) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    The result has no lineage beyond those files, so a lost executor costs one read, and its size is known to the
    optimizer, which then broadcasts it only under spark.sql.autoBroadcastJoinThreshold. Tables with rows of megabytes
    give group, the bytes of a row group: it is then looked after at each row and not at each hundredth, as a task that
    writes or reads the table holds a whole one.
    """
    path = new_path(df.sparkSession, name)
    writer = df.write.option("compression", codec)
    if group:
        writer = writer.options(**{"parquet.block.size": group, "parquet.page.size.row.check.min": 1, "parquet.block.size.row.check.min": 1})
    writer.parquet(path)
    if (made := _MADE.get()) is not None:
        made.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def tables_read(df: DataFrame) -> set[str]:
    """The last parts of the paths of all files or folders that the plan of df reads."""
    leaves, names = df._jdf.queryExecution().analyzed().collectLeaves(), set()
    for k in range(leaves.size()):
        if leaves.apply(k).getClass().getSimpleName() == "LogicalRelation":
            paths = leaves.apply(k).relation().location().rootPaths()
            names |= {paths.apply(i).getName() for i in range(paths.size())}
    return names


def tidy(build: Callable[[], DataFrame]) -> tuple[DataFrame, list[str]]:
    """What build returns, and the tables written meanwhile that it reads; the others are deleted at once.

    So a result may still be read whenever and as often as its user likes; who knows that nobody will, deletes the
    rest. Calls in other threads, and their tables, don't matter.
    """
    made: list[str] = []
    token = _MADE.set(made)
    try:
        out = build()
    finally:
        _MADE.reset(token)
    needed = tables_read(out) if made else set()
    left = [p for p in made if p.rsplit("/", 1)[1] in needed]
    delete(out.sparkSession, [p for p in made if p not in set(left)])
    if (outer := _MADE.get()) is not None:
        outer.extend(left)
    return out, left


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that nothing reads any more."""
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def release(*tables: DataFrame) -> None:
    """Delete the files of tables that cut() wrote and that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_tidemark_path", None):
            delete(df.sparkSession, [path])


def mounted(path: str) -> str:
    """A shared path as tasks can open it themselves."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"{path}: binary files need a folder mounted on the driver and all executors")
    return path
