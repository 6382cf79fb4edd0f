"""Sessions, and shipping this package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
#: Rows and bytes of an Arrow batch: Spark's defaults, and ours, with which a Python worker holds little text at a time.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1500"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864", "16777216")}


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once for each application, and keep their batches small.

    Batch sizes that the session has set itself stay.
    """
    for name, (default, own) in BATCHES.items():
        if spark.conf.get(name, default) in (default, f"{default}b"):
            spark.conf.set(name, own)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    name = os.path.join(tempfile.mkdtemp(), "tidemark_code.zip")
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(name)
    _SHIPPED.add(app)
