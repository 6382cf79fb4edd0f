"""Small state between runs: versions in a folder, an atomic pointer to the newest, and loading that can't fail a run."""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

FORMAT = 1
POINTER = "CURRENT"


@dataclass(frozen=True)
class Loaded:
    """status: loaded, missing (there is no state yet) or untrusted (there is one that can't be relied on; why says how)."""

    rows: DataFrame
    status: str
    why: str | None = None
    recorded_at: str | None = None

    @property
    def trusted(self) -> bool:
        return self.status != "untrusted"


class StateFolder:
    """State rows of one schema in a folder that any of Spark's file systems holds.

    save() writes the rows as a version of their own and then lets the pointer name it, by renaming a finished file over
    it; a run that dies before that leaves the state as it was, and one that repeats writes another version. The pointer
    holds the format, a fingerprint of the schema, the number of rows and the time. load() checks all of it: a pointer or
    version that is gone, damaged or of another schema gives no rows and the status untrusted. Versions that the pointer
    doesn't name are deleted by the next save, but for the one before, which readers may still be reading.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str | StructType):
        self.spark, self.root = spark, root.rstrip("/")
        self.schema = schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._path("").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def fingerprint(self) -> str:
        return hashlib.sha256(self.schema.json().encode()).hexdigest()

    def _read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _pointer(self) -> dict:
        found = json.loads(self._read(POINTER))
        if not isinstance(found, dict):
            raise ValueError("the pointer isn't an object")
        return found

    def save(self, rows: DataFrame, recorded_at: str) -> str:
        """The name of the new version, which rows, in the schema's columns, make; they may come from load()."""
        if not recorded_at.strip():
            raise ValueError("recorded_at must not be blank")
        name = f"version-{uuid.uuid4().hex}"
        rows.select(*[rows[f.name].cast(f.dataType) for f in self.schema]).coalesce(1).write.parquet(f"{self.root}/{name}")
        before = self._named()
        n = self.spark.read.schema(self.schema).parquet(f"{self.root}/{name}").count()
        self._point({"format": FORMAT, "schema": self.fingerprint(), "version": name, "rows": n, "recorded_at": recorded_at})
        for status in self._fs.listStatus(self._path("")):
            old = status.getPath().getName()
            if old.startswith("version-") and old not in (name, before):
                self._fs.delete(status.getPath(), True)
        return name

    def _named(self) -> str | None:
        try:
            return self._pointer().get("version")
        except Exception:  # no pointer, or none that can be read: nothing is kept for its sake
            return None

    def _point(self, to: dict) -> None:
        """Write a file and rename it over the pointer, which file systems do at once."""
        new = f".{POINTER}-{uuid.uuid4().hex}"
        stream = self._fs.create(self._path(new), True)
        stream.write(bytearray(json.dumps(to, sort_keys=True).encode()))
        stream.close()
        conf = self.spark._jsparkSession.sessionState().newHadoopConf()
        context = self._hadoop.FileContext.getFileContext(self._path(new).toUri(), conf)
        overwrite = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(self._path(new), self._path(POINTER), overwrite)

    def load(self) -> Loaded:
        none = self.spark.createDataFrame([], self.schema)
        if not self._fs.exists(self._path(POINTER)):
            return Loaded(none, "missing")
        try:
            to = self._pointer()
            if to.get("format") != FORMAT or to.get("schema") != self.fingerprint():
                return Loaded(none, "untrusted", "of another format or schema")
            if not isinstance(to.get("recorded_at"), str) or not to["recorded_at"].strip():
                return Loaded(none, "untrusted", "without a time")
            rows = self.spark.read.schema(self.schema).parquet(f"{self.root}/{to['version']}")
            n = rows.count()
            if n != to.get("rows"):
                return Loaded(none, "untrusted", f"{n} rows instead of {to.get('rows')}")
            return Loaded(rows, "loaded", None, to["recorded_at"])
        except Exception as e:  # whatever is wrong with a state, a run goes on without it
            return Loaded(none, "untrusted", f"can't be read: {type(e).__name__}")

    def set_aside(self, suffix: str) -> bool:
        """Rename a pointer that can't be trusted, so that the next save begins anew; whether there was one."""
        if not self._fs.exists(self._path(POINTER)):
            return False
        return bool(self._fs.rename(self._path(POINTER), self._path(f"{POINTER}.corrupt.{suffix}")))
