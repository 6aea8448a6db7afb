"""Sinks: versioned tables whose new version becomes valid at once, key-value metadata, exports."""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ConcurrentCommit(RuntimeError):
    """Another run committed the version first; nothing of this one is read."""


class VersionedTables:
    """Tables written together under one version; a marker file makes the version valid for readers.

    Each attempt writes to a folder of its own (``a=<random>``); the marker ``v=N.valid`` names the
    folder. The marker appears whole or not at all and is never replaced, so a run that dies leaves
    only a folder that nobody reads, and two runs cannot write into each other's output.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._hadoop.Path(self.path).getFileSystem(self._conf)

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def versions(self) -> list[int]:
        if not self._fs.exists(self._hadoop.Path(self.path)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._hadoop.Path(self.path))]
        return sorted(int(n[2:-6]) for n in names if n.startswith("v=") and n.endswith(".valid"))

    def version(self) -> int:
        return max(self.versions(), default=0)

    def _folder(self, version: int) -> str:
        stream = self._fs.open(self._at(f"v={version}.valid"))
        try:
            return f"{self.path}/{stream.readUTF()}"
        finally:
            stream.close()

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        """A table as of a version (the newest by default), or null if it was never written."""
        for v in range(self.version() if version is None else version, 0, -1):
            at = f"{self._folder(v)}/{name}"
            if self._fs.exists(self._hadoop.Path(at)):
                return self.spark.read.parquet(at)
        return None

    def commit(self, base: int | None = None, /, **tables: DataFrame) -> int:
        """Writes the tables as the version after ``base`` (the newest by default) and makes it valid."""
        v = (self.version() if base is None else base) + 1
        attempt = f"a={uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{self.path}/{attempt}/{name}")
        self._fs.mkdirs(self._at(attempt))
        named = self._at(f"{attempt}/marker")
        stream = self._fs.create(named, False)
        stream.writeUTF(attempt)
        stream.close()
        if not self._publish(named, self._at(f"v={v}.valid")):
            self._fs.delete(self._at(attempt), True)
            raise ConcurrentCommit(f"version {v} was committed by another run")
        return v

    def _publish(self, marker, at) -> bool:
        """Whether the finished marker could be moved to a name that nobody had taken."""
        if self._fs.getScheme() == "file":  # a rename would replace it here, a link does not
            try:
                os.link(marker.toUri().getPath(), at.toUri().getPath())
                return True
            except FileExistsError:
                return False
        if self._fs.exists(at):
            return False
        none = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            self._hadoop.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(marker, at, none)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise


def set_metadata(metadata: DataFrame, **values: str) -> DataFrame:
    """The key-value table with keys set."""
    new = metadata.sparkSession.createDataFrame([(k, str(v)) for k, v in values.items()], "key string, value string")
    return metadata.join(new.select("key"), "key", "left_anti").unionByName(new)


def get_metadata(metadata: DataFrame, key: str) -> str | None:
    """The value of a key, or null if it was never set."""
    row = metadata.filter(F.col("key") == key).select("value").first()
    return row[0] if row else None


def export_json(df: DataFrame) -> DataFrame:
    """One JSON text per row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def export_tree(nodes: DataFrame) -> DataFrame:
    """(file_path, text): per file its symbols in line order, indented below their kind; files are of bounded size."""
    line = F.concat(F.lit("  "), "kind", F.lit(" "), "name", F.lit(" L"), F.col("start_line").cast("string"))
    rows = nodes.filter("kind <> 'file'").groupBy("file_path").agg(F.sort_array(F.collect_list(F.struct("start_line", line.alias("line")))).alias("l"))
    return rows.select("file_path", F.concat(F.col("file_path"), F.lit("\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("text"))
