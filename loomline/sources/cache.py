"""A keyed cache as a versioned table: upserts write a new version, readers see the old one or the new one.

A version is a Parquet folder, and a log of numbered pointers names them: whoever first creates pointer n + 1 has
written version n + 1, and the loser of a race merges again onto the winner's rows. Pointers appear by renaming a
finished file, so no reader sees half of one.
"""

from __future__ import annotations

import os
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def readable(spark: SparkSession, paths: list[str], schema: StructType) -> DataFrame | None:
    """The Parquet tables at paths, or None if one is missing, unfinished or has a file that is no Parquet file."""
    try:
        if not all(_Store(spark, path).exists("_SUCCESS") for path in paths):
            return None
        spark.read.option("mergeSchema", True).parquet(*paths)  # reads the footer of every file, on Spark
        return spark.read.schema(schema).parquet(*paths)
    except (PySparkException, Py4JJavaError) as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e) or "CANNOT_READ_FILE_FOOTER" in str(e) or "not a Parquet file" in str(e):
            return None
        raise


class _Store:
    """A folder of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        jvm = spark.sparkContext._jvm
        self.path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{root}/{name}" if name else root)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(conf)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path(""))] if self.fs.exists(self.path("")) else []

    def text(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode(errors="replace")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Make a file with this text, unless there is one of the name: False then."""
        made = self.path(f".{name}-{uuid.uuid4().hex}")
        stream = self.fs.create(made, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            if self.fs.getUri().getScheme() == "file":  # where renaming would replace a file
                os.link(made.toUri().getPath(), self.path(name).toUri().getPath())
                return True
            return not self.exists(name) and self.fs.rename(made, self.path(name))
        except FileExistsError:
            return False
        finally:
            self.fs.delete(made, False)

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class KeyedCache:
    """Rows of schema, one for each key (columns), in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str]) -> None:
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, keys
        self.store = _Store(spark, self.path)

    def _latest(self) -> int:
        found = [int(n[8:]) for n in self.store.names() if re.fullmatch(r"pointer-[0-9]{12}", n)]
        return max(found, default=0)

    def read(self) -> DataFrame:
        """The cache's rows; a missing cache, and one whose last version or pointer is corrupt, has none."""
        return self._version(self._latest())

    def _version(self, n: int) -> DataFrame:
        got = None
        if n:
            version = self.store.text(f"pointer-{n:012d}")
            got = readable(self.spark, [f"{self.path}/{version}"], self.schema) if re.fullmatch(r"version-[0-9a-f]{32}", version) else None
        return got if got is not None else self.spark.createDataFrame([], self.schema)

    def upsert(self, rows: DataFrame, order: list[str] | None = None) -> int:
        """Put rows in, each in the place of its key's; returns the version's number.

        Of rows with one key the last by order counts (by all columns if it is not given); rows with a null key are
        left out. If another writer comes first, the merge is done again onto what it wrote.
        """
        names = [f.name for f in self.schema.fields]
        last = Window.partitionBy(*self.keys).orderBy(*[F.col(c).desc() for c in order or names])
        known = rows.where(" and ".join(f"`{k}` is not null" for k in self.keys))
        new = known.withColumn("__n", F.row_number().over(last)).where("__n = 1").select(*names)
        while True:
            n = self._latest()
            merged = self._version(n).join(new.select(*self.keys), self.keys, "left_anti").select(*names).unionByName(new)
            version = f"version-{uuid.uuid4().hex}"
            merged.write.parquet(f"{self.path}/{version}")
            if self.store.create(f"pointer-{n + 1:012d}", version):
                return n + 1
            self.store.delete(version)

    def vacuum(self, keep: int = 2) -> None:
        """Remove all but the last versions; keep as many as slow readers may still hold."""
        pointers = sorted(n for n in self.store.names() if re.fullmatch(r"pointer-[0-9]{12}", n))
        for pointer in pointers[:-keep]:
            version = self.store.text(pointer)
            if re.fullmatch(r"version-[0-9a-f]{32}", version):
                self.store.delete(version)
            self.store.delete(pointer)
