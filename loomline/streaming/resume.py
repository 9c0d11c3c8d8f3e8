"""Batches that can be stopped and run on: a file stream, a ledger of batch ids and the codes that each has done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomline.sources.cache import _Store, readable


def load_codes(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The codes (schema) saved at path; none if the state is missing, empty or corrupt."""
    got = readable(spark, [path], schema)
    return got if got is not None else spark.createDataFrame([], schema)


def save_codes(codes: DataFrame, path: str) -> None:
    """Save codes as the state at path, in the place of what it held: written beside it, then renamed."""
    store = _Store(codes.sparkSession, path.rsplit("/", 1)[0])
    name = path.rsplit("/", 1)[1]
    codes.distinct().write.mode("overwrite").parquet(f"{path}.new")
    store.delete(name)
    store.fs.rename(store.path(f"{name}.new"), store.path(name))


class Resumable:
    """Process files once each, code by code; what a stop or failure leaves undone is done by the next run.

    The stream's checkpoint keeps which files a batch has, so a batch that failed comes again with its id and files.
    Its output and its codes are folders named by the id and are written over, so a batch that comes again leaves
    nothing twice. A code is done by the first batch that has it, once, with its first row by the other columns; batches
    with a later id pass it by. A batch whose
    ledger entry is missing or corrupt counts as if it had done nothing.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], process: Callable[[DataFrame], DataFrame]) -> None:
        self.spark, self.path, self.schema, self.keys, self.process = spark, path.rstrip("/"), schema, keys, process
        self.codes = StructType([schema[k] for k in keys])

    def done(self, before: int | None = None) -> DataFrame:
        """The codes that batches (with an id below before) have done."""
        names = [n for n in _Store(self.spark, f"{self.path}/ledger").names() if before is None or int(n.split("=")[1]) < before]
        paths = [f"{self.path}/ledger/{n}" for n in names]
        got = readable(self.spark, paths, self.codes) if paths else None
        if got is None:  # only the entries that are whole count
            whole = [p for p in paths if readable(self.spark, [p], self.codes) is not None]
            got = self.spark.read.schema(self.codes).parquet(*whole) if whole else self.spark.createDataFrame([], self.codes)
        return got

    def _batch(self, rows: DataFrame, batch: int) -> None:
        known = rows.where(" and ".join(f"`{k}` is not null" for k in self.keys))
        first = Window.partitionBy(*self.keys).orderBy(*[F.col(c) for c in rows.columns if c not in self.keys] or self.keys)
        once = known.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
        fresh = once.join(self.done(batch), self.keys, "left_anti")
        out, entry = f"{self.path}/out/batch={batch}", f"{self.path}/ledger/batch={batch}"
        self.process(fresh).write.mode("overwrite").parquet(out)
        fresh.select(*self.keys).write.mode("overwrite").parquet(entry)

    def run(self, source: str, files: int = 1) -> None:
        """Process what has come to the folder source since the last run, so many files a batch, then stop."""
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", files).parquet(source)
        writer = stream.writeStream.foreachBatch(self._batch).option("checkpointLocation", f"{self.path}/stream")
        writer.trigger(availableNow=True).start().awaitTermination()

    def output(self) -> DataFrame:
        """Everything processed so far, with batch."""
        return self.spark.read.option("basePath", f"{self.path}/out").parquet(f"{self.path}/out").withColumn("batch", F.col("batch").cast("long"))
