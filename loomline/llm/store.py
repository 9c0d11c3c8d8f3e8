"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; in local mode, where there is one machine, one is made if it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="loomline-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def save(df: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: a lost executor costs no recomputation.

    most: files to write at most, where the number of rows is known. Tables stay until the folder is cleared, as the
    results that callers get are read from them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomline/{name}-{uuid.uuid4().hex}"
    (df.coalesce(most) if most else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """names, each with as many underscores after it as it takes to be none of df's columns, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out
