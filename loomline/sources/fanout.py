"""One output file for every input file, written by a Python data source.

Each task stages the files that it holds; only the job's commit moves them into place, and an abort removes the
staging folder, so a task that dies and runs again leaves nothing twice and a job that fails leaves nothing at all.
A file with an error goes to quarantine as its error alone; the others are whole.
"""

from __future__ import annotations

import itertools
import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

ROWS = "file string, pos long, value string, error string"
STAGING, DONE, QUARANTINE = "_staging", "files", "quarantine"


@dataclass
class Written(WriterCommitMessage):
    """What one task staged: file names and staged paths, and the errors of files that failed."""

    done: list[tuple[str, str]] = field(default_factory=list)
    failed: list[tuple[str, str]] = field(default_factory=list)


def _system(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


class FanOut(DataSource):
    """Rows (ROWS), those of a file together and in order, to <path>/files/<name> and <path>/quarantine/<name>."""

    @classmethod
    def name(cls) -> str:
        return "one_file_each"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Files(self.options["path"], self.options["job"])


class _Files(DataSourceWriter):
    def __init__(self, path: str, job: str) -> None:
        self.path, self.job = path, job

    def _folder(self) -> tuple:
        system, root = _system(self.path)
        return system, root, f"{root}/{STAGING}/{self.job}"

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        system, _, staging = self._folder()
        system.create_dir(staging, recursive=True)
        out = Written()
        for file, rows in itertools.groupby(iterator, key=lambda row: row["file"]):
            if file is None:
                continue
            staged, error = f"{staging}/{uuid.uuid4().hex}", None
            with system.open_output_stream(staged) as stream:
                for row in rows:
                    if row["error"] is not None:
                        error = row["error"]
                        break
                    if row["value"] is not None:
                        stream.write(row["value"].encode() + b"\n")
            if error is None:
                out.done.append((file, staged))
            else:
                system.delete_file(staged)
                out.failed.append((file, error))
        return out

    def commit(self, messages: list) -> None:
        system, root, staging = self._folder()
        for folder in (DONE, QUARANTINE):
            system.create_dir(f"{root}/{folder}", recursive=True)
        for message in messages:
            for file, staged in message.done:
                system.move(staged, f"{root}/{DONE}/{_safe(file)}")
            for file, error in message.failed:
                with system.open_output_stream(f"{root}/{QUARANTINE}/{_safe(file)}") as stream:
                    stream.write(error.encode())
        system.delete_dir(staging)

    def abort(self, messages: list) -> None:
        system, _, staging = self._folder()
        system.create_dir(staging, recursive=True)
        system.delete_dir(staging)


def _safe(file: str) -> str:
    """A file name of any text: what is no letter, digit or one of -._~ is percent-encoded, as are names that hide a file."""
    name = quote(file, safe="") or "%"
    return name if name[0] not in "._" else f"%{ord(name[0]):02X}{name[1:]}"


def write_each(rows: DataFrame, path: str) -> None:
    """Write rows (ROWS) as one file for each file, its values as lines in order of pos.

    A file's rows meet in one task, which holds one row at a time; a file with an error at any place is quarantined
    under the same name. Rows with a null file go nowhere, null values give no line, and a file without rows does not
    exist. A file that is already there is replaced, so a job may be run again; others stay.
    """
    rows.sparkSession.dataSource.register(FanOut)
    dealt = rows.select(*[x.split()[0] for x in ROWS.split(", ")]).repartition("file").sortWithinPartitions("file", "pos")
    dealt.write.format("one_file_each").option("job", uuid.uuid4().hex).mode("append").save(path)


def converted(rows: DataFrame, file: str, order: list[str], convert: Callable[[Iterable], Iterable[str]]) -> DataFrame:
    """ROWS of what convert makes of each file's rows in order: its lines, or, where it raises, an error after them.

    For conversions that have no column form: convert gets an iterator of a file's rows and yields lines, and what one
    file raises is that file's alone. Built-in columns are to be preferred, with the error as a column beside them.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        each = (row for batch in batches for row in batch.itertuples(index=False))
        for name, group in itertools.groupby(each, key=lambda row: getattr(row, file)):
            n = 0
            try:
                for line in convert(group):
                    out.append((name, n, line, None))
                    n += 1
                    if len(out) >= 10_000:
                        yield pd.DataFrame(out, columns=["file", "pos", "value", "error"])
                        out = []
            except Exception as e:  # what a file raises is its own result
                out.append((name, n, None, f"{type(e).__name__}: {e}"))
        if out:
            yield pd.DataFrame(out, columns=["file", "pos", "value", "error"])

    return rows.repartition(file).sortWithinPartitions(file, *order).mapInPandas(work, ROWS)


def read_each(spark: SparkSession, path: str) -> DataFrame:
    """file, value (the whole text) and error of the files that write_each left with a line or an error."""
    stored = F.url_decode("_metadata.file_name")
    name, none = F.coalesce(F.try_url_decode(stored), F.lit("")).alias("file"), F.lit(None).cast("string")
    done = spark.read.text(f"{path}/{DONE}", wholetext=True).select(name, "value", none.alias("error"))
    failed = spark.read.text(f"{path}/{QUARANTINE}", wholetext=True).select(name, none.alias("value"), F.col("value").alias("error"))
    return done.unionByName(failed)
