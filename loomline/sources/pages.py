"""A paginated source as a Python data source: a partition is a range of offsets, failed pages get a second pass."""

from __future__ import annotations

import importlib
import time
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructType

from loomline.operators.rounds import stored

OFFSET, ERROR = "_offset", "_error"
OWN = ("fetch", "limit", "tries", "pause", "offsets", "path")


def _named(name: str) -> Callable[..., dict[str, Any]]:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


class Paged(DataSource):
    """Items of fetch(offset, limit, **options), which gives items (dicts), total, and next (null at the end)."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Pages(dict(self.options), schema)


class _Pages(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.fetch, self.limit, self.tries = options["fetch"], int(options["limit"]), int(options["tries"])
        self.pause, self.offsets = float(options["pause"]), options.get("offsets")
        self.others = {k: v for k, v in options.items() if k not in OWN}
        self.names = [f.name for f in schema.fields if f.name not in (OFFSET, ERROR)]

    def _page(self, offset: int, limit: int) -> dict[str, Any]:
        for n in range(self.tries):
            try:
                return _named(self.fetch)(offset, limit, **self.others)
            except Exception:
                if n + 1 == self.tries:
                    raise
                time.sleep(self.pause * 2**n)
        raise AssertionError

    def partitions(self) -> list[InputPartition]:
        if self.offsets is not None:
            starts = [int(x) for x in self.offsets.split(",") if x]
        else:
            total = self._page(0, 1).get("total")
            if total is None:  # only the pages themselves tell where they end
                return [InputPartition((0, True))]
            starts = list(range(0, total, self.limit))
        return [InputPartition((at, False)) for at in starts]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        at, follow = partition.value
        while True:
            try:
                page = self._page(at, self.limit)
            except Exception as e:
                yield (*[None] * len(self.names), at, f"{type(e).__name__}: {e}")
                return
            for item in page["items"]:
                yield (*[item.get(name) for name in self.names], at, None)
            at += self.limit
            if not follow or page.get("next") is None or not page["items"]:
                return


def read_pages(spark: SparkSession, fetch: str, schema: StructType, limit: int = 50, tries: int = 1, pause: float = 0.5, passes: int = 2, **options: str) -> DataFrame:
    """The items of a paginated source (schema), each page read by a task of its own.

    fetch names a function as module:function. A page is asked for tries times, with growing pauses; pages that still
    fail are read again in a pass of their own after all others, up to passes in all, and those that then fail raise an
    error with their offsets. Every pass is stored, so no page that came is asked for again. A source that tells no total
    is followed page by page in one task.
    """
    spark.dataSource.register(Paged)
    whole = StructType([*schema.fields]).add(OFFSET, LongType()).add(ERROR, StringType())
    reader = spark.read.format("paged").schema(whole).option("fetch", fetch).option("limit", limit).option("tries", tries).option("pause", pause)
    got, failed = None, None
    for _ in range(passes):
        asked = reader.options(**options) if failed is None else reader.options(**options).option("offsets", ",".join(str(x) for x in failed))
        page = stored(asked.load())
        rows = page.where(F.col(ERROR).isNull()).drop(OFFSET, ERROR)
        got = rows if got is None else got.unionByName(rows)
        bad = page.where(F.col(ERROR).isNotNull()).select(OFFSET, ERROR).collect()  # at most one row a page
        failed = sorted(r[OFFSET] for r in bad)
        if not failed:
            return got
    raise RuntimeError(f"pages at offsets {failed} failed: {bad[0][ERROR]}")


def parquet_page(offset: int, limit: int, table: str) -> dict[str, Any]:
    """A page of a Parquet table in stored order, read from the row groups that hold it."""
    import pyarrow as pa
    import pyarrow.dataset as ds

    parts, at = [], 0
    for fragment in ds.dataset(table, format="parquet").get_fragments():
        for group in fragment.split_by_row_group():
            n = group.count_rows()
            low, high = max(offset - at, 0), min(offset + limit - at, n)
            if low < high:
                parts.append(group.to_table().slice(low, high - low))
            at += n
    items = pa.concat_tables(parts).to_pylist() if parts else []
    return {"items": items, "total": at, "next": offset + limit if offset + limit < at else None}
