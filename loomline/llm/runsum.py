"""Running sums within keys over range-sorted partitions: a key may hold any share of the rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from loomline.llm.store import save


def running(df: DataFrame, keys: list[str], order: list[str], sums: list[str], name: str) -> DataFrame:
    """df with each of sums (longs, 0 or more) replaced by its running sum within the key, in order, the row included.

    Rows are range-partitioned by key and order, so a large key spreads over many tasks. Each task adds up its own rows,
    and what a key had in earlier partitions is added after: at most one key goes on from one partition into the next,
    so that table has fewer rows than there are partitions. Keys must not be null; df should be a stored table, as
    range partitioning reads it twice.
    """
    schema = StructType([*df.schema.fields]).add("_part", IntegerType())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        part, last, carry = TaskContext.get().partitionId(), None, [0] * len(sums)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            new = np.zeros(n, bool)
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            new[0] = last != tuple(c[0] for c in cols)
            start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            out = dict(zip(batch.schema.names, batch.columns))
            for i, name in enumerate(sums):
                value = batch.column(name).to_numpy()
                total = np.cumsum(value)
                total += np.where(start >= 0, value[start] - total[start], carry[i])
                carry[i] = total[-1]
                out[name] = pa.array(total)
            last = tuple(c[-1] for c in cols)
            out["_part"] = pa.array(np.full(n, part, np.int32))
            yield pa.RecordBatch.from_pydict(out)

    ordered = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    rows = save(ordered.mapInArrow(work, schema), name)
    ends = rows.groupBy(*keys, "_part").agg(*[F.max(s).alias(f"_{s}") for s in sums])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    late = ends.select(*keys, "_part", *[F.sum(f"_{s}").over(before).alias(f"_{s}") for s in sums]).where(F.col(f"_{sums[0]}").isNotNull())
    joined = rows.join(F.broadcast(late), [*keys, "_part"], "left")
    return joined.select(*[(F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c) if c in sums else F.col(c) for c in df.columns])
