"""Groups streamed through Arrow without one pandas call for each."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of equal keys in sorted batches, each as a table; a run may cross batches."""
    import numpy as np

    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(n, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        if last is not None and first != last and held:
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *np.flatnonzero(change).tolist(), n]
        for i in range(len(cuts) - 1):
            if i:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(cuts[i], cuts[i + 1] - cuts[i]))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


def by_run(df: DataFrame, keys: list[str], order: list[str], fn: Callable[[pa.Table], dict | None], schema: str) -> DataFrame:
    """Deal df by keys and call fn on each group's table; fn returns columns or None. Callers bound their groups."""
    names = [x.split()[0] for x in schema.split(",")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = {k: [] for k in names}, 0
        for table in runs(batches, keys):
            got = fn(table)
            if got is None:
                continue
            for k in names:
                out[k].extend(got[k])
            n = len(out[names[0]])
            if n >= 10_000:
                yield pa.RecordBatch.from_pydict(out, schema=arrow)
                out = {k: [] for k in names}
        if out[names[0]]:
            yield pa.RecordBatch.from_pydict(out, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *keys).sortWithinPartitions(*keys, *order).mapInArrow(work, schema)


def block_pairs(df: DataFrame, key: str, salt: Column, size: int) -> DataFrame:
    """Cut each key's rows into blocks of about size rows and give every row to each pair of blocks it is in.

    Adds block (its own), i and j (the pair, i <= j). A key of n rows makes about n / size blocks, so no task holds
    more than two blocks and nothing is left out. Keys with one row go.
    """
    counts = df.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("_m"), F.count(F.lit(1)).alias("_n"))
    cut = df.join(counts.where("_n > 1"), key).withColumn("block", F.pmod(salt, F.col("_m")).cast("int"))
    pairs = cut.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    return pairs.withColumn("i", F.least("block", "_o")).withColumn("j", F.greatest("block", "_o")).drop("_o", "_m", "_n")
