"""Order-dependent rules as folds over sorted partitions: a task holds a key's state and a batch, never a key's rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def folded(rows: DataFrame, key: str | list[str], order: list[str], start: Callable[[], object], step: Callable, into: str) -> DataFrame:
    """rows dealt by key and in order, with a column more (into, as name and type): step(state, row) gives its value
    and may change the state, which start() makes anew for each key."""
    name, kind = into.split(" ", 1)
    keys = [key] if isinstance(key, str) else key

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, begun = None, None, False
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                own = [getattr(row, k) for k in keys]
                if not begun or own != now:
                    now, state, begun = own, start(), True
                out.append(step(state, row))
            batch[name] = pd.Series(out, index=batch.index, dtype=object)
            yield batch

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(work, f"{fields}, {name} {kind}")


def folded_in_pieces(rows: DataFrame, key: str, order: list[str], fresh: Column, start: Callable[[], object], step: Callable, into: str) -> DataFrame:
    """folded(), with each key cut before every row for which fresh holds, and that as a column more (fresh).

    fresh must hold only where no earlier row of the key bears on what follows. A key's pieces then go to many tasks,
    so a key with a large share of the rows costs one task no more than its longest piece.
    """
    so_far = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    cut = rows.withColumn("fresh", F.coalesce(fresh, F.lit(False))).withColumn("piece", F.count_if("fresh").over(so_far))
    return folded(cut, [key, "piece"], order, start, step, into).drop("piece")
