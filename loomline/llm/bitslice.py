"""Exact top-k by inner product over a bit-sliced index.

Rows are cut into blocks; a block holds, for each attribute and each bit of the quantised attribute, a bitmap over
its rows. A query adds the slices with bitmap arithmetic: attribute j's slice s enters the sum's slice s + b for each
set bit b of the query's weight, and carry-save adders reduce every level to one bitmap (negative weights use the
complemented slices, which shifts the sum by a constant). Top rows are then selected from the most significant slice
of the sum downward; rows that tie at the boundary are resolved exactly by their integer scores and ids. Each block
returns k rows for each query and a grouped limit merges them. Query blocks stream past a row block, so a task holds
one block of each; they are dealt to row blocks by (length, part), so that equal lengths make no hot key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.store import save

ROWS, QUERIES = 8192, 64
DEALS = 64  # parts of the row blocks, by which query blocks meet them


def slices(values):
    """values: (rows, attributes) of non-negative integers. Bitmaps (attributes, bits, words) of 64-bit words."""
    import numpy as np

    bits, columns = max(1, int(values.max(initial=0)).bit_length()), np.ascontiguousarray(values.T)
    out = np.zeros((columns.shape[0], bits, -(-columns.shape[1] // 64) * 8), np.uint8)
    for b in range(bits):  # a plane at a time
        packed = np.packbits((columns >> b & 1).astype(np.uint8), axis=1, bitorder="little")
        out[:, b, : packed.shape[1]] = packed
    return out.view(np.uint64)


def weighted_sum(both, weights):
    """Slices of the sum over attributes of |weight| x value, lowest first. both: slices and complements, stacked."""
    import numpy as np

    bits, words = both.shape[2], both.shape[3]
    levels: dict[int, list] = {}
    for j, w in enumerate(weights):
        side, w, b = int(w < 0), abs(int(w)), 0
        while w:
            if w & 1:
                for s in range(bits):
                    levels.setdefault(b + s, []).append((side * both.shape[1] + j) * bits + s)
            w >>= 1
            b += 1
    flat = both.reshape(-1, words)
    out, carried, at = [], np.empty((0, words), np.uint64), 0
    top = max(levels, default=-1)
    while at <= top or len(carried):
        x = np.concatenate([flat[levels[at]], carried]) if at in levels else carried
        carries = []
        while len(x) > 2:
            n = len(x) // 3
            a, b, c = x[:n], x[n : 2 * n], x[2 * n : 3 * n]
            half = a ^ b
            carries.append((a & b) | (c & half))
            x = np.concatenate([half ^ c, x[3 * n :]])
        if len(x) == 2:
            carries.append((x[0] & x[1])[None])
            x = (x[0] ^ x[1])[None]
        out.append(x[0] if len(x) else np.zeros(words, np.uint64))
        carried = np.concatenate(carries) if carries else np.empty((0, words), np.uint64)
        at += 1
    return out


def select_top(total, alive, k: int):
    """Bitmaps of the rows surely in the top k and of those that tie at its boundary, from the top slice downward."""
    import numpy as np

    sure, edge = np.zeros_like(alive), alive
    have = 0
    for plane in reversed(total):
        high = edge & plane
        n = int(np.bitwise_count(high).sum())
        if have + n > k:
            edge = high
        else:
            sure, have, edge = sure | high, have + n, edge & ~plane
            if have == k:
                return sure, np.zeros_like(edge)
    return sure, edge


def _positions(bitmap):
    import numpy as np

    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def _blocks(rows: DataFrame, size: int, kind: int) -> DataFrame:
    """Rows (id, v array<long>) as blocks of at most size rows of one length: id, kind, d, ids and values as bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        base, n = TaskContext.get().partitionId() << 32, 0
        held: dict[int, list] = {}

        def block(d):
            nonlocal n
            ids, values = zip(*held.pop(d))
            n += 1
            return pa.RecordBatch.from_pydict(
                {"block": [base + n], "kind": [kind], "d": [d], "ids": [np.array(ids, np.int64).tobytes()], "values": [np.array(values, np.int64).tobytes()]},
                schema=pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("d", pa.int32()), ("ids", pa.binary()), ("values", pa.binary())]),
            )

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(len(v), []).append((i, v))
                if len(held[len(v)]) == size:
                    yield block(len(v))
        for d in list(held):
            yield block(d)

    return rows.mapInArrow(work, "block long, kind int, d int, ids binary, values binary")


def quantise(v: Column, factor: int = 256) -> Column:
    return F.transform(v.cast("array<double>"), lambda x: F.floor(x * factor))


def top_k(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", factor: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query row its k highest inner products of floor(factor x).

    Candidates are all rows but those with the query's id; ties go to the smaller id; fewer candidates give fewer
    rows. Null vectors, empty ones, those with null or non-finite components and rows with null ids take no part.
    Only vectors of the query's length are candidates. Rows that repeat an id are one query (the least vector), and
    each is a candidate of its own. Scores are 64-bit integers: if a quantised value or a score could leave their
    range, the query ends with an error that says so. Other columns are ignored; an empty table gives an empty result.
    """
    spark = rows.sparkSession
    big = F.lit(float("inf"))
    whole = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("x"), is_query.alias("q"))
    good = whole.where("id is not null and size(x) > 0").where(F.forall("x", lambda c: c.isNotNull() & (F.abs(c) < big)))
    # a value's square times the number of components bounds every score
    fits = F.forall("x", lambda c: F.abs(c) * factor + 1 <= F.sqrt(F.lit(2.0**62) / F.size("x")))
    good = good.withColumn("x", F.when(fits, F.col("x")).otherwise(F.raise_error(F.lit("a component is too large for 64-bit scores"))))
    good = good.select("id", quantise(F.col("x"), factor).alias("v"), "q")
    stored = save(_blocks(good.select("id", "v"), ROWS, 0), "slices")
    asked = good.where("q").groupBy("id").agg(F.min("v").alias("v"))
    queries = save(_blocks(asked, QUERIES, 1), "asked")
    lists = stored.select("block", "d", F.pmod(F.xxhash64("block"), F.lit(DEALS)).alias("deal")).groupBy("d", "deal").agg(F.collect_list("block").alias("blocks"))
    dealt = queries.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1)).cast("array<long>"))).join(lists, ["d", "deal"])
    paired = dealt.select(F.explode("blocks").alias("block"), "kind", "ids", "values")
    both = stored.select("block", "kind", "ids", "values").unionByName(paired)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        now = None
        for batch in batches:
            for r in range(batch.num_rows):
                ids = np.frombuffer(batch.column("ids")[r].as_buffer(), np.int64)
                values = np.frombuffer(batch.column("values")[r].as_buffer(), np.int64).reshape(len(ids), -1)
                if batch.column("kind")[r].as_py() == 0:
                    low = values.min(0)
                    cut = slices(values - low)
                    alive = slices(np.ones((len(ids), 1), np.int64))[0, 0]
                    now = ids, values, np.stack([cut, ~cut & alive]), alive
                    continue
                row_ids, row_values, planes, alive = now
                out = []
                for query, weights in zip(ids.tolist(), values):
                    open_rows = alive
                    if len(own := np.flatnonzero(row_ids == query)):
                        bits = np.zeros(len(alive) * 64, np.uint8)
                        bits[own] = 1
                        open_rows = alive & ~np.packbits(bits, bitorder="little").view(np.uint64)
                    sure, edge = select_top(weighted_sum(planes, weights), open_rows, k)
                    found = np.concatenate([_positions(sure), _positions(edge)])
                    scores = row_values[found] @ weights
                    order = np.lexsort((row_ids[found], -scores))[:k]
                    out += [(query, int(row_ids[found[o]]), int(scores[o])) for o in order]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*out) if out else ([], [], []))], names=["query_id", "vec_id", "score"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartition(parts, "block").sortWithinPartitions("block", "kind")
    found = dealt.mapInArrow(score, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
