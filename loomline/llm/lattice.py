"""Near-duplicate vectors by lattice hashing on E8.

Each table projects unit vectors to eight dimensions and decodes them to the nearest point of the E8 lattice; a
vector is filed under that cell and under the PROBES cells next nearest among the 240 neighbours. Vectors that
share a cell of a table are compared by cosine in double precision; equal vectors with equal labels are one node. Cells over BLOCK vectors are cut into blocks and
every pair of blocks is compared, so a crowded cell costs more tasks, not a longer one, and loses nothing.
The components of the verified links then give exact link counts: every linked pair lies in one component, whose
pairs are counted block by block and never written out.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.components import components
from loomline.llm.grouped import block_pairs, by_run
from loomline.llm.simhash import _forest
from loomline.llm.store import save

BLOCK = 512
TABLES, PROBES, SCALE, SEED = 5, 6, 1.2, 8


def e8_neighbours():
    """The 240 shortest vectors of E8."""
    import numpy as np

    whole = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            whole.append(v)
    half = [np.array(s) / 2 for s in itertools.product((1.0, -1.0), repeat=8) if np.prod(s) > 0]
    return np.array(whole + half)


def e8_nearest(y):
    """The E8 point nearest to each row of y: the better of the nearest points of D8 and of D8 shifted by a half."""
    import numpy as np

    def d8(x):
        near = np.rint(x)
        odd = np.flatnonzero(near.sum(1) % 2)
        off = x[odd] - near[odd]
        worst = np.abs(off).argmax(1)
        near[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
        return near

    whole, half = d8(y), d8(y - 0.5) + 0.5
    closer = ((y - whole) ** 2).sum(1) <= ((y - half) ** 2).sum(1)
    return np.where(closer[:, None], whole, half)


def cells(unit, tables: int, probes: int, scale: float, seed: int):
    """Integer coordinates (doubled), shape (tables, probes + 1, rows, 8): the own cell and the next nearest ones."""
    import numpy as np

    around = np.concatenate([np.zeros((1, 8)), e8_neighbours()])
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(tables):
        y = unit @ (rng.standard_normal((unit.shape[1], 8)) * scale)
        own = e8_nearest(y)
        off = y - own
        gap = (around**2).sum(1) - 2 * off @ around.T
        near = np.argsort(gap, axis=1, kind="stable")[:, : probes + 1]
        out.append(np.rint(2 * (own[:, None, :] + around[near])).astype(np.int32).transpose(1, 0, 2))
    return np.array(out)


def _filed(vectors: DataFrame, tables: int, probes: int, scale: float, seed: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids, labels, rows = part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()
                keys: list = [None] * len(rows)
                for d in {len(r) for r in rows}:
                    at_d = [i for i, r in enumerate(rows) if len(r) == d]
                    x = np.array([rows[i] for i in at_d], np.float64)
                    x /= np.abs(x).max(1, keepdims=True)  # else squares may leave the range of doubles
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    c = cells(x, tables, probes, scale, seed)
                    for n, i in enumerate(at_d):
                        head = f"{labels[i]}:{d}:".encode()
                        keys[i] = [
                            xxhash.xxh64_intdigest(head + bytes([t]) + c[t, p, n].tobytes()) - (1 << 63)
                            for t in range(tables)
                            for p in range(c.shape[1])
                        ]
                    for n, i in enumerate(at_d):
                        rows[i] = x[n].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array(rows, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["id", "label", "unit", "keys"],
                )

    return vectors.mapInArrow(work, "id long, label string, unit binary, keys array<long>")


def _sides(table: pa.Table, within: list[str]):
    """ids, unit vectors and the columns within of the lower and the upper block of a pair of blocks."""
    import numpy as np

    block, i, j = (table.column(k).to_numpy() for k in ("block", "i", "j"))
    ids = table.column("id").to_numpy()
    units = [np.frombuffer(u.as_buffer(), np.float64) for u in table.column("unit")]
    extra = [table.column(k).to_pylist() for k in within]
    first = np.flatnonzero(block == i)
    second = first if i[0] == j[0] else np.flatnonzero(block == j)
    return [(ids[s], [units[k] for k in s], [tuple(e[k] for e in extra) for k in s]) for s in (first, second)], i[0] == j[0]


def _near(first, second, same: bool, least: float):
    import numpy as np

    near = np.zeros((len(first[0]), len(second[0])), bool)
    dims = {len(u) for u in first[1]} & {len(u) for u in second[1]}
    for d in dims:
        a, b = ([k for k, u in enumerate(s[1]) if len(u) == d] for s in (first, second))
        x, y = np.array([first[1][k] for k in a]), np.array([second[1][k] for k in b])
        near[np.ix_(a, b)] = x @ y.T >= least
    labels = np.array([x[0] for x in first[2]], object)[:, None] == np.array([x[0] for x in second[2]], object)[None, :]
    near &= labels
    if same:
        np.fill_diagonal(near, False)
    return near


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    min_cosine: float = 0.93,
    tables: int = TABLES,
    probes: int = PROBES,
    scale: float = SCALE,
    seed: int = SEED,
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors.

    Vectors link if their labels are equal and not null and their cosine reaches min_cosine. Null or zero vectors,
    those with null or non-finite components or a null label, and rows with a null id link with nothing (component:
    themselves). Vectors of different lengths never link. Rows that repeat an id are one vector (the least of
    label, components) and all get its result. Other columns are ignored; an empty table gives an empty result.
    """
    import numpy as np

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    big = F.lit(float("inf"))
    good = rows.where(
        "id is not null and label is not null and size(v) > 0"
    ).where(F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < big)) & F.exists("v", lambda x: x != 0))
    one = good.groupBy("id").agg(F.min(F.struct("label", "v")).alias("s")).select("id", "s.label", "s.v")
    one = save(one.withColumn("same", F.xxhash64("label", "v")), "rows")
    nodes = one.groupBy("same", "label", "v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("m"))
    filed = save(_filed(nodes.select("id", "label", "v"), tables, probes, scale, seed), "vectors")
    copies = save(nodes.select("id", "same", "label", "v", "m"), "copies")
    units = filed.select("id", "label", "unit")
    entries = filed.select("id", F.explode("keys").alias("key"))
    met = block_pairs(entries, "key", F.xxhash64("id"), BLOCK)

    def forest(table: pa.Table) -> dict | None:
        (first, second), same = _sides(table, ["label"])
        near = _near(first, second, same, min_cosine)
        if not near.any():
            return None
        i, j = np.nonzero(np.triu(near) if same else near)
        a, b = _forest(first[0], second[0], zip(i.tolist(), j.tolist()))
        return {"a": a, "b": b}

    linked = by_run(met.join(units, "id"), ["key", "i", "j"], [], forest, "a long, b long")
    groups = save(components(linked), "groups").select(F.col("node").alias("id"), "root")

    def count(table: pa.Table) -> dict | None:
        (first, second), same = _sides(table, ["label", "m"])
        near = _near(first, second, same, min_cosine).astype(np.int64)
        ids = [*first[0].tolist(), *([] if same else second[0].tolist())]
        m = [np.array([e[1] for e in side[2]], np.int64) for side in (first, second)]
        return {"id": ids, "n": [*(near @ m[1]).tolist(), *([] if same else (m[0] @ near).tolist())]}

    inside = block_pairs(groups, "root", F.xxhash64("id"), BLOCK).join(units, "id").join(copies.select("id", "m"), "id")
    counts = by_run(inside, ["root", "i", "j"], [], count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    linked = copies.join(counts, "id", "left").join(groups, "id", "left")
    linked = linked.select("same", "label", "v", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("root", "id").alias("root"))
    result = one.join(save(linked.where("n_links > 0"), "linked"), ["same", "label", "v"]).select("id", "n_links", "root")
    return (
        rows.select("id").join(result, "id", "left")
        .select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
