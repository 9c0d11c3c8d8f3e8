"""Prefix trie of rebuilt conversations, with leaf counts and savings of every subtree by pointer jumping.

A turn's digest covers its depth, role and text, and a prefix's digest is the lane-wise sum of its turns' digests: as
depths are part of them, sums tell sequences apart, and they come from running sums over range-sorted partitions, so a
conversation may hold any share of the turns. Nodes are groups of equal prefix digests; a node's parent edge is the
digest of its prefix less the last turn.

The rollup doubles: in round r every node adds what the nodes 2^r below it have gathered, and its pointer jumps to its
pointer's pointer, so the rounds grow with the logarithm of the depth. Nodes with one member take no part: their
subtree is a chain of such nodes, with one leaf and nothing saved, which counts as one leaf at the shared parent.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.runsum import running
from loomline.llm.store import save

LANES = ["l0", "l1", "l2", "l3"]  # 32 bits each, summed in longs
WORD = r"[^\x20\x09-\x0D]+"
GROUP, SHARED = 20, 4


def _lanes(first: Column, second: Column) -> list[Column]:
    low = F.lit(0xFFFFFFFF)
    parts = (first.bitwiseAND(low), F.shiftrightunsigned(first, 32), second.bitwiseAND(low), F.shiftrightunsigned(second, 32))
    return [p.alias(name) for p, name in zip(parts, LANES)]


def _id(depth: Column, lanes: list[Column]) -> tuple[Column, Column]:
    """Two longs that name a node."""
    return F.xxhash64(depth, *lanes), F.xxhash64(F.lit(1), depth, *lanes)


def _placed(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """c, pos (from 0), ta, tb (digests of role and text), words of every turn."""
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in (role_col, text_col))
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("c"),
        F.col(turn_col).alias("turn"),
        role.alias("role"),
        F.xxhash64(role, text).alias("ta"),
        F.xxhash64(F.lit(1), role, text).alias("tb"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
        F.lit(1).cast("long").alias("pos"),
    )
    placed = running(save(rows, "turns"), ["c"], ["turn", "role", "ta", "tb"], ["pos"], "turns-placed")
    return placed.select("c", (F.col("pos") - 1).alias("pos"), "ta", "tb", "words")


def _rebuilt(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every rebuilt turn as c, depth, size (of its conversation), ta, tb, words; and c, size of every conversation."""
    own = placed.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    own = save(own.select("c", "n", (F.col("c") - F.col("c") % GROUP).alias("base"), (F.crc32(F.col("c").cast("string")) % SHARED).alias("h")), "convs")
    bases = own.select(F.col("c").alias("base"), F.col("n").alias("of_base"))
    shared = F.least("h", F.coalesce("of_base", F.lit(0)))
    convs = save(own.join(bases, "base", "left").select("c", "base", "h", shared.alias("b"), (shared + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")), "convs-rebuilt")
    firsts = placed.where(F.col("pos") < SHARED - 1).withColumnRenamed("c", "base")
    heads = convs.join(firsts, "base").where("pos < b").select("c", (F.col("pos") + 1).alias("depth"), "size", "ta", "tb", "words")
    tails = placed.join(convs, "c").where("pos >= h").select("c", (F.col("pos") - F.col("h") + F.col("b") + 1).alias("depth"), "size", "ta", "tb", "words")
    return heads.unionByName(tails), convs.select("c", "size")


def _prefixes(rebuilt: DataFrame) -> DataFrame:
    """ia, ib (node), pa, pb (its parent), c, depth, words, last of every rebuilt turn."""
    terms = _lanes(F.xxhash64("depth", "ta", "tb"), F.xxhash64(F.lit(1), F.col("depth"), F.col("ta"), F.col("tb")))
    own = [t.alias(f"o{i}") for i, t in enumerate(terms)]
    rows = save(rebuilt.select("c", "depth", "size", "words", *terms, *own), "rebuilt")
    summed = running(rows, ["c"], ["depth"], LANES, "prefixes")
    ia, ib = _id(F.col("depth"), [F.col(x) for x in LANES])
    above, before = F.col("depth") - 1, [F.col(x) - F.col(f"o{i}") for i, x in enumerate(LANES)]
    up, up2 = _id(above, before)
    return summed.select(ia.alias("ia"), ib.alias("ib"), up.alias("pa"), up2.alias("pb"), "c", "depth", "words", (F.col("depth") == F.col("size")).alias("last"))


def rollup(nodes: DataFrame, deepest: int) -> DataFrame:
    """ia, ib, n_leaves, saved: the sums of leaves and saved over each node's subtree.

    nodes: ia, ib, pa, pb (null at roots), leaves, saved; deepest: the largest number of edges on a path, or more.
    """
    state = nodes.select("ia", "ib", "pa", "pb", "leaves", "saved")
    for step in range(deepest.bit_length()):
        below = state.where("pa IS NOT NULL").groupBy(F.col("pa").alias("ia"), F.col("pb").alias("ib")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        jumps = state.select(F.col("ia").alias("pa"), F.col("ib").alias("pb"), F.col("pa").alias("qa"), F.col("pb").alias("qb"))
        jumped = state.join(jumps, ["pa", "pb"], "left").join(below, ["ia", "ib"], "left")
        total = [(F.col(x) + F.coalesce(f"more_{x}", F.lit(0))).alias(x) for x in ("leaves", "saved")]
        state = save(jumped.select("ia", "ib", F.col("qa").alias("pa"), F.col("qb").alias("pb"), *total), f"jump-{step}")
    return state.select("ia", "ib", F.col("leaves").alias("n_leaves"), "saved")


def _joined_ids(ends: DataFrame) -> DataFrame:
    """ia, ib, ends_sha256: the SHA-256 of each node's c in order, comma-joined.

    Sorted partitions first turn each run of a node's ids into one row of text; one task then feeds a node's few texts
    to its digest one after the other, so it holds one at a time.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            if not batch.num_rows:
                continue
            ia, ib, c = (batch.column(i).to_numpy() for i in range(3))
            at = np.flatnonzero(np.r_[True, (ia[1:] != ia[:-1]) | (ib[1:] != ib[:-1])])
            ids = c.astype(str).tolist()
            texts = [",".join(ids[i:j]) for i, j in zip(at.tolist(), [*at[1:].tolist(), len(ids)])]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ia[at], ib[at], c[at], texts)], names=["ia", "ib", "c", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, hashlib.sha256()
        for batch in batches:
            out: list[tuple] = []
            for ia, ib, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                if (ia, ib) != node:
                    out += [(*node, sha.hexdigest())] if node else []
                    node, sha = (ia, ib), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema=schema)
        if node:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*node, sha.hexdigest())))], schema=schema)

    schema = pa.schema([("ia", pa.int64()), ("ib", pa.int64()), ("ends_sha256", pa.string())])
    ordered = ends.repartitionByRange("ia", "ib", "c").sortWithinPartitions("ia", "ib", "c")
    runs = ordered.select("ia", "ib", "c").mapInArrow(chunks, "ia long, ib long, c long, ids string")
    return runs.repartition("ia", "ib").sortWithinPartitions("ia", "ib", "c").mapInArrow(digests, "ia long, ib long, ends_sha256 string")


def trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    Conversations are ordered by turn, null first; equal turns follow their role, then a digest of role and text. Null
    roles and texts are empty. Conversation c starts with the first h turns of conversation c - c % 20 (all if fewer, none
    if it is absent), h being crc32 of its decimal id modulo 4, and goes on with its own turns after its first h. A node
    is a distinct sequence of first turns, the root that of none; conv_id is its smallest member. Rows with a null
    conversation take no part, other columns are ignored, and an empty table gives an empty result.
    """
    rebuilt, convs = _rebuilt(_placed(turns, conv_col, turn_col, role_col, text_col))
    prefixes = _prefixes(rebuilt)
    ra, rb = _id(F.lit(0).cast("long"), [F.lit(0).cast("long")] * len(LANES))

    shared = prefixes.groupBy("ia", "ib").agg(*[F.min(x).alias(x) for x in ("pa", "pb", "depth", "words")], F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    no_parent = F.lit(None).cast("long")
    root = convs.agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    top = root.select(ra.alias("ia"), rb.alias("ib"), no_parent.alias("pa"), no_parent.alias("pb"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), "conv_id", "n_convs")
    nodes = save(shared.unionByName(top), "nodes")

    below = nodes.where("pa IS NOT NULL").groupBy(F.col("pa").alias("ia"), F.col("pb").alias("ib"))
    children = below.agg(F.count(F.lit(1)).alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("alone"))
    counted = nodes.join(children, ["ia", "ib"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    counted = save(counted.withColumn("leaves", F.coalesce("alone", F.lit(0)) + F.when(F.col("n_children") == 0, 1).otherwise(0)), "nodes-counted")
    several = counted.where("n_convs > 1").withColumn("saved", (F.col("n_convs") - 1) * F.col("words"))
    deepest = several.agg(F.max("depth")).first()[0] or 0
    sums = rollup(several, deepest)

    ends = prefixes.where("last").select("ia", "ib", "c").unionByName(convs.where("size = 0").select(ra.alias("ia"), rb.alias("ib"), "c"))
    parents = nodes.select(F.col("ia").alias("pa"), F.col("ib").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    joined = counted.join(parents, ["pa", "pb"], "left").join(sums, ["ia", "ib"], "left").join(save(_joined_ids(ends), "ends"), ["ia", "ib"], "left")
    return joined.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"),
        F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
