"""Merkle manifest of a table: one tree a group, one tree over the groups' roots, and every row's proof.

A row's place in its group comes from range-sorted partitions, never from one sorted group. Aligned blocks of BLOCK
rows travel as one row each: a contiguous matrix of 64-byte hex digests. A block's levels are the matrix reshaped by
FANOUT and hashed row by row; the blocks' roots are the next round's leaves, so a round takes LEVELS levels and rounds
grow with the logarithm of the largest group. Proofs come back down the same blocks: each block's path to the root is
joined to the block, and index arithmetic finds every row's siblings on each level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.grouped import by_run
from loomline.llm.runsum import running
from loomline.llm.store import save

FANOUT, LEVELS = 8, 3
BLOCK = FANOUT**LEVELS
HEX = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def height(n: int) -> int:
    """Levels above n leaves."""
    up = 0
    while n > 1:
        n, up = -(-n // FANOUT), up + 1
    return up


def levels(nodes: bytes, up: int) -> list[bytes]:
    """The digests of each of up levels and, last, of the level above them, each contiguous."""
    import numpy as np

    out = [nodes]
    for _ in range(up):
        count = len(out[-1]) // HEX
        whole = count // FANOUT
        runs = [row.tobytes() for row in np.frombuffer(out[-1], np.uint8, whole * FANOUT * HEX).reshape(whole, FANOUT * HEX)]
        if count % FANOUT:
            runs.append(out[-1][whole * FANOUT * HEX :])
        out.append("".join(hashlib.sha256(run).hexdigest() for run in runs).encode())
    return out


def siblings(level: bytes, i: int) -> tuple[bytes, bytes]:
    """The digests left and right of node i in its run."""
    at, low = i * HEX, i // FANOUT * FANOUT * HEX
    return level[low:at], level[at + HEX : low + FANOUT * HEX]


def fold(node: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The digest that node and its siblings on each level lead to."""
    for left, right in path:
        node = hashlib.sha256(left + node + right).hexdigest().encode()
    return node


def _size(n: int) -> int:
    return min(LEVELS, height(n))


def _blocks(rows: DataFrame) -> DataFrame:
    """k, n, block, ids, nodes, others of rows (k, n, pos, id, node, other): every BLOCK rows of a group as one."""

    def pack(table: pa.Table) -> dict:
        k, n, block = (table.column(c)[0].as_py() for c in ("k", "n", "block"))
        nodes, others = ("".join(table.column(c).to_pylist()).encode() for c in ("node", "other"))
        return {"k": [k], "n": [n], "block": [block], "ids": [table.column("id").to_pylist()], "nodes": [nodes], "others": [others]}

    kind = rows.schema["id"].dataType.simpleString()
    cut = rows.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("long")).select("k", "n", "block", "pos", "id", "node", "other")
    return by_run(cut, ["k", "block"], ["pos"], pack, f"k string, n long, block long, ids array<{kind}>, nodes binary, others binary")


def _roots(blocks: DataFrame) -> DataFrame:
    """The blocks' roots as the next round's rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = [levels(x, _size(n))[-1].decode() for n, x in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist())]
            n = [-(-x // BLOCK) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), batch.column(2), pa.array(node, pa.string())], names=["k", "n", "pos", "node"])

    got = blocks.select("k", "n", "block", "nodes").mapInArrow(work, "k string, n long, pos long, node string")
    return got.select("k", "n", "pos", F.lit(None).cast("long").alias("id"), "node", F.col("node").alias("other"))


def _down(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """k, pos, lefts, rights, root: every node's siblings from its own level to the root; above has its block's."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tree = levels(row["nodes"], _size(row["n"]))[:-1]
                count = len(row["nodes"]) // HEX
                paths = [[siblings(level, i // FANOUT**up) for up, level in enumerate(tree)] for i in range(count)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "k": [row["k"]] * count,
                        "pos": [row["block"] * BLOCK + i for i in range(count)],
                        "lefts": [[a for a, _ in p] + row["lefts"] for p in paths],
                        "rights": [[b for _, b in p] + row["rights"] for p in paths],
                        "root": [row["root"]] * count,
                    },
                    schema=pa.schema([("k", pa.string()), ("pos", pa.int64()), ("lefts", pa.list_(pa.binary())), ("rights", pa.list_(pa.binary())), ("root", pa.string())]),
                )

    joined = blocks.join(above.withColumnRenamed("pos", "block"), ["k", "block"]).select("k", "n", "block", "nodes", "lefts", "rights", "root")
    return joined.mapInArrow(work, "k string, pos long, lefts array<binary>, rights array<binary>, root string")


def _tree(rows: DataFrame, most: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The block tables of each round, lowest first, and the groups' roots (k, node), of rows (k, n, pos, id, node, other)."""
    rounds = []
    while True:
        rounds.append(save(_blocks(rows), f"{name}-blocks"))
        rows = _roots(rounds[-1])
        if most <= BLOCK:
            return rounds, save(rows.select("k", "node"), f"{name}-roots")
        rows, most = save(rows, f"{name}-nodes"), -(-most // BLOCK)


def _paths(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """The paths of the blocks of the lowest round; above has those of the groups' roots (k, pos 0)."""
    for blocks in rounds[:0:-1]:
        above = save(_down(blocks, above), "paths")
    return above


def _ranked(rows: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int]:
    """rows with pos, their place in their group k, and n, the group's rows; and the largest group's rows."""
    placed = running(rows.withColumn("pos", F.lit(1).cast("long")), ["k"], order, ["pos"], name).withColumn("pos", F.col("pos") - 1)
    sizes = save(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")), f"{name}-sizes")
    return placed.join(sizes, "k"), sizes.agg(F.max("n")).first()[0] or 0


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def manifest(docs: DataFrame, id_col: str = "doc_id", fields: tuple[str, ...] = ("source", "lang", "n_chars", "text"), group_col: str = "lang", text_col: str = "text") -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    A leaf is the SHA-256 of the id and fields, each as its UTF-8 length, a colon and its value, or - for null. Each
    group (of equal group_col, null being one) is a tree of its leaves by id, null ids first; rows that repeat an id follow
    their leaf, and equal rows have equal leaves, so any order of them is the same. Groups are ordered null first, then by
    bytes. proof_sha256 digests a row's siblings from its own run up to the root. Every third id by crc32 (never a null
    one) is tampered with, by lower-casing A-Z in the text, and folded_root is what its proof then leads to; verified
    tells whether that is the root. Null fields, empty and very long texts count as any value; other columns are ignored;
    an empty table gives an empty result.
    """
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")

    def leaf(changed: Column | None = None) -> Column:
        parts = [_field(changed if changed is not None and f == text_col else F.col(f)) for f in fields]
        return F.sha2(F.concat(_field(doc_id), *parts), 256)

    group = F.col(group_col).cast("string")
    tampered = F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 0, F.lit(False))
    own = docs.select(
        F.coalesce(F.concat(F.lit("="), group), F.lit("-")).alias("k"),  # null before any value
        doc_id.alias("id"),
        leaf().alias("node"),
        F.when(tampered, leaf(F.translate(text, UPPER, LOWER))).alias("other"),
        F.monotonically_increasing_id().alias("tie"),
    )
    leaves = save(own.withColumn("other", F.coalesce("other", "node")), "leaves")
    ranked, most = _ranked(leaves, ["id", "node", "tie"], "ranked")
    rounds, subroots = _tree(ranked, most, "group")

    groups, n_groups = _ranked(save(subroots.select(F.lit("").alias("k"), F.col("k").alias("id"), "node", F.col("node").alias("other")), "subroots"), ["id"], "groups")
    top, roots = _tree(groups, n_groups, "top")
    none = F.array().cast("array<binary>")
    start = roots.select("k", F.lit(0).cast("long").alias("pos"), none.alias("lefts"), none.alias("rights"), F.col("node").alias("root"))
    names = groups.select("pos", F.col("id").alias("name"), "node")
    down = _down(top[0], _paths(top, start)).join(names, "pos")
    above = save(down.select(F.col("name").alias("k"), F.lit(0).cast("long").alias("pos"), "lefts", "rights", "root"), "groups-up")

    return _proofs(rounds[0], _paths(rounds, above), subroots)


def _proofs(blocks: DataFrame, above: DataFrame, subroots: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tree = levels(row["nodes"], _size(row["n"]))[:-1]
                up = list(zip(row["lefts"], row["rights"]))
                rest, folded = b"".join(a + b for a, b in up), {}
                out: dict[str, list] = {"doc_id": row["ids"], "leaf": [], "proof_sha256": [], "folded_root": []}
                for i in range(len(row["ids"])):
                    path = [siblings(level, i // FANOUT**u) for u, level in enumerate(tree)]
                    proof = hashlib.sha256(b"".join(a + b for a, b in path))
                    proof.update(rest)
                    top = fold(row["others"][i * HEX : (i + 1) * HEX], path)
                    if top not in folded:
                        folded[top] = fold(top, up).decode()
                    out["leaf"].append(row["nodes"][i * HEX : (i + 1) * HEX].decode())
                    out["proof_sha256"].append(proof.hexdigest())
                    out["folded_root"].append(folded[top])
                for name in ("subroot", "root"):
                    out[name] = [row[name]] * len(row["ids"])
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64())] + [(c, pa.string()) for c in list(out)[1:]]))

    joined = blocks.join(above.withColumnRenamed("pos", "block"), ["k", "block"]).join(subroots.withColumnRenamed("node", "subroot"), "k")
    rows = joined.select("n", "ids", "nodes", "others", "lefts", "rights", "subroot", "root")
    got = rows.mapInArrow(work, "doc_id long, leaf string, proof_sha256 string, folded_root string, subroot string, root string")
    return got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
