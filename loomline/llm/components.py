"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before the shuffle) and an equi-join; nothing is gathered per
component, so one component may hold any share of the nodes, and a node's edges may be spread over tasks. Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.store import save

ROWS = 150_000  # edges in a file at most, about
SALTS = 4


def _with_least(edges: DataFrame, least: DataFrame, key: str, other: str) -> DataFrame:
    """edges with the least of its key (least: key, m). A hub's edges are dealt by salt; as the salt also asks for a
    shuffle of least after its grouping, adaptive execution can split a hub further."""
    salted = least.withColumn("salt", F.explode(F.array(*[F.lit(n) for n in range(SALTS)])))
    return edges.withColumn("salt", F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int")).join(salted, [key, "salt"]).drop("salt")


def _print(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return tuple(row)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """links: pairs of longs, in any order, repeats and loops allowed. Returns node, root (its component's least node).

    Only nodes with a link to another node appear. Null ends are ignored; no links give no rows.
    """
    ends = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    edges = save(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = _print(edges)
    while before[0]:
        files = before[0] // ROWS + 1
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = _with_least(both.where("v > u"), least, "u", "v").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _with_least(large, least, "a", "b").select(
            F.explode(
                F.array(
                    F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
                    F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                )
            ).alias("e")
        )
        edges = save(small.select("e.*").where("a <> b").distinct(), "stars", files)
        after = _print(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
