"""Near copies by the exact Jaccard similarity of their word shingles.

Candidates come from two indexes. The SimHash links of the Gray-order index tie close copies cheaply but miss most
pairs at a similarity of 0.8, which differ in more bits than any threshold at which the index still prunes. The
shingle index misses none: with all sets in one order, sets of similarity 0.8 share SHARED of their first
n // 5 + SHARED shingles, or all that they share if that is less (prefix filter). Rare shingles come first in that order, so texts that share only common passages do not
meet. Each shared shingle first ties its documents to one of them; only documents that are not in one group by then
meet pairwise, so a large group of copies costs its size and not its square. Every candidate is verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm import simhash
from loomline.llm.components import components
from loomline.llm.store import save, unused

WORDS = 5
#: Documents and shingles that set the order of shingles. Any order gives the same result.
SAMPLE, COMMON = 20_000, 100_000
#: Shingles that a pair must share in both prefixes; a greater number makes longer prefixes and fewer candidates.
SHARED = 8


def shingle_set(text: str | None, words: int = WORDS):
    """Sorted different shingle hashes; a text without words has the one shingle zero."""
    import numpy as np

    found = np.unique(simhash.shingles(text, words))
    return found if len(found) else np.zeros(1, "<u8")


def similar(n_a: int, n_b: int, both: int) -> bool:
    """Whether sets of these sizes that share so many elements have a Jaccard similarity of at least 0.8."""
    return 9 * both >= 4 * (n_a + n_b)


def _common(docs: DataFrame, words: int):
    """Shingles that occur in several documents of a sample, sorted, and their counts."""
    import numpy as np

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), words) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64) if sets else [], pa.int64())], names=["key"])

    step = max(1, docs.count() // SAMPLE)
    some = docs.where(F.pmod(F.xxhash64("id"), F.lit(step)) == 0).select("t").mapInArrow(work, "key long")
    often = some.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 2").orderBy(F.desc("n"), "key").limit(COMMON).toArrow()
    keys, counts = often.column("key").to_numpy().view(np.uint64), often.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], counts[order]


def _rows(docs: DataFrame, words: int) -> DataFrame:
    """id, ta, tb (the text's digest), da, db (the set's digest), n (its size), fp (the SimHash), keys (the set's first
    shingles) of every row."""
    common, counts = _common(docs, words)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        for batch in batches:
            da, db, sizes, fps, keys = [], [], [], [], []
            for t in batch.column(1):
                hashes = simhash.shingles(t.as_py(), words)
                found = np.unique(hashes) if len(hashes) else np.zeros(1, "<u8")
                weight = np.zeros(len(found), np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, found), len(common) - 1)
                    weight = np.where(common[at] == found, counts[at], 0)
                raw = found.tobytes()
                da.append(xxhash.xxh64_intdigest(raw, 1))
                db.append(xxhash.xxh64_intdigest(raw, 2))
                sizes.append(len(found))
                fps.append(simhash.fingerprint_of(hashes))
                keys.append(found[np.lexsort((found, weight))[: len(found) // 5 + SHARED]].view(np.int64))
            as_long = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
            columns = [batch.column(0), batch.column(2), batch.column(3), as_long(da), as_long(db), pa.array(sizes, pa.int64()), as_long(fps), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "ta", "tb", "da", "db", "n", "fp", "keys"])

    return docs.mapInArrow(work, "id long, ta long, tb long, da long, db long, n long, fp long, keys array<long>")


def _verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """The pairs a, b of nodes whose sets are similar."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t.as_py(), words).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["node", "s"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            near = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                near.append(similar(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))))
            keep = pa.array(near, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    needed = save(nodes.select("node", "id", "ta", "tb").join(wanted, "node"), "needed")  # if small, docs stay in place
    texts = save(docs.join(needed, ["id", "ta", "tb"]).select("node", "t").mapInArrow(sets, "node long, s binary"), "sets")
    left, right = texts.toDF("a", "x"), texts.toDF("b", "y")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(work, "a long, b long")


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _digests(text: Column) -> list[Column]:
    return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """id, ta, tb (the text's digest), component_id (the least id that verified pairs reach) for every row whose id is
    not null. Null and empty texts are copies of each other; rows that repeat an id are compared text by text."""
    text = F.col(text_col).cast("string")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("t"), *[d.alias(k) for d, k in zip(_digests(text), ("ta", "tb"))]).where("id is not null")
    rows = save(_rows(docs, words), "shingled")
    least = rows.groupBy("da", "db").agg(F.min(F.struct("id", "ta", "tb", "n", "fp", "keys")).alias("e"))
    nodes = save(least.select(F.monotonically_increasing_id().alias("node"), "da", "db", "e.*"), "nodes")

    same = nodes.groupBy("fp").agg(F.min("node").alias("head"))
    close = simhash.links(same.select("fp"))
    heads = [same.select(F.col("fp").alias(k), F.col("head").alias(f"h{k}")) for k in "ab"]
    near_bits = close.join(heads[0], "a").join(heads[1], "b").select(*_ordered("ha", "hb"))
    equal_bits = nodes.join(same, "fp").select(*_ordered("head", "node"))

    index = nodes.select("node", "n", F.explode("keys").alias("key"))
    of_key = Window.partitionBy("key")
    counted = index.withColumn("first", F.min(F.struct("node", "n")).over(of_key)).withColumn("c", F.count(F.lit(1)).over(of_key))
    shared = save(counted.where("c > 1").drop("c"), "shared")
    close_size = "5 * least({0}, {1}) >= 4 * greatest({0}, {1})".format
    enough = F.col("count") >= F.least(F.lit(SHARED), F.ceil(F.col("larger") * 4 / 5))
    stars = shared.where(close_size("n", "first.n")).where("node <> first.node").groupBy(*_ordered("first.node", "node"), F.greatest("n", "first.n").alias("larger")).count()
    stars = stars.where(enough).select("a", "b")
    tried = save(near_bits.unionByName(equal_bits).unionByName(stars).where("a <> b").distinct(), "tried")
    linked = save(_verify(tried, nodes, docs, words), "linked")
    tied = save(components(linked), "tied")

    rooted = shared.select("key", "node", "n").join(tied, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = save(rooted, "rooted")
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.mode("root").alias("most")).where("low <> high")
    met = save(rooted.join(mixed.select("key", "most"), "key"), "met")
    outside = met.where("root <> most").select("key", *(F.col(k).alias(f"o_{k}") for k in ("node", "n", "root")))
    apart = (F.col("root") != F.col("o_root")) & F.expr(close_size("n", "o_n")) & ((F.col("root") == F.col("most")) | (F.col("o_node") < F.col("node")))
    more = outside.join(met, "key").where(apart).groupBy(*_ordered("o_node", "node"), F.greatest("o_n", "n").alias("larger")).count()
    more = save(more.where(enough).select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "more")
    all_links = linked.unionByName(_verify(more, nodes, docs, words))

    rooted = nodes.join(components(all_links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    named = save(rooted.select("da", "db", "root").join(least, "root").select("da", "db", "component_id"), "named")
    return rows.select("id", "ta", "tb", "da", "db").join(named, ["da", "db"]).select("id", "ta", "tb", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """docs without the rows whose group of near copies has a smaller id.

    Rows with a null id stay. Of rows that repeat an id, each is judged by its own text, so no group of texts goes
    whole; rows that repeat id and text stay or go together. Other columns are kept; an empty table gives an empty one.
    """
    keys = dict(zip(("id", "ta", "tb"), unused(docs, "gone_id", "gone_ta", "gone_tb")))
    gone = groups(docs, id_col, text_col, words).where("id <> component_id").select(*(F.col(k).alias(n) for k, n in keys.items())).distinct()
    ta, tb = _digests(F.col(text_col).cast("string"))
    same = (F.col(id_col).cast("long") == F.col(keys["id"])) & (ta == F.col(keys["ta"])) & (tb == F.col(keys["tb"]))
    return docs.join(gone, same, "left_anti")
