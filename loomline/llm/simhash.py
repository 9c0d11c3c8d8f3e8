"""SimHash near-duplicates found through a Gray-order hierarchical index.

Fingerprints are sorted by Gray rank, so neighbours in the order share long bit patterns. Runs of LEAF
fingerprints are leaves and every FAN nodes of a level have one node above them; a node keeps the bits that everything
below it shares (mask, pattern). A leaf goes down from the top and at each node adds the differences in the bits that
the node shares beyond those of the node above: a whole group goes as soon as their sum exceeds the threshold. Leaves
fix about log2(#leaves) leading bits of the order, so at every level a leaf meets about log2(#leaves)^2 / 2 nodes at
two bits. Levels of at most MAX_TOPS nodes, the bound of what is sent to tasks, are gone through in arrays; each level
below is an equi-join on the node above.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.components import components
from loomline.llm.store import save

LEAF = 64
FAN_BITS = 6
FAN = 1 << FAN_BITS
MAX_TOPS = 16_384
SLICE = 256  # leaves that go down together
_CHUNK = 1 << 15


def shingles(text: str | None, words: int = 3, seed: int = 42):
    """64-bit hashes of a text's word shingles in order, repeats included; a text of fewer words is one shingle."""
    import numpy as np
    import xxhash

    parts = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not parts:
        return np.empty(0, "<u8")
    joined = b" ".join(parts)
    lens = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lens + 1) - 1
    starts = ends - lens
    k = min(words, len(parts))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[x:y], seed) for x, y in zip(starts[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist())], "<u8")


def fingerprint_of(hashes) -> int:
    """64-bit SimHash (unsigned) of shingle hashes; none: zero."""
    import numpy as np

    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        ones += np.unpackbits(hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash (unsigned) of a text's word shingles; no words: zero."""
    return fingerprint_of(shingles(text, words, seed))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """id, fp (the fingerprint as a signed long) of every row; null texts count as empty."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fps)], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(work, "id long, fp long")


def gray_rank(fp: Column) -> Column:
    """Position of fp in the reflected Gray order, as a long whose signed order is that order."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def _leaves(ordered: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        base, n, rest = TaskContext.get().partitionId() << 32, 0, np.empty(0, np.int64)

        def leaves(fps, last):
            nonlocal n
            rows = []
            while len(fps) >= LEAF or last and len(fps):
                x, fps = fps[:LEAF], fps[LEAF:]
                both, some = np.bitwise_and.reduce(x), np.bitwise_or.reduce(x)
                mask = ~(both ^ some)
                rows.append((base + n, int(mask), int(both & mask), x.tobytes()))
                n += 1
            return rows, fps

        names = ["node", "mask", "pattern", "fps"]
        for batch in batches:
            rows, rest = leaves(np.concatenate([rest, batch.column(0).to_numpy()]), False)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], names=names)
        rows, rest = leaves(rest, True)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], names=names)

    return ordered.mapInArrow(work, "node long, mask long, pattern long, fps binary")


def _above(nodes: DataFrame) -> DataFrame:
    """The nodes one level up: node, mask, pattern."""
    shared = F.bit_and("mask").bitwiseAND(F.bitwise_not(F.bit_and("pattern").bitwiseXOR(F.bit_or("pattern"))))
    return nodes.groupBy(F.shiftright("node", FAN_BITS).alias("node")).agg(shared.alias("mask"), F.bit_and("pattern").alias("pattern"))


def _tree(mask, pattern) -> list[tuple]:
    """Levels (mask, pattern) over nodes in Gray order, from at most FAN nodes down to the given ones; the children of
    node i of a level are FAN * i and those after it."""
    import numpy as np

    levels = [(mask, pattern)]
    while len(levels[0][0]) > FAN:
        mask, pattern = levels[0]
        starts = np.arange(0, len(mask), FAN)
        both, some = np.bitwise_and.reduceat(pattern, starts), np.bitwise_or.reduceat(pattern, starts)
        levels.insert(0, (np.bitwise_and.reduceat(mask, starts) & ~(both ^ some), both))
    return levels


def _down(levels: list[tuple], q_mask, q_pattern, max_bits: int) -> tuple:
    """For queries against a tree: place of the query, place of the lowest level's node, and their differences so far,
    of all pairs within max_bits."""
    import numpy as np

    n, width = len(q_mask), len(levels[0][0])
    row, at = np.repeat(np.arange(n), width), np.tile(np.arange(width), n)
    apart, seen = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
    for depth, (mask, pattern) in enumerate(levels):
        if depth:
            first = at * FAN
            number = np.minimum(FAN, len(mask) - first)
            within = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
            row, apart, seen, at = np.repeat(row, number), np.repeat(apart, number), np.repeat(seen, number), np.repeat(first, number) + within
        new = mask[at] & ~seen & q_mask[row]
        apart = apart + np.bitwise_count(((pattern[at] ^ q_pattern[row]) & new).view(np.uint64))
        near = apart <= max_bits
        row, at, apart = row[near], at[near], apart[near]
        seen = mask[at]
    return row, at, apart


def _forest(a, b, pairs) -> tuple[list, list]:
    """A spanning forest of the linked pairs: no more edges than nodes, whatever the number of pairs."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out_a, out_b = [], []
    for i, j in pairs:
        x, y = int(a[i]), int(b[j])
        rx, ry = find(x), find(y)
        if rx != ry:
            root[rx] = ry
            out_a.append(x)
            out_b.append(y)
    return out_a, out_b


def links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """fps: distinct fingerprints in column fp. Returns a, b: links (at most max_bits bits apart) that join the same
    fingerprints as all links do (a spanning forest for each pair of leaves)."""
    spark = fps.sparkSession
    fps = save(fps.select("fp"), "fingerprints")
    n = fps.count()
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / (LEAF * FAN)), MAX_TOPS // 2))
    ordered = fps.withColumn("rank", gray_rank(F.col("fp"))).repartitionByRange(parts, "rank").sortWithinPartitions("rank")
    levels = [save(_leaves(ordered.select("fp")), "leaves")]
    levels.append(save(_above(levels[0]), "level"))
    while levels[-1].count() > MAX_TOPS:  # each level is smaller than the one below, down to one node
        levels.append(save(_above(levels[-1]), "level"))
    tops, depth = levels.pop().orderBy("node").collect(), len(levels)

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        node, mask, pattern = (np.array([r[k] for r in tops], np.int64) for k in ("node", "mask", "pattern"))
        tree = _tree(mask, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                some = batch.slice(start, SLICE)
                leaf, q_mask, q_pattern = (some.column(k).to_numpy() for k in ("node", "mask", "pattern"))
                row, at, apart = _down(tree, q_mask, q_pattern, max_bits)
                later = node[at] >= leaf[row] >> FAN_BITS * depth
                row, at, apart = row[later], at[later], apart[later]
                taken = some.select(["node", "mask", "pattern", "fps"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(mask[at]), pa.array(apart), *taken.columns], names=["above", "seen", "apart", "q", "q_mask", "q_pattern", "q_fps"])

    pairs = levels[0].mapInArrow(descend, "above long, seen long, apart long, q long, q_mask long, q_pattern long, q_fps binary")
    for height in range(depth - 1, -1, -1):
        below = levels[height].withColumn("above", F.shiftright("node", FAN_BITS))
        more = F.bit_count(F.expr("(pattern ^ q_pattern) & mask & ~seen & q_mask"))
        pairs = pairs.join(below, "above").withColumn("apart", F.col("apart") + more)
        pairs = pairs.where((F.col("apart") <= max_bits) & (F.col("node") >= F.shiftright("q", FAN_BITS * height)))
        if height:
            pairs = pairs.select(F.col("node").alias("above"), F.col("mask").alias("seen"), "apart", "q", "q_mask", "q_pattern", "q_fps")
    pairs = pairs.select("q", F.col("node").alias("leaf"), "q_fps", "fps")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            a, b = [], []
            for q, leaf, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
                near = np.bitwise_count((x[:, None] ^ y[None, :]).view(np.uint64)) <= max_bits
                if q == leaf:
                    near = np.triu(near, 1)
                i, j = np.nonzero(near)
                if len(i):
                    more = _forest(x, y, zip(i.tolist(), j.tolist()))
                    a += more[0]
                    b += more[1]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return pairs.mapInArrow(verify, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 2, words: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id that links reach) for every row.

    Null and empty texts have fingerprint zero. Equal fingerprints are one node, so groups of copies cost one row each.
    Rows with a null id keep their fingerprint and get their group's least id, null if it has none. Rows that repeat
    an id are fingerprinted row by row. Other columns are ignored; an empty table gives an empty result.
    """
    rows = save(fingerprints(docs, id_col, text_col, words), "simhash")
    nodes = save(rows.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    found = components(links(nodes, max_bits))
    rooted = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    # stored, so that adaptive execution can split the rows of a fingerprint that many texts have
    groups = save(rooted.select("fp", "root").join(least, "root").select("fp", "component_id"), "fp-groups")
    return rows.join(groups, "fp").select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
