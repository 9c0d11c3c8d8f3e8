"""Line dedup: exact copies by 128-bit hash, near copies by a segment-partition edit join.

Lines of LONG words and more are sequences of words, shorter ones of characters. A line is split into threshold + 1
even segments, so two lines within the threshold (EDITS units inserted, deleted or replaced) share a segment at a
place that their lengths and the segment's number bound (multi-match-aware selection). Lines are filed under (length,
segment number, segment) and probe the substrings that lines of their own or a slightly smaller length could be filed
under. Lines that share a key are near copies if their similarity is MIN_SIMILARITY at least, verified with a banded
bit-parallel edit distance: all pairs within EDITS units are found, and of those with more edits the ones that leave
an even segment in place. Components of the verified links are line classes, and a class keeps its first line (least
doc_id, then line number).

No key's lines are all paired with each other. First every line of a key is held against one of them, in the task that
found the key and then across tasks, so a key costs its size. Only keys whose lines then are in several groups are cut
into blocks, in which lines of different groups are compared.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.components import components
from loomline.llm.grouped import block_pairs, by_run
from loomline.llm.store import save, unused

LONG, EDITS, MIN_SIMILARITY, SHORTEST = 16, 2, 0.8, 4
BLANK = " \t\x0b\f\r"
BLOCK, SEEN, FEW, CHUNK = 256, 300_000, 8, 2_000_000
BASE = 0x5851F42D4C957F2D


def allowed(units: int) -> int:
    """The threshold of the segments when the longer line has so many units."""
    return min(EDITS, int((1 - MIN_SIMILARITY) * units + 1e-9))


def distance(a: Sequence, b: Sequence, most: int) -> int | None:
    """Edit distance of a and b if at most most, else None.

    Bit-parallel over a band: bit r of a column stands for row j - most + r of the table, and the vectors hold where the
    next row is one more (up) or one less (down). Common ends are cut off first.
    """
    if abs(len(a) - len(b)) > most:
        return None
    low, high, stop = 0, 0, min(len(a), len(b))
    while low < stop and a[low] == b[low]:
        low += 1
    while high < stop - low and a[-1 - high] == b[-1 - high]:
        high += 1
    a, b = a[low : len(a) - high], b[low : len(b) - high]
    m, n = len(a), len(b)
    if not m or not n:
        return m + n if m + n <= most else None
    if not most:
        return None
    places: dict = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    width, last = (1 << 2 * most + 1) - 1, 2 * most
    up, down, score = width & ~((1 << most) - 1), 0, min(most, m)
    falls = n - max(0, m - most)  # columns in which the last row may fall
    for j, c in enumerate(b, 1):
        same = places.get(c, 0)
        same = (same >> j - most - 1 if j > most else same << most + 1 - j) & width
        flat = (((same & up) + up ^ up) | same | down) & width
        right, left = down | width & ~(flat | up), flat & up
        if j + most <= m:
            score += not flat >> last & 1
        else:
            row = m - j + most
            score += (right >> row & 1) - (left >> row & 1)
        if score - falls > most:
            return None
        up, down = left | width & ~(flat >> 1 | right), flat >> 1 & right
    return score if score <= most else None


def near(a: str, b: str) -> bool:
    """Whether two different lines have a similarity of MIN_SIMILARITY, in words if both have LONG, else in characters."""
    x, y = a.split(" "), b.split(" ")
    x, y = (x, y) if min(len(x), len(y)) >= LONG else (a, b)
    return distance(x, y, int((1 - MIN_SIMILARITY) * max(len(x), len(y)) + 1e-9)) is not None


def segments(length: int, most: int) -> list[tuple[int, int]]:
    """Start and size of the most + 1 even segments of a line of this length, longer ones last."""
    n, size = most + 1, length // (most + 1)
    sizes = [size + (i >= n - length % n) for i in range(n)]
    return [(sum(sizes[:i]), sizes[i]) for i in range(n)]


def selections(length: int, least: int, words: bool) -> list[tuple[int, int, int, bool]]:
    """Slices of a line of this many units: start, end, seed of the key, and whether it is one of the line's segments.

    A line probes for those of no more units than its own, cut as its own threshold asks, and is filed as every line
    that may probe for it asks.
    """

    def seed(units: int, most: int, i: int) -> int:
        return (units * 8 + most) * 8 + 2 * i + words

    filed = {most for gap in range(EDITS + 1) if (most := allowed(length + gap)) >= max(gap, 1)}
    out = [(at, at + size, seed(length, most, i), True) for most in filed for i, (at, size) in enumerate(segments(length, most))]
    known, most = {x[:3] for x in out}, allowed(length)
    for gap in range(most + 1 if most else 0):
        if length - gap < least:
            break
        for i, (at, size) in enumerate(segments(length - gap, most)):
            low, high = max(at - i, at + gap - (most - i), 0), min(at + i, at + gap + (most - i), length - size)
            out += [(p, p + size, s, False) for p in range(low, high + 1) for s in [seed(length - gap, most, i)] if (p, p + size, s) not in known]
    return out


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    split = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.posexplode(F.split(F.col(text_col).cast("string"), "\n", -1)).alias("n", "line"))
    return split.where(F.trim("line", F.lit(BLANK)) != "").withColumn("ha", F.xxhash64("line")).withColumn("hb", _second(F.col("line")))


def _second(line: Column) -> Column:
    return F.xxhash64(F.lit(1), line)


def _cut_keys(lines: list[str], plan_of, powers):
    """Keys of lines without line breaks: key, the line's number, and whether it is filed under the key.

    A slice's hash is its polynomial in powers, from sums up to each character: no slice is read twice.
    """
    import numpy as np

    code = np.frombuffer("\n".join(lines).encode("utf-32-le"), "<u4")
    up, down = powers(len(code) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((code + np.uint64(1)) * up[: len(code)])])
    breaks = code == 10
    words = np.concatenate([[0], np.flatnonzero(breaks | (code == 32)) + 1, [len(code) + 1]])
    starts = np.concatenate([[0], np.flatnonzero(breaks) + 1])
    sizes = np.diff(np.append(starts, len(code) + 1)) - 1
    first = np.searchsorted(words, starts)
    counts = np.diff(np.append(first, len(words) - 1))
    out: list[tuple] = []
    for in_words, units, some in ((True, counts, counts >= LONG), (False, sizes, counts < LONG + EDITS)):  # with more words, EDITS characters do not lead below LONG
        some = np.flatnonzero(some)
        some = some[np.argsort(units[some], kind="stable")]
        cuts = np.flatnonzero(np.diff(units[some], prepend=-1)).tolist()
        for low, high in zip(cuts, [*cuts[1:], len(some)]):
            at = some[low:high]
            begin, end, seed, own = plan_of(int(units[at[0]]), in_words)
            x, y = (words[first[at, None] + begin], words[first[at, None] + end] - 1) if in_words else (starts[at, None] + begin, starts[at, None] + end)
            key = (sums[y] - sums[x]) * down[x] ^ seed
            key = (key ^ key >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
            key = (key ^ key >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
            out.append(((key ^ key >> np.uint64(31)).ravel(), np.repeat(at, len(own)), np.tile(own, len(at))))
    return [np.concatenate(c) for c in zip(*out)]


def _held(keys, ids, own):
    """A task's rows by key, as numbers of rows: those that go on alone, and the others with their key's one that does.

    The one that goes on is filed under the key if any is. Keys with a few rows of which none is filed go on whole.
    """
    import numpy as np

    order = np.argsort(keys)
    keys, ids, own = keys[order], ids[order], own[order]
    first = np.r_[True, keys[1:] != keys[:-1]][: len(keys)]
    heads = np.flatnonzero(first)
    group = np.cumsum(first) - 1
    filed = np.flatnonzero(own)
    best = heads.copy()
    best[group[filed[::-1]]] = filed[::-1]
    whole = ~np.isin(np.arange(len(heads)), group[filed]) & (np.diff(np.append(heads, len(keys))) <= FEW)
    alone = whole[group]
    alone[best] = True
    rest = np.flatnonzero(~alone)
    rest = rest[ids[rest] != ids[best[group[rest]]]]
    return order[alone], order[rest], order[best[group[rest]]]


def _keys(docs: DataFrame, text_col: str) -> DataFrame:
    """key, a, b, own: for each key and task one line (a; b null), and every other line (b) beside it.

    own tells whether a is filed under the key. Lines are read once a task while they stay among SEEN.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        digest, plans, tables = xxhash.xxh64_intdigest, {}, [np.ones(1, np.uint64)] * 2
        seen: set[int] = set()

        def plan_of(n: int, words: bool):
            if (n, words) not in plans:
                begin, end, seed, own = zip(*selections(n, LONG if words else SHORTEST, words))
                plans[n, words] = np.array(begin), np.array(end), np.array(seed, np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.array(own)
            return plans[n, words]

        def powers(n: int):
            if len(tables[0]) < n:
                tables[:] = [np.cumprod(np.append(np.uint64(1), np.full(n - 1, b, np.uint64))) for b in (BASE, pow(BASE, -1, 1 << 64))]
            return tables

        def flush(parts):
            keys, ids, own = (np.concatenate(c) for c in zip(*parts))
            heads, rest, beside = _held(keys, ids, own)
            at = np.concatenate([heads, beside])
            b = pa.array(np.concatenate([np.zeros(len(heads), np.int64), ids[rest]]), mask=np.arange(len(at)) < len(heads))
            return pa.RecordBatch.from_arrays([pa.array(keys[at].view(np.int64)), pa.array(ids[at]), b, pa.array(own[at])], names=["key", "a", "b", "own"])

        for batch in batches:
            parts: list[tuple] = []
            lines, ids, chars = [], [], 0

            def cut():
                keys, of, own = _cut_keys(lines, plan_of, powers)
                parts.append((keys, np.array(ids, np.uint64).view(np.int64)[of], own))

            if len(seen) > SEEN:
                seen.clear()
            for text in batch.column(0).to_pylist():
                for line in (text or "").split("\n"):
                    if len(line) < SHORTEST or not line.strip(BLANK):
                        continue
                    h = digest(line.encode(), 42)
                    if h not in seen:
                        seen.add(h)
                        lines.append(line)
                        ids.append(h)
                        chars += len(line)
                if chars > CHUNK:
                    cut()
                    lines, ids, chars = [], [], 0
                    if sum(len(p[0]) for p in parts) > 500_000:
                        yield flush(parts)
                        parts = []
            if lines:
                cut()
            if parts:
                yield flush(parts)

    return docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(work, "key long, a long, b long, own boolean")


def _members(keys: DataFrame) -> DataFrame:
    """key, a, b: lines of keys that have several, b beside the key's first line a or beside one of its task's."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        last, centre, filed = None, 0, False  # of the key that the batch before ended with
        for batch in batches:
            k, a, beside, own = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2), batch.column(3).to_numpy(zero_copy_only=False)
            apart = beside.is_null().to_numpy(zero_copy_only=False)
            out = [(k[~apart], a[~apart], beside.fill_null(0).to_numpy()[~apart])]
            k, a, own = k[apart], a[apart], own[apart]
            if len(k):
                at = np.maximum.accumulate(np.where(np.r_[k[0] != last, k[1:] != k[:-1]], np.arange(len(k)), -1))
                of, ok = np.where(at >= 0, a[at], centre), np.where(at >= 0, own[at], filed)
                more = ok & (a != of)
                out.append((k[more], of[more], a[more]))
                last, centre, filed = k[-1], of[-1], ok[-1]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["key", "a", "b"])

    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # rows that have their centre go anywhere; the others meet by key, filed lines first
    dealt = keys.repartition(parts, F.when(F.col("b").isNull(), F.col("key")).otherwise(F.xxhash64("key", "b")))
    ordered = dealt.sortWithinPartitions(F.col("b").isNotNull(), "key", F.col("own").desc(), "a")
    return ordered.mapInArrow(work, "key long, a long, b long")


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs a, b that are near copies."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array([near(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in range(2)], names=["a", "b"])

    x, y = (texts.select(F.col("ha").alias(k), F.col("line").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(work, "a long, b long")


def _mixed(members: DataFrame, links: DataFrame) -> DataFrame:
    """key, id, root of the keys whose lines links leave in several groups."""
    roots = components(links).withColumnRenamed("node", "id")
    rooted = save(members.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "rooted")
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    return save(rooted.join(mixed, "key"), "mixed")


def _pairs(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def links(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """a, b: hashes of near lines, enough of them to join all that all near lines join; ha, hb of the lines tried."""
    stars = save(_members(_keys(docs, text_col)), "stars")
    members = save(stars.select("key", F.explode(F.array("a", "b")).alias("id")).distinct(), "members")
    needed = members.select(F.col("id").alias("ha")).distinct()
    split = docs.select(F.explode(F.split(F.col(text_col).cast("string"), "\n", -1)).alias("line")).where(F.length("line") >= SHORTEST)
    texts = save(split.withColumn("ha", F.xxhash64("line")).join(needed, "ha", "left_semi").groupBy("ha").agg(F.min("line").alias("line")), "texts")
    linked = save(_verify(stars.select(*_pairs("a", "b")).distinct(), texts), "linked")

    left = _mixed(members, linked)
    blocks = block_pairs(left, "key", F.col("id"), BLOCK).join(texts.withColumnRenamed("ha", "id"), "id").select("key", "i", "j", "block", "id", "root", "line")
    return linked.unionByName(by_run(blocks, ["key", "i", "j"], ["id"], _forest, "a long, b long")), texts.select("ha", _second(F.col("line")).alias("hb"))


def _forest(table: pa.Table) -> dict | None:
    """Near lines of two blocks, of those that are in different groups, or get there by a link found before."""
    block, i, j = (table.column(k).to_numpy() for k in ("block", "i", "j"))
    ids, roots, lines = (table.column(k).to_pylist() for k in ("id", "root", "line"))
    left = [k for k in range(len(ids)) if block[k] == i[0]]
    right = left if i[0] == j[0] else [k for k in range(len(ids)) if block[k] == j[0]]
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    a, b = [], []
    for x in left:
        for y in right:
            if (x < y or left is not right) and (p := top(roots[x])) != (q := top(roots[y])) and near(lines[x], lines[y]):
                up[p] = q
                a.append(ids[x])
                b.append(ids[y])
    return {"a": a, "b": b} if a else None


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (line number from 0), ha (its hash), exact (a copy of the class's kept line), keeper_id, keeper_n of
    every line that goes."""
    docs = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_col, text_col = "doc_id", "text"
    lines = _lines(docs, id_col, text_col).select("doc_id", "n", "ha", "hb")
    classes = save(lines.groupBy("ha", "hb").agg(F.min(F.struct("doc_id", "n")).alias("first"), F.count(F.lit(1)).alias("copies")), "classes")
    linked, tried = links(docs, text_col)
    groups = save(components(linked).withColumnRenamed("node", "ha").join(tried, "ha"), "groups")
    grouped = classes.join(groups, ["ha", "hb"])
    keepers = grouped.groupBy("root").agg(F.min("first").alias("keeper"))
    close = grouped.join(keepers, "root").select("ha", "hb", "first", "keeper")
    alone = classes.where("copies > 1").join(groups, ["ha", "hb"], "left_anti").select("ha", "hb", "first", F.col("first").alias("keeper"))
    multi = save(close.unionByName(alone), "multi")
    gone = lines.join(multi, ["ha", "hb"]).where(~F.struct("doc_id", "n").eqNullSafe(F.col("keeper")))
    return gone.select("doc_id", "n", "ha", F.col("first").eqNullSafe(F.col("keeper")).alias("exact"), F.col("keeper.doc_id").alias("keeper_id"), F.col("keeper.n").alias("keeper_n"))


def document_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_exact, n_near, dropped for every row.

    n_lines counts lines that are not blank; n_exact and n_near those that go as copies of the line their class keeps
    and as near copies of it (see the module); dropped lists them as n:keeper_id:keeper_n, in order, comma-joined. Blank lines (white space only) stay.
    Null and empty texts have no lines. Rows with a null id take no part and keep their lines. Rows that repeat an id
    share their lists of lines that go. Other columns are ignored; an empty table gives an empty result.
    """
    each = F.array_sort(F.collect_list(F.struct("n", "exact", "keeper_id", "keeper_n")))
    gone = dropped_lines(docs, id_col, text_col).groupBy(F.col("doc_id").alias("gone_id")).agg(each.alias("each"))
    parts = F.filter(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\n", -1), lambda x: F.trim(x, F.lit(BLANK)) != "")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.size(parts).cast("long").alias("n_lines"))
    got = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")), "left")
    found = F.coalesce("each", F.array().cast("array<struct<n:int,exact:boolean,keeper_id:bigint,keeper_n:int>>"))
    named = F.transform(found, lambda e: F.concat_ws(":", e["n"].cast("string"), e["keeper_id"].cast("string"), e["keeper_n"].cast("string")))
    return got.select(
        "doc_id",
        "n_lines",
        F.size(F.filter(found, lambda e: e["exact"])).cast("long").alias("n_exact"),
        F.size(F.filter(found, lambda e: ~e["exact"])).cast("long").alias("n_near"),
        F.array_join(named, ",").alias("dropped"),
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with the lines that go taken out of its text; a document that loses every line keeps an empty text.

    Null texts and rows with a null id stay as they are. Of rows that repeat an id, each loses its own lines that go.
    """
    gone_id, at = unused(docs, "gone_id", "gone")
    gone = dropped_lines(docs, id_col, text_col).groupBy(F.col("doc_id").alias(gone_id)).agg(F.collect_set(F.struct(F.col("n").alias("n"), F.col("ha").alias("ha"))).alias(at))
    joined = docs.join(gone, F.col(id_col).cast("long") == F.col(gone_id), "left")

    def rest(parts: Column) -> Column:
        own = F.transform(parts, lambda x, i: F.struct(i.alias("n"), F.xxhash64(x).alias("ha")))
        return F.array_join(F.transform(F.array_except(own, F.col(at)), lambda k: F.get(parts, k["n"])), "\n")

    text = F.get(F.transform(F.array(F.split(F.col(text_col).cast("string"), "\n", -1)), rest), F.lit(0))
    return joined.withColumn(text_col, F.when(F.col(at).isNull(), F.col(text_col)).otherwise(text)).select(*docs.columns)
