"""Packing of tokenised documents into sequences by a configuration linear program.

Documents are tokenised once; those longer than a sequence are cut. Piece lengths form a histogram with one entry for
each length below the limit, so the plan is made from at most limit - 1 numbers whatever the corpus size:
multiplicative weights solve the covering program over configurations (multisets of lengths that fit a sequence) with
knapsack dynamic programming as the pricing step, the fractional solution is rounded down to the supply, again on
what is left, and the rest, too thin for whole configurations, is filled best-fit. Every piece then finds its
sequence by its ordinal within its length, a sorted lookup in the plan: no task sees more than its own rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.store import save

LIMIT = 2048
ROUNDS, STEPS, COLUMNS, RATE, SLACK = 3, 40, 128, 0.5, 0.002
LEANS = (0.0, 0.5, 0.9)
WORDS_KEPT, CHUNK = 500_000, 8_000_000  # words known, bytes of text encoded at once


#: Pieces that split into words by character class alone: ASCII without the apostrophe, and Latin letters that neither
#: composition nor lower-casing takes out of the class; then their words, lower-cased.
PLAIN = "^[!-&(-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]*$"
WORD = "([a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|[!-&(-/:-@\\[-`{-~]+)"


def _take(flat, bounds, picked, groups):
    """Lists (flat, cut at bounds) picked by number and joined where groups cuts the picked ones: flat and bounds."""
    import numpy as np

    n = np.diff(bounds)[picked]
    ends = np.concatenate([[0], np.cumsum(n)])
    return flat[np.repeat(bounds[picked] - ends[:-1], n) + np.arange(ends[-1])], ends[groups]


def encoder(path: str, kept: int = WORDS_KEPT):
    """A function from an Arrow array of texts to all their ids and the bounds of each text's, by the tokenizer file.

    No token of this vocabulary spans ASCII white space, so texts are cut there and each different piece is encoded
    once. Plain pieces are cut into lower-cased words, the unit of the merges; different words are encoded many to a
    call, told apart by the tokens that end a word, and known while they stay among the kept ones. Other pieces, and
    those with an added token's text in them, go through the whole tokenizer.
    """
    import numpy as np
    import pyarrow.compute as pc
    from tokenizers import Tokenizer, pre_tokenizers

    whole = Tokenizer.from_file(path)
    added = [token.content for token in whole.get_added_tokens_decoder().values()]
    bare = Tokenizer(whole.model)  # the merges alone
    bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    vocabulary = whole.get_vocab()
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
    words: dict[str, bytes] = {"": b""}

    def single(text: str) -> bytes:
        return np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(new: list[str]) -> None:
        groups = [new[i : i + 64] for i in range(0, len(new), 64)]
        for at in range(0, len(groups), 64):
            part = groups[at : at + 64]
            for group, got in zip(part, bare.encode_batch_fast([" ".join(g) for g in part], add_special_tokens=False)):
                ids = np.array(got.ids, "<u4")
                stops = (np.flatnonzero(ends[ids]) + 1).tolist()
                if len(stops) == len(group):
                    raw = ids.tobytes()
                    words.update((w, raw[4 * x : 4 * y]) for w, x, y in zip(group, [0, *stops], stops))
                else:
                    words.update((w, single(w)) for w in group)

    def joined(parts: list[bytes]):
        bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) // 4)])
        return np.frombuffer(b"".join(parts), "<u4"), bounds

    def split(found: pa.ListArray) -> tuple[pa.Array, Any, Any]:
        """The different items of lists, each item's number among them, and the lists' bounds."""
        coded = found.flatten().dictionary_encode()
        return coded.dictionary, coded.indices.to_numpy(), found.offsets.to_numpy() - found.offsets[0].as_py()

    def encode(texts: pa.Array):
        pieces, piece, of_text = split(pc.ascii_split_whitespace(texts))
        plain = pc.match_substring_regex(pieces, PLAIN)
        for token in added:
            plain = pc.and_not(plain, pc.match_substring(pieces, token))
        spaced = pc.replace_substring_regex(pc.utf8_lower(pieces.filter(plain)), WORD, "\\1 ")
        found, word, of_piece = split(pc.split_pattern(spaced, " "))
        found = found.to_numpy(zero_copy_only=False).tolist()
        if len(words) > kept:
            words.clear()
            words[""] = b""
        learn([w for w in found if w not in words])
        flat, bounds = _take(*joined([words[w] for w in found]), word, of_piece)
        other, other_bounds = joined([single(p) for p in pieces.filter(pc.invert(plain)).to_pylist()])
        mask = plain.to_numpy(zero_copy_only=False)
        number = np.where(mask, np.cumsum(mask) - 1, mask.sum() + np.cumsum(~mask) - 1)
        return _take(np.concatenate([flat, other]), np.concatenate([bounds, bounds[-1] + other_bounds[1:]]), number[piece], of_text)

    return encode


def pieces(docs: DataFrame, path: str, limit: int = LIMIT, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and the end id, cut after every limit ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import zlib

        import numpy as np
        import pyarrow.compute as pc

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, end = encoder(path), end_id.to_bytes(4, "little")
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            chunk = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64)) // CHUNK
            cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(texts)] if len(texts) else []
            for low, high in zip(cuts, cuts[1:]):
                out: list[list] = [[], [], [], [], []]
                flat, bounds = encode(texts.slice(low, high - low))
                for doc, x, y in zip(batch.column(0).slice(low, high - low).to_pylist(), bounds.tolist(), bounds[1:].tolist()):
                    ids = flat[x:y].tobytes() + end
                    for n, at in enumerate(range(0, len(ids), 4 * limit)):
                        part = ids[at : at + 4 * limit]
                        for column, value in zip(out, (doc, n, at // 4, len(part) // 4, zlib.crc32(part))):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        work, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def _knapsack(prices, sizes, limit: int):
    """Best value of the lengths with these prices for each capacity, and the last length put in (0: none)."""
    import numpy as np

    best, last = np.zeros(limit + 1), np.zeros(limit + 1, np.int64)
    for room in range(1, limit + 1):
        n = np.searchsorted(sizes, room, side="right")
        best[room], last[room] = best[room - 1], 0
        if n:
            value = best[room - sizes[:n]] + prices[:n]
            at = int(value.argmax())
            if value[at] > best[room]:
                best[room], last[room] = value[at], sizes[at]
    return best, last


def _contents(first: int, last, limit: int) -> tuple[int, ...]:
    """The configuration that holds first and, in the rest, what the knapsack found."""
    out, room = [first], limit - first
    while room > 0:
        if last[room]:
            out.append(int(last[room]))
            room -= int(last[room])
        else:
            room -= 1
    return tuple(sorted(out, reverse=True))


def fractional(counts: dict[int, int], limit: int, lean: float, steps: int = STEPS, columns: int = COLUMNS) -> list[tuple[tuple[int, ...], float, float]]:
    """A fractional cover of the histogram: configurations, how much of each, and their worth when chosen (1: best).

    Prices start between a length's share of the limit (lean 0) and the dual of the program in which only lengths
    over half the limit count (lean 1). Covering a length discounts its price by a factor that falls with the share
    covered; each step prices all configurations with one knapsack and takes those near the best by a part of what
    their scarcest length allows.
    """
    import numpy as np

    sizes = np.array(sorted(counts), np.int64)
    supply = np.array([counts[s] for s in sizes.tolist()], np.float64)
    place = {s: k for k, s in enumerate(sizes.tolist())}
    start = (1 - lean) * sizes / limit + lean * ((2 * sizes > limit) + 0.5 * (2 * sizes == limit))
    start = start * (1 + 0.02 * sizes / limit)  # of equal configurations, the one of fewer and longer pieces
    covered, x = np.zeros(len(sizes)), {}
    for _ in range(steps):
        prices = start * np.exp(-RATE * covered) * (covered < 1.0)
        best, last = _knapsack(prices, sizes, limit)
        worth = prices + best[limit - sizes]
        order = np.argsort(-worth, kind="stable")[:columns]
        taken = 0
        for k in order[worth[order] >= 0.98 * worth[order[0]]].tolist():
            config = _contents(int(sizes[k]), last, limit)
            used, times = np.unique([place[s] for s in config], return_counts=True)
            step = float((supply[used] * np.maximum(0.0, 1.0 - covered[used]) / times).min())
            step = step if step <= 2 else 0.5 * step
            if step <= 0:
                continue
            held = x.setdefault(config, [0.0, float(worth[k])])
            held[0] += step
            covered[used] += step * times / supply[used]
            taken += 1
        if not taken or covered.min() >= 1.0:
            break
    return [(c, amount, w) for c, (amount, w) in x.items()]


def best_fit(counts: dict[int, int], limit: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: groups of equal sequences are filled together."""
    rooms: dict[int, list] = {}  # free room -> [contents, number of sequences]
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            room = min((r for r in rooms if r >= size), default=None)
            if room is None:
                each = limit // size
                whole, rest = divmod(left, each)
                for contents, n in (((size,) * each, whole), ((size,) * rest, 1 if rest else 0)):
                    if n:
                        rooms.setdefault(limit - sum(contents), []).append([contents, n])
                left = 0
                continue
            group = rooms[room][-1]
            fits = room // size
            n = min(group[1], left // fits)
            if not n:  # fewer left than one sequence takes
                fits, n = left, 1
            group[1] -= n
            if not group[1]:
                rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
            rooms.setdefault(room - fits * size, []).append([group[0] + (size,) * fits, n])
            left -= fits * n
    return [(contents, n) for groups in rooms.values() for contents, n in groups]


def _rounded(counts: dict[int, int], limit: int, lean: float) -> list[tuple[tuple[int, ...], int]]:
    left, chosen = dict(counts), []
    for _ in range(ROUNDS):
        took = 0
        for config, amount, _ in fractional(left, limit, lean) if left else []:
            if limit - sum(config) > limit * SLACK:
                continue
            need = {s: config.count(s) for s in set(config)}
            n = min(int(amount + 0.5), *(left.get(s, 0) // k for s, k in need.items()))
            if n > 0:
                chosen.append((config, n))
                took += n
                for s, k in need.items():
                    left[s] -= n * k
                    if not left[s]:
                        del left[s]
        if took < 0.02 * sum(counts.values()) / 4:
            break
    return chosen + best_fit(left, limit)


def plan(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[tuple[int, ...], int]]:
    """Configurations and how many sequences take each; together they hold exactly the pieces counted."""
    counts = {s: n for s, n in counts.items() if n}
    tried = [_rounded(counts, limit, lean) for lean in LEANS]
    return min(tried, key=lambda c: sum(n for _, n in c))


def _slots(chosen: list[tuple[tuple[int, ...], int]]):
    """Arrays by length and ordinal: where each run of ordinals begins, its first sequence, how many of the length a
    sequence takes, and the offset of the first of them."""
    import numpy as np

    rows, base, used = [], 0, {}
    for config, n in chosen:
        at = 0
        for size in sorted(set(config), reverse=True):
            each = config.count(size)
            rows.append((size, used.get(size, 0), base, each, at))
            used[size] = used.get(size, 0) + each * n
            at += each * size
        base += n
    rows.sort()
    return base, np.array(rows, np.int64).reshape(-1, 5)


def pack(docs: DataFrame, path: str, limit: int = LIMIT, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document.

    Null texts are empty: the end id alone. Only documents over limit ids are cut. Rows with a null or repeated id
    are packed like others, row by row. Sequences are numbered from 0 without gaps and each is filled from offset 0
    without gaps. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    cut = save(pieces(docs, path, limit, end_id, id_col, text_col), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    full = counts.pop(limit, 0)
    base, table = _slots(plan(counts, limit) + ([((limit,), full)] if full else []))
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (sum(counts.values()) + full) // 50_000)
    spread = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)).cast("int"))
    held = spread.groupBy("length", "shard").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("length", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "shard").orderBy("doc_id", "piece", "ids_crc32", "start")
    numbered = spread.withColumn("n", F.row_number().over(within) - 1).join(held, ["length", "shard"])
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("n") + F.col("before")).alias("ordinal"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        starts = (table[:, 0] << 48) + table[:, 1]
        for batch in batches:
            length, ordinal = batch.column("length").to_numpy(), batch.column("ordinal").to_numpy()
            row = table[np.searchsorted(starts, (length << 48) + ordinal, side="right") - 1] if batch.num_rows else table[:0]
            at = ordinal - row[:, 1]
            columns = [*batch.columns[:5], pa.array(row[:, 2] + at // row[:, 3]), pa.array(row[:, 4] + at % row[:, 3] * length)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return numbered.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
