"""Byte-level BPE by corpus-level merge replay.

The words of a part of the corpus (a task's documents) form one long sequence of symbols. An inverted index maps each
merge rank to the positions of its pair; ranks are replayed in order, each merge touches only its two neighbours and
files the pairs that it makes. Every different word is replayed once while it stays among the kept ones. Words are
independent, so parts need no exchange: the operator is one narrow stage whatever the corpus size.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEPT = 300_000
GROUP = 100_000
DOCS = 1024
MANY = 48


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge_table(ranks: dict[bytes, int]) -> dict[int, int]:
    """The rank that each pair of tokens merges to, by left << 20 | right: every token's splits into two tokens."""
    out = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            left, right = ranks.get(token[:i]), ranks.get(token[i:])
            if left is not None and right is not None:
                out[left << 20 | right] = rank
    return out


class Merges(NamedTuple):
    """A rank file's merges: of(pair) by left << 20 | right, the pairs that make each rank, and those of two bytes."""

    of: dict[int, int]
    pairs: dict[int, list[int]]
    byte_ids: Any  # id of each byte; at 256, which ends a word, -1
    first: Any  # rank of each pair of bytes, -1 if they don't merge


def merges_of(ranks: dict[bytes, int]) -> Merges:
    import numpy as np

    of, pairs = merge_table(ranks), {}
    for pair, rank in of.items():
        pairs.setdefault(rank, []).append(pair)
    byte_ids = [ranks[bytes([b])] for b in range(256)]
    first = np.full((257, 257), -1, np.int64)
    first[:256, :256] = [[of.get(x << 20 | y, -1) for y in byte_ids] for x in byte_ids]
    return Merges(of, pairs, np.array([*byte_ids, -1], np.int64), first)


def replay(words: list[bytes], merges: Merges) -> list[bytes]:
    """The ids of each word (little-endian 32-bit): all merges of all words in rank order, leftmost first in a word.

    A rank with many positions is applied to them all at once, unless its occurrences overlap or make a pair that goes
    before it; those and ranks with few positions are applied one position at a time.
    """
    import heapq
    from array import array

    import numpy as np

    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    raw = np.full(int(lens.sum()) + len(words), 256, np.int64)
    inner = np.ones(len(raw), bool)
    inner[ends] = False
    raw[inner] = np.frombuffer(b"".join(words), np.uint8)
    found = merges.first[raw[:-1], raw[1:]]
    places = np.flatnonzero(found >= 0)
    order = np.argsort(found[places], kind="stable")
    places, keys = places[order], found[places][order]
    cuts = np.flatnonzero(np.diff(keys, prepend=-1)).tolist()
    index: dict[int, list[int]] = {
        int(keys[x]): places[x:y].tolist() for x, y in zip(cuts, [*cuts[1:], len(keys)])
    }
    # symbol: -1 where a word ends or a symbol was merged away; each array has a view for work on many positions
    symbol, after, before = (array("q", x.tobytes()) for x in (merges.byte_ids[raw], np.arange(1, len(raw) + 1), np.arange(-1, len(raw) - 1)))
    symbols, afters, befores = (np.frombuffer(x, np.int64) for x in (symbol, after, before))
    queue, rank_of, push = list(index), merges.of.get, heapq.heappush
    heapq.heapify(queue)

    def file(rank: int, at: list[int]) -> None:
        if rank in index:
            index[rank] += at
        else:
            index[rank] = at
            push(queue, rank)

    def at_once(rank: int, places: list[int]) -> bool:
        p = np.unique(np.array(places, np.int64))
        j = afters[p]
        pair = symbols[p] << 20 | symbols[j]
        ok = np.isin(pair, merges.pairs[rank])
        p, j = p[ok], j[ok]
        if not len(p):
            return True
        if (j[:-1] == p[1:]).any():
            return False
        h, k = befores[p], afters[j]
        beside = np.flatnonzero(k[:-1] == p[1:])  # the next occurrence follows directly
        x, back = np.unique(symbols[h], return_inverse=True)  # h is -1 at the start: the last symbol is a word's end
        to_left = np.array([rank_of(v << 20 | rank, -1) if v >= 0 else -1 for v in x.tolist()])[back]
        x, back = np.unique(symbols[k], return_inverse=True)
        to_right = np.array([rank_of(rank << 20 | v, -1) if v >= 0 else -1 for v in x.tolist()])[back]
        twice = rank_of(rank << 20 | rank, -1) if len(beside) else -1
        made = np.concatenate([to_left, to_right, [twice]])
        if ((made >= 0) & (made <= rank)).any():
            return False
        to_left[beside + 1], to_right[beside] = -1, twice
        symbols[p], symbols[j] = rank, -1
        afters[p], befores[k] = k, p
        new, at = np.concatenate([to_left, to_right]), np.concatenate([h, p])
        at = at[new >= 0]
        new = new[new >= 0]
        order = np.argsort(new, kind="stable")
        new, at = new[order], at[order].tolist()
        cuts = np.flatnonzero(np.diff(new, prepend=-1))
        for made_rank, x, y in zip(new[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(at)]):
            file(made_rank, at[x:y])
        return True

    while queue:
        rank = heapq.heappop(queue)
        places = index.pop(rank, None)
        if places is None or len(places) >= MANY and at_once(rank, places):
            continue
        places.sort()
        for n, i in enumerate(places):
            left = symbol[i]
            if left < 0:
                continue
            j = after[i]
            right = symbol[j]
            if right < 0 or rank_of(left << 20 | right) != rank:
                continue
            k, h, lower = after[j], before[i], False
            symbol[i], symbol[j] = rank, -1
            after[i], before[k] = k, i
            if h >= 0 and (x := symbol[h]) >= 0 and (new := rank_of(x << 20 | rank)) is not None:
                file(new, [h])
                lower = new <= rank
            if (x := symbol[k]) >= 0 and (new := rank_of(rank << 20 | x)) is not None:
                file(new, [i])
                lower = lower or new <= rank
            if lower and n + 1 < len(places):  # an earlier merge came up: it goes first, the rest of these after it
                file(rank, places[n + 1 :])
                break
    at = np.flatnonzero(symbols >= 0)
    stops = np.searchsorted(at, ends).tolist()
    flat = symbols[at].astype("<u4").tobytes()
    return [flat[4 * x : 4 * y] for x, y in zip([0, *stops[:-1]], stops)]


def encoder(ranks: dict[bytes, int], pattern: str, kept: int = KEPT):
    """A function from texts to their ids as little-endian 32-bit bytes, one for each text.

    A space before a non-space always begins a match of the pattern, so texts are cut there and each different piece
    is split into words and encoded once while it stays among the kept ones.
    """
    import regex

    merges = merges_of(ranks)
    # \\s as Unicode white space, as in the library whose results these are
    pattern = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
    words_of, cut = regex.compile(pattern).findall, regex.compile(r" (?=\P{White_Space})").split
    bare: dict[str, bytes] = {}
    spaced: dict[str, bytes] = {}  # by the piece without its space
    words: dict[str, bytes] = {}

    def learn(new: list[str], lead: str, pieces: dict[str, bytes]) -> None:
        split = [words_of(lead + p) for p in new]
        fresh = list({w for ws in split for w in ws if w not in words})
        for at in range(0, len(fresh), GROUP):
            part = fresh[at : at + GROUP]
            words.update(zip(part, replay([w.encode() for w in part], merges)))
        for p, ws in zip(new, split):
            pieces[p] = words[ws[0]] if len(ws) == 1 else b"".join(map(words.__getitem__, ws))

    def encode(texts: list[str]) -> list[bytes]:
        for held in (bare, spaced, words):
            if len(held) > kept:
                held.clear()
        rest = [cut(text) for text in texts]
        heads = [ps.pop(0) for ps in rest]
        for wanted, lead, pieces in ((set(heads), "", bare), (set().union(*rest), " ", spaced)):
            new = [p for p in wanted if p not in pieces]
            if new:
                learn(new, lead, pieces)
        return [bare[head] + b"".join(map(spaced.__getitem__, ps)) for head, ps in zip(heads, rest)]

    return encode


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every row; null and empty texts have none."""
    return _run(docs, path, pattern, id_col, text_col, "doc_id long, ids array<int>", lambda ids, table: [pa.array(list(map(_ints, ids)), pa.list_(pa.int32()))])


def _ints(ids: bytes):
    import numpy as np

    return np.frombuffer(ids, "<i4")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and bytes (binary: tokens may cut a character) of every row; null and empty ids give no bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _tokens(read_ranks(path))
        for batch in batches:
            texts = [b"".join(map(table.__getitem__, ids or ())) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select(F.col(id_col).cast("long"), F.col(ids_col).cast("array<int>")).mapInArrow(work, "doc_id long, bytes binary")


def _tokens(ranks: dict[bytes, int]) -> list[bytes]:
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def _run(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str, schema: str, made) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(path)
        run, table = encoder(ranks, pattern), _tokens(ranks)
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS):
                part = batch.slice(at, DOCS)
                ids = run([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), *made(ids, table)], names=names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(work, schema)


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit integers), decoded_sha256 (of the decoded bytes).

    Every row is encoded and its ids decoded again. Null texts count as empty; rows with a null or repeated id are
    treated one by one. Other columns are ignored; an empty table gives an empty result.
    """

    def made(ids: list[bytes], table: list[bytes]) -> list[pa.Array]:
        import hashlib

        texts = [b"".join(map(table.__getitem__, _ints(i).tolist())) for i in ids]
        return [
            pa.array([len(i) // 4 for i in ids], pa.int64()),
            pa.array([hashlib.sha256(i).hexdigest() for i in ids]),
            pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
        ]

    return _run(docs, path, pattern, id_col, text_col, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", made)
