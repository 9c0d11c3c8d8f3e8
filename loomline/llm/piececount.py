"""Token counts of a piece vocabulary by heap-and-linked-list byte-pair merging.

A text's symbols are its characters, spaces shown as U+2581 and one put in front. A heap holds the adjacent pairs that
are pieces, by rank, then place; the lowest is popped while there is one, its right symbol leaves the linked list, and
the pairs with both neighbours are pushed. A character that is no piece counts as its UTF-8 bytes. A text's count is
its initial symbols less its merges; ids are never made.

No merge crosses a place where no piece holds the characters on both sides. Texts are cut there (before runs of
spaces, and between ASCII signs or line breaks and other characters, as the vocabulary allows), and equal words are
merged once while they stay among the kept ones. A vocabulary with pieces across starts of spaces is merged over whole
texts. One narrow stage, whatever the size.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
KEPT = 400_000
LIMIT = 4096


def read_pieces(path: str) -> dict[str, int]:
    """Rank of every piece that merges may make (0: first), from a model whose normaliser leaves texts as they are."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    probe = "ﬁ① é　a  b\tc\n "
    if not any(model.is_byte(i) for i in range(model.get_piece_size())) or model.decode(model.encode(probe)) != probe:
        raise ValueError("only models with byte fallback and without normalisation are counted")
    ids = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    ids.sort(key=lambda i: (-model.get_score(i), i))
    return {model.id_to_piece(i): rank for rank, i in enumerate(ids)}


def merged(word: str, ranks: dict[str, int]) -> int:
    """Tokens of a word: its initial symbols less its merges."""
    symbols = list(word)
    size = [1 if c in ranks else len(c.encode()) for c in symbols]
    count, end = sum(size), len(symbols)
    after, before = list(range(1, end + 1)), list(range(-1, end - 1))
    heap = []
    for i in range(end - 1):
        pair = symbols[i] + symbols[i + 1]
        if pair in ranks:
            heap.append((ranks[pair], i, pair))
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i]
        if j >= end or not symbols[i] or symbols[i] + symbols[j] != pair:
            continue
        count -= size[i] + size[j] - 1
        symbols[i], symbols[j], size[i] = pair, "", 1
        after[i] = k = after[j]
        if k < end:
            before[k] = i
            if (new := pair + symbols[k]) in ranks:
                heapq.heappush(heap, (ranks[new], i, new))
        if (h := before[i]) >= 0 and (new := symbols[h] + pair) in ranks:
            heapq.heappush(heap, (ranks[new], h, new))
    return count


def _words(ranks: dict[str, int]) -> re.Pattern | None:
    """Cuts texts where no piece holds the characters on both sides; None if pieces cross starts of spaces."""
    joined = {(a, b) for p in ranks for a, b in zip(p, p[1:])}
    if any(b == SPACE != a for a, b in joined):
        return None
    signs = {chr(c) for c in range(33, 127) if not chr(c).isalpha()}
    cut = "".join(map(re.escape, sorted(signs))) if not any((a in signs) != (b in signs) for a, b in joined if a != SPACE) else ""
    cut += "" if any("\n" in pair for pair in joined) else "\n"
    return re.compile(f"{SPACE}*[^{SPACE}{cut}]+|{SPACE}*[{cut}]+|{SPACE}+" if cut else f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class _Kept(dict):
    """Counts of words, made when first asked for."""

    def __init__(self, ranks: dict[str, int]):
        self.ranks = ranks

    def __missing__(self, word: str) -> int:
        n = merged(word, self.ranks)
        if len(word) <= 64:
            if len(self) >= KEPT:
                self.clear()
            self[word] = n
        return n


def counter(ranks: dict[str, int]) -> Callable[[str], int]:
    """A function that counts a text's tokens and keeps the counts of up to KEPT words."""
    words, kept = _words(ranks), _Kept(ranks)
    if words is None:
        return lambda text: merged(SPACE + text.replace(" ", SPACE), ranks) if text else 0
    return lambda text: sum(map(kept.__getitem__, words.findall(SPACE + text.replace(" ", SPACE)))) if text else 0


@lru_cache(maxsize=2)
def _counter_of(path: str) -> Callable[[str], int]:
    return counter(read_pieces(path))  # a Python worker's tasks share it


def counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than limit tokens) of every row's whole text.

    Null and empty texts have 0 bytes and tokens. Ids may be null or repeat: every row has its own result. Other columns
    are ignored. An empty table gives an empty result.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter_of(path)
        for batch in batches:
            n = pa.array([count(t) for t in batch.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("t"))
    return rows.mapInArrow(work, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
