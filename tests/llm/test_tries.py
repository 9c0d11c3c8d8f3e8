"""Conversation trie, token counts and Merkle manifest against brute force, with their edge cases."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
import sentencepiece

from loomline.llm import convtrie, merkle, piececount, runsum

TURN = "conv_id long, turn int, role string, text string, depth int, words string, pos long, c int"
DOC = "doc_id long, source string, lang string, n_chars long, text string, k int, pos string, node int, n int, id string, root int"
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_running_sums(spark):
    r = random.Random(1)
    rows = [(r.choice([1, 1, 1, 1, 2, 3, -4]), i, r.randrange(1 << 32), 1) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, at int, v long, one long").repartition(5)
    want, sums = {}, defaultdict(lambda: (0, 0))
    for k, at, v, one in sorted(rows):
        want[at] = sums[k] = (sums[k][0] + v, sums[k][1] + one)
    assert {x["at"]: (x["v"], x["one"]) for x in runsum.running(df, ["k"], ["at"], ["v", "one"], "t").collect()} == want


def digest_of_ends(ids):
    return hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()


def slow_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    nodes = defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(c - 20 * int(c / 20))
        turns = own.get(base, [])[:h] + own[c][h:]
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append((c, d == len(turns)))
    out = []
    for node, members in nodes.items():
        inside = {m: cs for m, cs in nodes.items() if m[: len(node)] == node}
        children = [m for m in inside if len(m) == len(node) + 1]
        leaves = [m for m in inside if not any(x[: len(m)] == m and len(x) == len(m) + 1 for x in inside)]
        saved = sum((len(cs) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", m[-1][1])) for m, cs in inside.items() if m)
        parent = min(c for c, _ in nodes[node[:-1]]) if node else None
        ends = digest_of_ends(c for c, last in members if last)
        out.append((min(c for c, _ in members), len(node), parent, len(members), len(children), len(leaves), saved, ends))
    return sorted(out, key=str)


def conversations(seed):
    r = random.Random(seed)
    says = ["hi there", "a b\tc", "", None, "x\x0by\xa0z", "one"]
    rows = []
    for c in [*range(0, 60), 101, 119, 205, 2**40, -7, -20, *range(400, 440)]:
        first = [("user", r.choice(says)) for _ in range(3)] if c % 3 else [("user", "hi there"), (None, "one"), ("", "")]
        turns = first[: r.randint(1, 3)] + [(r.choice(["user", "assistant", None]), r.choice(says)) for _ in range(r.randint(0, 4))]
        order = list(range(len(turns)))
        order[0] = None if r.random() < 0.3 else 0
        rows += [(c, t, *turn) for t, turn in zip(order, turns)]
    rows += [(500 + i, t, "user", f"same {t}") for i in range(40) for t in range(9)]  # many copies
    rows += [(700, t, "user", "deep") for t in range(70)] + [(719, t, "user", "deep") for t in range(75)]
    rows += [(None, 0, "user", "nobody"), (820, 3, "user", "hi there"), (820, 3, "user", "hi there")]  # a repeated row
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_conversation_trie(spark, seed):
    rows = conversations(seed)
    df = spark.createDataFrame([(*x, 1, "w", 2, 3) for x in rows], TURN).repartition(7)
    got = convtrie.trie(df).collect()
    assert sorted((tuple(x) for x in got), key=str) == slow_trie(rows)
    assert all(len(x) == 8 for x in got) and convtrie.trie(df.limit(0)).count() == 0


def test_rollup_doubles(spark, monkeypatch):
    """Rounds grow with the logarithm of the depth, and all ancestors get all that is below them."""
    names = []
    keep = convtrie.save
    monkeypatch.setattr(convtrie, "save", lambda df, name, most=None: (names.append(name), keep(df, name, most))[1])
    chain = [(i, 0, i - 1 if i else None, 0 if i else None, int(i == 99), 1) for i in range(100)] + [(1000 + i, 0, 49, 0, 1, 0) for i in range(30)]
    df = spark.createDataFrame(chain, "ia long, ib long, pa long, pb long, leaves long, saved long")
    got = {x.ia: (x.n_leaves, x.saved) for x in convtrie.rollup(df, 99).collect()}
    assert got == {i: (1 + 30 * (i <= 49), 100 - i) for i in range(100)} | {1000 + i: (1, 0) for i in range(30)}
    assert len(names) == 7


def test_token_counts(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    r = random.Random(3)
    pool = ["  ", " ", "\n", "\t", "▁", "the", "of", "ing", "é", "é", "ß", "<s>", "</s>", "<unk>", "<0x0A>", "日本", "語", "𐍈", "\x00", "①", "12", "3.5", ".", ",", "...", "'s", "-", "ﬁ", "क्ष", "　"]
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 40))) for _ in range(1500)]
    texts += [None, "", " ", "▁", "\n\n", "x" * 60_000, "ab1é" * 20_000, "the cat. " * 5000, " " * 300]
    rows = [(i, t, 1, "n", "m") for i, t in enumerate(texts)] + [(None, "null id", 1, "n", "m"), (0, texts[0], 1, "n", "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, t string, n_bytes string")
    want = [(i, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for i, t, *_ in rows]
    assert sorted((tuple(x) for x in piececount.counts(df, PIECES).collect()), key=str) == sorted(want, key=str)
    assert piececount.counts(df.limit(0), PIECES).count() == 0


def test_words_are_cut_where_the_vocabulary_allows(monkeypatch):
    r = random.Random(5)
    for crossing in (["a▁b"], ["b."], ["\na"], []):
        ranks = {p: i for i, p in enumerate(["ab", "▁a", "▁▁", "bb", "▁ab", "..", *crossing, "a", "b", "▁", "."])}
        monkeypatch.setattr(piececount, "KEPT", 5)
        count = piececount.counter(ranks)
        for _ in range(400):
            text = "".join(r.choice("ab .\né") for _ in range(r.randint(1, 20)))
            assert count(text) == piececount.merged("▁" + text.replace(" ", "▁"), ranks)


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def slow_tree(leaves):
    """The root, and for every leaf its runs: place in the run and the run's digests, level by level."""
    paths, nodes, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
        for path, i in zip(paths, at):
            path.append((i % 8, runs[i // 8]))
        nodes, at = [sha("".join(run)) for run in runs], [i // 8 for i in at]
    return nodes[0] if nodes else None, paths


def slow_manifest(rows):
    low = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    leaf = lambda d, s, l, n, t: sha("".join(map(field, (d, s, l, n, t))))
    groups = defaultdict(list)
    for row in rows:
        d, s, l, n, t = row[:5]
        other = leaf(d, s, l, n, t and t.translate(low)) if d is not None and zlib.crc32(str(d).encode()) % 3 == 0 else leaf(d, s, l, n, t)
        groups[l].append((d is not None, d or 0, leaf(d, s, l, n, t), other, d))
    order = sorted(groups, key=lambda l: (l is not None, (l or "").encode()))
    trees = {l: slow_tree([x[2] for x in sorted(groups[l], key=lambda x: x[:3])]) for l in order}
    root, tops = slow_tree([trees[l][0] for l in order])
    out = []
    for l, top in zip(order, tops):
        for (*_, own, other, d), path in zip(sorted(groups[l], key=lambda x: x[:3]), trees[l][1]):
            proof, folded = "", other
            for i, run in path + top:
                proof += "".join(run[:i] + run[i + 1 :])
                folded = sha("".join(run[:i] + [folded] + run[i + 1 :]))
            out.append((d, own, trees[l][0], root, sha(proof), folded, folded == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("levels", [1, 3])
def test_manifest(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 8**levels)
    r = random.Random(levels)
    rows = [(i, r.choice(["a", None, ""]), r.choice(["en"] * 6 + ["é", "", "=", "zz"]), r.choice([None, i]), r.choice(["Some Text", "low", None, "", "É ABC"]) ) for i in range(600)]
    rows += [(1000 + i, "s", None, 1, "T" * 2000) for i in range(9)] + [(2000, "s", f"lone {i}", 1, "X") for i in range(70)]
    rows += [(None, "s", "en", 1, "Null id"), (5, "s", "en", 2, "Again"), (5, "s", "en", 2, "Again"), (-3, None, "en", None, None), (3000, "s", "en", 1, "A" * 100_000)]
    df = spark.createDataFrame([(*x, 1, "p", 2, 3, "i", 4) for x in rows], DOC).repartition(5)
    got = merkle.manifest(df).collect()
    assert sorted((tuple(x) for x in got), key=str) == slow_manifest(rows)
    assert 0 < sum(x.verified for x in got) < len(got)


@pytest.mark.parametrize("n", [0, 1, 8, 9, 512, 513])
def test_manifest_of_few(spark, n):
    rows = [(i, "s", "en", 1, f"Text {i}") for i in range(n)]
    df = spark.createDataFrame([(*x, 1, "p", 2, 3, "i", 4) for x in rows], DOC)
    assert sorted((tuple(x) for x in merkle.manifest(df).collect()), key=str) == slow_manifest(rows)
