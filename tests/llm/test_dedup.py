"""SimHash, lattice, bit-sliced and line operators against brute force, with their edge cases."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomline.llm import bitslice, components, lattice, lines, simhash

DOC = "doc_id long, text string, upper string, ha long, fp long"  # extra columns whose names the operators use


def least_roots(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    r = random.Random(1)
    links = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(60)] + [(500, 600 + i) for i in range(200)]
    want = least_roots(900, links)
    got = {x.node: x.root for x in components.components(spark.createDataFrame([*links, (7, 7), (None, 3)], "a long, b long")).collect()}
    touched = {v for a, b in links if a != b for v in (a, b)}
    assert got == {v: want[v] for v in touched}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def slow_fingerprint(text):
    ws = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        ws = ws.replace(c, " ")
    ws = [w for w in ws.split(" ") if w]
    if not ws:
        return 0
    k = min(3, len(ws))
    hs = [xxhash.xxh64_intdigest(" ".join(ws[i : i + k]).encode(), 42) for i in range(len(ws) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(spark):
    r = random.Random(3)
    base = [" ".join(r.choice("abcdefgh") + str(r.randint(0, 30)) for _ in range(60)) for _ in range(60)]
    texts = base + [b.replace("a1", "a2") for b in base] + [None, "", " \t", "One", "one TWO", "É é x"] + base[:5] + ["w " * 40_000]
    rows = [(i * 3, t, "x", 1, 2) for i, t in enumerate(texts)] + [(3, base[1], "x", 1, 2), (None, base[2], "x", 1, 2)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOC)).collect()
    fps = [slow_fingerprint(t) for _, t, *_ in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2]
    roots, least = least_roots(len(rows), links), defaultdict(list)
    for i, root in enumerate(roots):
        if rows[i][0] is not None:
            least[root].append(rows[i][0])
    want = sorted((str(rows[i][0]), f"{fps[i]:016x}", min(least[root])) for i, root in enumerate(roots))
    assert sorted((str(x.doc_id), x.fingerprint, x.component_id) for x in got) == want
    assert simhash.near_duplicates(spark.createDataFrame([], DOC)).count() == 0


@pytest.mark.parametrize(("bits", "leaf", "tops"), [(0, 64, 16_384), (2, 64, 16_384), (3, 64, 16_384), (2, 4, 8), (3, 2, 8)])
def test_gray_index(spark, monkeypatch, bits, leaf, tops):
    """With small leaves, narrow nodes and few tops, lower levels are joined."""
    if leaf < 64:
        for name, value in (("LEAF", leaf), ("FAN_BITS", 1), ("FAN", 2), ("MAX_TOPS", tops)):
            monkeypatch.setattr(simhash, name, value)
    r = random.Random(bits)
    centres = [r.getrandbits(64) for _ in range(60)]
    fps = {c ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 3))) for c in centres for _ in range(40)} | {0, (1 << 64) - 1, 1 << 63}
    fps = np.array(sorted({x & (1 << 64) - 1 for x in fps}), np.uint64)
    want = least_roots(len(fps), [(i, j) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= bits)])
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    place = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    got = least_roots(len(fps), [(place[x.a], place[x.b]) for x in simhash.links(frame, bits).collect()])
    assert got == want


@pytest.mark.parametrize("fan", [2, 4, 64])
def test_tree_in_arrays(monkeypatch, fan):
    monkeypatch.setattr(simhash, "FAN", fan)
    rng = np.random.default_rng(fan)
    pattern = np.sort(rng.integers(-(1 << 63), 1 << 63, 20)[rng.integers(0, 20, 300)] ^ (1 << rng.integers(0, 63, 300)))
    mask = ~(1 << rng.integers(0, 63, 300))
    queries, q_mask = pattern[::7], mask[::7]
    row, at, apart = simhash._down(simhash._tree(mask, pattern & mask), q_mask, queries & q_mask, 2)
    bits = np.bitwise_count(((queries[:, None] ^ pattern) & mask & q_mask[:, None]).view(np.uint64))
    assert sorted(zip(row.tolist(), at.tolist(), apart.tolist())) == [(i, j, bits[i, j]) for i, j in np.argwhere(bits <= 2).tolist()]


def vectors(seed=5, n=400, d=16):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((60, d))
    x = base[rng.integers(0, 60, n)] + rng.standard_normal((n, d)) * rng.choice([0.02, 0.1, 2.0], (n, 1))
    return x / np.linalg.norm(x, axis=1, keepdims=True), rng.integers(0, 3, n)


def test_e8():
    rng = np.random.default_rng(1)
    y = rng.standard_normal((300, 8)) * 3
    near, around = lattice.e8_nearest(y), lattice.e8_neighbours()
    assert len(np.unique(around, axis=0)) == 240 and np.allclose((around**2).sum(1), 2)
    whole = np.all(near == np.rint(near), axis=1)
    assert np.all(whole | np.all(near - 0.5 == np.rint(near - 0.5), axis=1)) and np.all(near.sum(1) % 2 == 0)
    assert np.all(((y - near) ** 2).sum(1)[:, None] <= ((y[:, None] - near[:, None] - around) ** 2).sum(2) + 1e-9)


def test_lattice(spark, monkeypatch):
    monkeypatch.setattr(lattice, "BLOCK", 16)  # crowded cells are cut
    x, labels = vectors()
    rows = [(i, [float(v) for v in x[i]], int(labels[i]), "z") for i in range(len(x))]
    odd = [(1000, None, 1, "z"), (1001, [0.0] * 16, 1, "z"), (1002, [float("nan")] * 16, 1, "z"), (1003, rows[0][1], None, "z"), (1004, [], 1, "z"), (1005, [1.0, None], 1, "z"), (None, rows[0][1], 1, "z"), rows[7]]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int, id string")
    near = (x @ x.T >= 0.93) & (labels[:, None] == labels[None])
    np.fill_diagonal(near, False)
    roots = least_roots(len(x), zip(*np.nonzero(near)))
    got = lattice.near_duplicates(frame).collect()
    assert len(got) == len(rows) + len(odd)
    by_id = {g.vec_id: g for g in got}
    assert near.sum() > 300
    assert sum(by_id[i].n_links for i in range(len(x))) >= 0.9 * near.sum()
    assert np.mean([by_id[i].component_id == roots[i] for i in range(len(x))]) > 0.9
    assert all(by_id[i].n_links <= near[i].sum() for i in range(len(x)))
    assert all((by_id[i].n_links, by_id[i].component_id, by_id[i].kept) == (0, i, True) for i in range(1000, 1006))
    assert lattice.near_duplicates(frame.limit(0)).count() == 0


@pytest.mark.parametrize("d", [64, 256])
def test_lattice_recall(spark, d):
    """Of pairs just over the threshold, none of them linked through others, at least 0.9 are found; with copies."""
    rng = np.random.default_rng(d)
    x = rng.standard_normal((1500, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    off = rng.standard_normal((1500, d))
    off -= (off * x).sum(1, keepdims=True) * x
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    y = 0.931 * x + (1 - 0.931**2) ** 0.5 * off
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(2000 + i, v.tolist(), 1) for i, v in enumerate(y)] + [(5000 + i, x[0].tolist(), 1) for i in range(700)]
    got = {r.vec_id: r for r in lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert np.mean([got[2000 + i].component_id == i for i in range(1500)]) >= 0.9
    assert all(got[5000 + i].component_id == 0 and got[5000 + i].n_links in (700, 701) for i in range(700))
    assert got[0].n_links == got[5000].n_links and got[0].kept and not got[5000].kept


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(bitslice, "ROWS", 64)
    monkeypatch.setattr(bitslice, "QUERIES", 3)
    rng = np.random.default_rng(2)
    x = np.round(rng.standard_normal((300, 6)), 1)  # many ties
    rows = [(i, [float(v) for v in x[i]], 1) for i in range(300)] + [(300, [0.0] * 6, 1)]
    odd = [(350, None, 1), (400, [float("inf")] * 6, 1), (450, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (None, rows[0][1], 1), (500, [1.0], 1), (550, [], 1)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, block int")
    q = np.floor(256 * np.array([r[1] for r in rows])).astype(np.int64)
    want = []
    for i in range(0, 301, 50):
        s = q @ q[i]
        best = sorted((j for j in range(301) if j != i), key=lambda j: (-s[j], j))[:5]
        want += [(i, n, j, int(s[j])) for n, j in enumerate(best, 1)]
    got = bitslice.top_k(frame, F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    few = bitslice.top_k(frame.where("vec_id in (0, 1, 2)"), F.col("vec_id") == 0)
    assert few.count() == 2 and bitslice.top_k(frame.limit(0), F.col("vec_id") == 0).count() == 0


def test_top_k_of_equal_vectors(spark):
    rows = [(i, [0.5, -1.0, 0.25, 0.0]) for i in range(40)]
    got = bitslice.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0).collect()
    score = 128 * 128 + 256 * 256 + 64 * 64
    assert sorted(map(tuple, got)) == sorted((q, n, v, score) for q in range(0, 40, 10) for n, v in enumerate([v for v in range(40) if v != q][:5], 1))


def test_top_k_of_large_values(spark):
    frame = lambda c: spark.createDataFrame([(i, [c + 1000 * i, -c]) for i in range(20)], "vec_id long, embedding array<double>")
    q = [(256 * int(1e6 + 1000 * i), -256 * 10**6) for i in range(20)]
    want = sorted(((-(q[0][0] * x + q[0][1] * y), i) for i, (x, y) in enumerate(q) if i))[:5]
    got = bitslice.top_k(frame(1e6), F.col("vec_id") == 0).collect()
    assert sorted((-r.score, r.vec_id) for r in got) == want
    with pytest.raises(Exception, match="too large"):
        bitslice.top_k(frame(1e17), F.col("vec_id") == 0).collect()


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def varied(r, line, most):
    out = list(line)
    for _ in range(r.randint(0, most)):
        p, kind = r.randint(0, max(0, len(out) - 1)), r.randint(0, 2)
        if kind == 0 or not out:
            out.insert(p, r.choice("xyz"))
        elif kind == 1:
            out.pop(p)
        else:
            out[p] = r.choice("xyz")
    return "".join(out)


def test_distance():
    r = random.Random(2)
    for _ in range(4000):
        a = "".join(r.choice("ab") for _ in range(r.randint(0, 12)))
        b = varied(r, a, 4) if r.random() < 0.7 else "".join(r.choice("ab") for _ in range(r.randint(0, 12)))
        k, d = r.randint(0, 6), edits(a, b)
        assert lines.distance(a, b, k) == (d if d <= k else None)


def thirds(n, pieces):
    """Start and end of so many even pieces of n units, longer ones last."""
    sizes = [n // pieces + (i >= pieces - n % pieces) for i in range(pieces)]
    return [(sum(sizes[:i]), sum(sizes[: i + 1])) for i in range(pieces)]


def edits_allowed(n):
    return min(2, (n + n // 10**6) // 5)


def slow_keys(line):
    """What a line is filed under and what it looks for: unit, length, pieces, piece and its units."""
    words = line.split(" ")
    filed, sought = set(), set()
    for unit, parts, least in (("word", words, lines.LONG), ("char", list(line), lines.SHORTEST)):
        n = len(parts)
        if n < least or (unit == "char" and len(words) >= lines.LONG + 2):
            continue
        for gap in range(3):
            if edits_allowed(n + gap) >= max(gap, 1):
                pieces = edits_allowed(n + gap) + 1
                filed |= {(unit, n, pieces, i, tuple(parts[x:y])) for i, (x, y) in enumerate(thirds(n, pieces))}
        most = edits_allowed(n)
        for gap in range(most + 1 if most else 0):
            if n - gap >= least:
                for i, (x, y) in enumerate(thirds(n - gap, most + 1)):
                    for at in range(max(0, x - i, x + gap - (most - i)), min(x + i, x + gap + most - i, n - (y - x)) + 1):
                        sought.add((unit, n - gap, most + 1, i, tuple(parts[at : at + y - x])))
    return filed, sought | filed


def slow_near(a, b):
    x, y = a.split(" "), b.split(" ")
    x, y = (x, y) if min(len(x), len(y)) >= lines.LONG else (a, b)
    return lines.distance(x, y, max(len(x), len(y)) // 5) is not None  # which test_distance holds against the whole table


def brute_lines(docs):
    """Lines that go: near lines are those that share a place that a line is filed under, at a similarity of 0.8."""
    where = defaultdict(list)
    for i, t in docs:
        for n, line in enumerate((t or "").split("\n")):
            if line.strip(" \t\r") and i is not None:
                where[line].append((i, n))
    texts = sorted(where)
    at, good = defaultdict(list), set()
    for k, t in enumerate(texts):
        filed, every = slow_keys(t)
        good |= filed
        for key in every:
            at[key].append(k)
    tried = {(a, b) for key in good for a in at[key] for b in at[key] if b < a}
    pairs = [(a, b) for a, b in tried if slow_near(texts[a], texts[b])]
    roots, first = least_roots(len(texts), pairs), {}
    for k, t in enumerate(texts):
        first[roots[k]] = min(first.get(roots[k], (1 << 60, 0)), min(where[t]))
    gone = defaultdict(set)
    for k, t in enumerate(texts):
        for i, n in where[t]:
            if (i, n) != first[roots[k]]:
                gone[i].add(n)
    return gone


def worded(r, words, most):
    out = list(words)
    for _ in range(r.randint(0, most)):
        p, kind = r.randrange(len(out)), r.randint(0, 2)
        out[p : p + (kind > 0)] = [] if kind == 1 else [r.choice(["so", "blue", "extraordinarily" * 3, "é", ""])]
    return " ".join(out)


@pytest.mark.parametrize("block", [256, 4])
def test_lines(spark, monkeypatch, block):
    monkeypatch.setattr(lines, "BLOCK", block)
    r = random.Random(block)
    base = ["".join(r.choice("abcdé ") for _ in range(r.randint(3, 40))) for _ in range(40)]
    long = [[r.choice("the of red house river stone walks under").strip() + r.choice(["", "s", "ing"]) for _ in range(r.randint(14, 24))] for _ in range(12)]
    docs = [(i, "\n".join(varied(r, r.choice(base), 3) for _ in range(r.randint(0, 6)))) for i in range(80)]
    docs += [(100 + i, "\n".join(varied(r, worded(r, r.choice(long), 3), r.randint(0, 1)) for _ in range(4))) for i in range(60)]
    docs += [(200 + i, worded(r, long[0] * 3, 5)) for i in range(60)]  # many near copies, also of each other only
    docs += [(300, "abcd\nabcde\nabcdf"), (301, "\t\r\n \n\t\r"), (90, None), (91, ""), (92, "\n \n"), (None, base[0]), (93, "x" * 50_000), (94, "ab " * 2000)]
    rows = [(i, t, "x", 1, 2) for i, t in docs]
    frame = spark.createDataFrame(rows, DOC).repartition(5)
    gone = brute_lines(docs)
    got = {x.doc_id: x for x in lines.document_classes(frame).collect()}
    for i, t in docs:
        assert {int(p.split(":")[0]) for p in got[i].dropped.split(",") if p} == gone.get(i, set())
    texts = {x.doc_id: x.text for x in lines.dedup_lines(frame).collect()}
    for i, t in docs:
        want = t if not gone.get(i) else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i])
        assert texts[i] == want
    assert sum(map(len, gone.values())) > 150
    assert lines.dedup_lines(frame).columns == frame.columns and lines.document_classes(frame.limit(0)).count() == 0


def test_lines_within_two_edits_are_all_found(spark):
    """Lines of words with up to two words, and shorter lines with up to two characters, inserted, deleted or replaced."""
    r = random.Random(11)
    docs, near = [], set()
    for k in range(150):
        if k % 2:
            one = [f"w{r.randrange(10**6)}" for _ in range(r.randint(18, 60))]
            other = worded(r, one, 2)
        else:
            one = [r.choice("abcdefghijklmnop ") for _ in range(r.randint(12, 60))]
            other = varied(r, "".join(one), 2)
        text = (" " if k % 2 else "").join(one)
        if text.strip() and other.strip() and text != other:
            docs += [(2 * k, text), (2 * k + 1, other)]
            near.add(2 * k + 1)
    got = lines.document_classes(spark.createDataFrame(docs, "doc_id long, text string")).where("dropped <> ''").collect()
    assert {x.doc_id for x in got} == near and all(x.dropped == f"0:{x.doc_id - 1}:0" for x in got)


def test_crowded_lines(spark):
    """A third of the lines are near copies of one; they make rows in line with their number."""
    r = random.Random(4)
    base = [f"word{i}" for i in range(60)]
    docs = [(i, " ".join([*base[:p], f"other{i}", *base[p + 1 :]])) for i in range(1200) for p in [r.randrange(60)]] + [(5000, " ".join(base)), (5001, " ".join(base))]
    docs += [(2000 + i, " ".join(f"v{r.randrange(10**6)}" for _ in range(40))) for i in range(2400)]
    got = {x.doc_id: x.dropped for x in lines.document_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(d == ("" if i == 0 or 2000 <= i < 5000 else "0:0:0") for i, d in got.items())
