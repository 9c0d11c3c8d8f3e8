"""Every query with SQL equals it on the smallest tables."""

import duckdb
import pytest

from loomline.functions import text as T
from loomline.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if str(frame[c].dtype).startswith("datetime"):
            frame[c] = frame[c].astype("datetime64[us]").astype(str)
    frame = frame.astype(object).where(lambda v: v.notna(), None)
    return sorted(map(tuple, frame.values.tolist()), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    want = duck.execute(registry.oracle_sql()[name]).df()
    got = registry.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


#: Tested against brute force in test_chat, test_catalogue and test_exports.
WITHOUT_SQL = {"mojibake_repair", "ocr_clean", "rate_limit_batch", "overlap_dedupe", "edited_pairs", "fuzzy_coverage", "nfkd_tokens", "slot_waits", "drift_sessions", "topic_sessions", "taken_suffixes", "language_ids"}


def test_all_others_have_sql():
    assert set(registry.queries()) - set(registry.oracle_sql()) == WITHOUT_SQL


def test_overlap_of_documents(spark, duck):
    import hashlib

    seen, want = set(), []
    for doc, text in duck.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall():
        items = [hashlib.md5(x.strip(" ").lower().encode()).hexdigest() for x in text.split("\n")]
        if sum(x in seen for x in items) / len(items) <= 0.5:
            want.append(doc)
            seen.update(items)
    assert sorted(r.doc_id for r in registry.queries()["overlap_dedupe"](spark, SF).collect()) == want


def test_mojibake_comes_back(spark, duck):
    """Texts read as Latin-1 come back as they were, where a tell-tale character asks for it."""
    read = {d: t.encode().decode("latin-1") for d, t in duck.execute("SELECT doc_id, text FROM documents").fetchall()}
    want = {d: t.encode("latin-1").decode() if any(c in t for c in ("\\u00", "â", "ð")) else t for d, t in read.items()}
    marks = spark.createDataFrame([("don’t – é".encode().decode("latin-1"),), ("é",), (None,), ("â 日",)], "t string")
    assert [r[0] for r in marks.select(T.mojibake_repaired("t")).collect()] == ["don’t – é", "é", None, "â 日"]
    got = {r.doc_id: r.clean for r in registry.queries()["mojibake_repair"](spark, SF).collect()}
    assert got == want


def test_tokens_of_whole_texts(spark, duck):
    import re
    import unicodedata

    from loomline.operators import match

    def slow(text):
        plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()
        return len([w for w in re.findall("[a-z0-9]+", plain) if len(w) > 1 and w not in match.IGNORED])

    got = {r.doc_id: r.n_tokens for r in registry.queries()["nfkd_tokens"](spark, SF).collect()}
    texts = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    assert got == {d: slow(t) for d, t in texts.items()}


def test_slot_waits_of_whole_lanes(spark):
    import heapq
    from collections import defaultdict

    from loomline.plans import catalogue_plans

    lanes, want = defaultdict(lambda: [0, 0]), {}
    for job in sorted(catalogue_plans._queued(spark, SF).collect(), key=lambda r: r.seq):
        slots = lanes[job.lane]
        wait = max(heapq.heappop(slots), 90 if job.lane == "music" else 0)
        heapq.heappush(slots, wait + job.estimate)
        want[job.lane, job.seq] = wait
    assert {(r.lane, r.seq): r.wait for r in registry.queries()["slot_waits"](spark, SF).collect()} == want


def test_taken_suffixes_of_parts(spark, duck):
    from tests.test_catalogue import slow_suffixes

    parts = duck.execute("SELECT p_partkey, p_type || CASE WHEN p_partkey % 7 = 0 THEN ' (' || (p_partkey % 5 + 1) || ')' ELSE '' END FROM part ORDER BY p_partkey").fetchall()
    want = dict(zip([k for k, _ in parts], slow_suffixes([n for _, n in parts])))
    assert {r.p_partkey: r.name for r in registry.queries()["taken_suffixes"](spark, SF).collect()} == want


def test_languages(spark, duck):
    """The joined table gives what a loop over trigrams gives, and held-out documents mostly get their own language."""
    import math
    import zlib
    from collections import Counter, defaultdict

    import regex

    docs = duck.execute("SELECT doc_id, text, lang FROM documents").fetchall()
    grams = lambda t: [x for p in [" " + regex.sub(r"[^\p{L}\p{M}]+", " ", t.lower()).strip(" ") + " "] for x in (p[i : i + 3] for i in range(len(p) - 2))]
    held = {d: zlib.crc32(str(d).encode()) % 5 == 0 for d, *_ in docs}
    counts = defaultdict(Counter)
    for d, t, lang in docs:
        if not held[d]:
            counts[lang].update(grams(t))
    total = sum(counts.values(), Counter())
    kept = sorted(total, key=lambda g: (-total[g], g.encode()))[:3000]
    size = {lang: sum(c[g] + 0.5 for g in kept) for lang, c in counts.items()}
    weight = {lang: {g: math.log((c[g] + 0.5) / size[lang]) for g in kept} for lang, c in counts.items()}
    got = {r.doc_id: r for r in registry.queries()["language_ids"](spark, SF).collect()}
    for d, t, _ in docs:
        known = [g for g in grams(t) if g in weight["en"]]
        scores = {lang: sum(w[g] for g in known) for lang, w in weight.items()}
        best = min(scores, key=lambda lang: (-scores[lang], lang)) if known else None
        assert got[d].language == best or abs(scores[best] - scores[got[d].language]) < 1e-6
    right = [got[d].language == lang for d, _, lang in docs if held[d]]
    assert sum(right) / len(right) > 0.9
