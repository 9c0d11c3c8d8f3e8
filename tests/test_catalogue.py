"""Matching, media, runtime, sources and streams on the literals that their rules were written for."""

import datetime as dt
import functools
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.operators import match, media, runtime
from loomline.sources import files
from loomline.streaming import live


def scored(spark, title, artist, album, ms, video, channel, seconds, rank=0, description="", free=False):
    one = spark.createDataFrame([(title, artist, album, ms, video, channel, seconds, rank, description)], "title string, artist string, album string, ms long, video string, channel string, seconds int, rank int, description string")
    c, words = F.col, lambda k: match.meaningful(match.normalized(k))
    one = one.select(
        "ms", "seconds", "rank", words(match.sanitized_title(c("title"))).alias("t"), words(c("artist")).alias("a"), words(match.sanitized_album(c("album"))).alias("b"),
        words(c("video")).alias("v"), F.array_union(F.array_union(words(c("video")), words(c("channel"))), words(c("description"))).alias("all"),
        match.normalized(c("video")).alias("video"), match.normalized(c("channel")).alias("channel"), match.normalized(c("description")).alias("description"),
    )
    one = one.withColumns({"ct": match.fuzzy_coverage("t", "v"), "ca": match.fuzzy_coverage("a", "all"), "cb": match.fuzzy_coverage("b", "all")})
    value = match.score(
        F.lit(free), c("seconds"), c("rank"), c("video"), c("channel"), c("description"), {"title": c("ct"), "artist": c("ca"), "album": c("cb"), "query": c("ct")},
        {"artist": F.size("a"), "album": F.size("b")}, match.longest_ordered(c("t"), c("v")), c("ms"),
    )
    return one.select(value).first()[0]


def test_scores(spark):
    track = ("Manase Maya (From 'Mundina Nildana')", "Sooraj Santhosh", "Mundina Nildana (Original Motion Picture Soundtrack)", 210000)
    assert scored(spark, *track, "Manase Maya Maya - Lyrical Kannada | CHIMERA", "Vignesh Raja", 240) < 80
    assert scored(spark, *track, "Manase Maya - Mundina Nildana - Official Audio", "Sooraj Santhosh - Topic", 245) >= 65
    assert scored(spark, *track, "Mundina Nildana - Manase Maya (Making Video)", "PRK Audio", 205) == 0
    assert scored(spark, "Example Song", "Example Artist", "", 201000, "Example Song", "Example Artist - Topic", 200) >= 80
    assert scored(spark, "manase maya sooraj santosh", "", "", 0, "Manase Maya Sooraj Santhosh", "PRK", 210, rank=1, free=True) >= 50


def test_sanitise(spark):
    one = spark.createDataFrame([("Song (From \"Film\") [Remastered]", "Film (Original Motion Picture Soundtrack)", "Ann feat. Bob")], "t string, a string, p string")
    got = one.select(match.sanitized_title(F.col("t")), match.sanitized_album(F.col("a")), match.search_query(F.col("t"), F.col("p"), F.col("a"), F.lit(False))).first()
    assert tuple(got) == ("Song", "Film", '"Song" Ann official audio')


def test_ocr(spark):
    texts = ["SWIPETOWATCH", "a ,b", "3.5", "THATHASNEVERCHANGED THE WORLD TODAY", None]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = [r.c for r in media.ocr_cleaned(frame, "t", "c").orderBy("i").collect()]
    assert got[:3] == ["SWIPE TO WATCH", "a, b", "3. 5"]
    assert got[3].startswith("THAT HAS NEVER CHANGE") and got[4] == ""


def given(v):
    return v not in (None, False, 0, "", [], {})


def slow_media(node):
    """The media object that a node is by the rules, or None."""
    code = next((node[k] for k in ("code", "shortcode") if given(node.get(k))), None)
    if not isinstance(code, str) or not re.fullmatch("[A-Za-z0-9_-]{5,20}", code):
        return None
    below = node["carousel_media"] if given(node.get("carousel_media")) else [e["node"] for e in (node.get("edge_sidecar_to_children") or {}).get("edges", []) if given(e.get("node"))]
    image = next((k for k in ("image_versions2", "display_resources", "display_url", "thumbnail_src") if given(node.get(k))), None)
    video = next((k for k in ("video_versions", "video_url") if given(node.get(k))), None)
    if not (image or video or below):
        return None
    kind = node["media_type"] if node.get("media_type") is not None else 8 if below else 2 if given(node.get("is_video")) or video else 1
    picture = {"image_versions2": lambda v: v["candidates"][0]["url"], "display_resources": lambda v: next((r["src"] for r in v if given(r.get("src"))), None)}.get(image, lambda v: v)
    caption = node.get("caption")
    text = caption.get("text") if isinstance(caption, dict) else caption if given(caption) else (node.get("edge_media_to_caption") or {"edges": [{"node": {}}]})["edges"][0]["node"].get("text")
    user = node.get("user") if given(node.get("user")) else node.get("owner")
    name = {8: "carousel", 2: "video", 1: "image"}.get(kind, "unknown")
    name = "reel" if kind != 8 and node.get("product_type") == "clips" else name
    children = [slow_media(c if given(c.get("code")) or given(c.get("shortcode")) else c | {"code": f"{code}_{i}"}) for i, c in enumerate(below)] if kind == 8 else []
    moving = {"video_versions": lambda v: v[0]["url"]}.get(video, lambda v: v)
    return code, name, text or "", (user or {}).get("username") or "unknown", picture(node[image]) if image else None, moving(node[video]) if video else None, [(c[0], c[1], c[4], c[5]) for c in children if c]


def slow_walk(node, out):
    if isinstance(node, dict):
        got = slow_media(node)
        if got:
            out.append(got)
            return out
    for child in node.values() if isinstance(node, dict) else node if isinstance(node, list) else []:
        slow_walk(child, out)
    return out


def slow_codes(node, out):
    if isinstance(node, dict):
        code = next((node[k] for k in ("code", "shortcode") if given(node.get(k))), None)
        if isinstance(code, str) and re.fullmatch("[A-Za-z0-9_-]{5,20}", code):
            out.append(code)
    for child in node.values() if isinstance(node, dict) else node if isinstance(node, list) else []:
        slow_codes(child, out)
    return out


def some_node(r, depth=0):
    pick = lambda *xs: r.choice(xs)
    node = {"code": pick("abcde", "own_1", "no", 12345, None, "", "way_too_long_for_a_code_x"), "shortcode": pick("short1", "x", None)}
    node |= {"media_type": pick(1, 2, 8, 8, None), "product_type": pick("clips", "feed", None), "is_video": pick(True, False)}
    node |= {"image_versions2": pick({"candidates": [{"url": "i1"}, {"url": "i2"}]}, {}, None), "display_resources": pick([{"src": ""}, {"src": "r1"}], [{"x": 1}], []), "display_url": pick("d", ""), "thumbnail_src": pick("t", None)}
    node |= {"video_versions": pick([{"url": "v1"}], [], None), "video_url": pick("v2", "")}
    node |= {"caption": pick({"text": "said"}, {"text": None}, "plain", "", None), "edge_media_to_caption": pick({"edges": [{"node": {"text": "old"}}]}, None), "user": pick({"username": "ann"}, {"x": 1}, None), "owner": pick({"username": "bob"}, None)}
    if depth < 2:
        node |= {"carousel_media": [some_node(r, 2) for _ in range(r.randint(0, 3))], "edge_sidecar_to_children": pick({"edges": [{"node": some_node(r, 2)}, {"y": 1}, {"node": {}}]}, None)}
        node |= {"within": pick([some_node(r, depth + 1)], {"deep": [[{"er": some_node(r, depth + 1)}]]}, 3, None)}
    return {k: v for k, v in node.items() if r.random() < 0.7}


def test_media(spark):
    item = {"code": "Abcde", "carousel_media": [{"display_url": "u"}, {"code": "own_1", "video_url": "v"}, {"code": "no", "display_url": "u"}], "caption": "hi", "user": {"username": "ann"}}
    doc = {"a": [{"b": {"node": item}}, {"shortcode": "Cdefg", "video_versions": [{"url": "v"}]}, {"code": "Efghi", "media_type": 2}]}
    frame = spark.createDataFrame([(1, json.dumps(doc)), (2, "not json"), (3, None), (4, "[]")], "i long, doc string")
    got = media.normalised(frame, "doc").orderBy("code").collect()
    assert [(r.code, r.kind, r.caption, r.username, r.video_url) for r in got] == [("Abcde", "carousel", "hi", "ann", None), ("Cdefg", "video", "", "unknown", "v")]
    assert [(c.code, c.kind) for c in got[0].children] == [("Abcde_0", "image"), ("own_1", "video")]
    assert sorted(r.code for r in media.shortcodes_in(frame, "doc").collect()) == ["Abcde", "Cdefg", "Efghi", "own_1"]


def test_media_of_any_shape(spark):
    r = random.Random(8)
    docs = [{"top": [some_node(r) for _ in range(r.randint(0, 3))], "other": some_node(r)} for _ in range(150)]
    frame = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i long, doc string").repartition(3)
    got = [(x.i, (x.code, x.kind, x.caption, x.username, x.image_url, x.video_url, [tuple(c) for c in x.children])) for x in media.normalised(frame, "doc").collect()]
    assert sorted(got, key=str) == sorted([(i, m) for i, d in enumerate(docs) for m in slow_walk(d, [])], key=str) and len(got) > 100
    codes = [(x.i, x.code) for x in media.shortcodes_in(frame, "doc").collect()]
    assert sorted(codes) == sorted((i, c) for i, d in enumerate(docs) for c in slow_codes(d, []))


def slow_cut(token):
    """Every cut's score by the rules, then the one whose last part begins first, from the end on."""
    low, n = token.lower(), len(token)

    @functools.cache
    def best(j):
        if not j:
            return 0, ()
        ways = []
        for i in range(j):
            if low[i:j] in media.VOCABULARY:
                ways.append((best(i)[0] + 8 + 2 * (j - i) - 2 * (j - i <= 2), -i, True))
        ways.append((best(j - 1)[0] - 7, 1 - j, False))
        score, i, known = max(ways)
        return score, (*best(-i)[1], (token[-i:j], known))

    score, parts = best(n)
    if sum(len(t) for t, k in parts if k) < 0.78 * n or len(parts) < 2 or score <= 0:
        return token
    out = []
    for t, k in parts:
        if out and not k and not out[-1][1]:
            out[-1] = (out[-1][0] + t, False)
        else:
            out.append((t, k))
    return " ".join(t for t, _ in out)


def test_glued_capitals():
    assert media.segmented("CRYPTOWILLCANDGOOGLEECONOMY", media.VOCABULARY) == "CRYPTO WILL C AND GOOGLE ECONOMY"
    r = random.Random(6)
    for _ in range(3000):
        token = "".join(r.choice([*media.VOCABULARY, "x", "d", "q"]) for _ in range(r.randint(2, 7))).upper()
        assert media.segmented(token, media.VOCABULARY) == slow_cut(token)


def slow_suffixes(names):
    seen, out = set(), []
    for name in names:
        made, n = name, 2
        while made in seen and name is not None:
            made, n = f"{name} ({n})", n + 1
        seen.add(made)
        out.append(made)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_suffixes(spark, seed):
    r = random.Random(seed)
    pool = ["a", "a", "a", "b", "a (2)", "a (3)", "a (2) (2)", "a (5)", "a (1)", "a (02)", "b (2)", "a (2) (3)", "c (2)", None, "a (4) (2)", "a (4)"]
    names = ["a", "a", "a (2)", "a"] if not seed else [r.choice(pool) for _ in range(60)]
    frame = spark.createDataFrame([(i, n, "x") for i, n in enumerate(names)], "i long, name string, number string").repartition(3)
    got = [x.name for x in match.suffixed(frame, "name", "i").orderBy("i").collect()]
    assert got == slow_suffixes(names)
    assert seed or got == ["a", "a (2)", "a (2) (2)", "a (3)"]


def test_waits(spark):
    jobs = spark.createDataFrame([("m", 1, 75), ("m", 2, 60), ("m", 3, 10)], "lane string, seq long, estimate long")
    one = runtime.single_waits(jobs, F.lit(40)).orderBy("seq").collect()
    assert [(r.wait, r.total) for r in one] == [(40, 115), (115, 175), (175, 185)]
    two = runtime.slot_waits(jobs, 2).orderBy("seq").collect()
    assert [r.wait for r in two] == [0, 0, 60]


def test_labels(spark):
    frame = spark.createDataFrame([(0,), (9,), (65,), (660,), (3900,), (None,)], "s long")
    got = frame.select(runtime.duration_label(F.col("s")), runtime.short_label(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [("Now", None), ("9s", "9s"), ("1m 05s", "1m 05s"), ("11m", "11m 00s"), ("1h 05m", "65m 00s"), ("Calculating", None)]


def test_bundles(spark):
    rows = [("p", i) for i in range(10)] + [("q", i) for i in range(11)]
    got = {r.task_id: (r.bundled, r.artifacts_media, r.artifacts_music) for r in runtime.bundled(spark.createDataFrame(rows, "task_id string, n int")).collect()}
    assert got == {"p": (False, 10, 10), "q": (True, 1, 12)}


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("café one\nzwei".encode())
    (tmp_path / "b.txt").write_bytes("café".encode("latin-1"))
    lines = files.text_log(spark, str(tmp_path / "*.txt")).orderBy("file", "line_no").collect()
    assert [r.line for r in lines] == ["café one", "zwei", "café"]
    assert [r.line_no for r in lines] == [0, 1, 0]
    export = {"participants": [{"name": "x"}], "messages": [{"sender_name": "b", "timestamp_ms": 2, "content": "new"}, {"sender_name": "a", "timestamp_ms": 1, "content": "old"}]}
    (tmp_path / "e.json").write_text(json.dumps(export))
    assert [r.content for r in files.json_export(spark, str(tmp_path / "e.json")).orderBy("seq").collect()] == ["old", "new"]
    good = json.dumps({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]})
    parsed = files.json_lines(spark.createDataFrame([(good,), ("{broken",), ("  ",)], "value string")).collect()
    assert sorted(r.malformed for r in parsed) == [False, True]
    assert files.conversations_to_lines(files.json_lines(spark.createDataFrame([(good,)], "value string"))).first()[0] == good.replace(": ", ":").replace(", ", ",")
    listed = files.listed_inputs(spark.createDataFrame([(" a ",), ("# no",), ("",)], "value string")).collect()
    assert [r.value for r in listed] == ["a"]
    history = spark.createDataFrame([("v", "A")], "id string, list string")
    again = files.append_new(history, spark.createDataFrame([("v", "A"), ("v", "B"), ("v", "B")], "id string, list string"), ["id", "list"])
    assert sorted(map(tuple, again.collect())) == [("v", "A"), ("v", "B")]


def stream(spark, tmp_path, frame, made, mode="append"):
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = made(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")))
    query = out.writeStream.format("memory").queryName("out").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table("out").collect()


def test_stream_limit(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    frame = spark.createDataFrame([("k", i, t + dt.timedelta(seconds=i)) for i in range(12)] + [("k", 99, t + dt.timedelta(seconds=65))], "key string, id long, ts timestamp")
    got = {r.id: r.admitted for r in stream(spark, tmp_path, frame, live.rate_limited)}
    assert [got[i] for i in range(12)] == [True] * 10 + [False] * 2 and got[99]


def test_stream_newest(spark, tmp_path):
    frame = spark.createDataFrame([("a", 1, True, "x"), ("a", 2, True, "y"), ("b", 5, False, "z")], "key string, id long, incoming boolean, text string")
    assert [tuple(r) for r in stream(spark, tmp_path, frame, live.to_answer)] == [("a", 2, "y")]


def test_stream_estimates(spark, tmp_path):
    frame = spark.createDataFrame([("t", "Running OCR for 3 Instagram images"), ("t", "Processing 1 new posts"), ("u", "hello")], "task_id string, message string")
    got = {r.task_id: r.estimate for r in stream(spark, tmp_path, frame, live.live_estimates, "complete")}
    assert got == {"t": 225, "u": None}


def test_text_logs_in_splits(spark, tmp_path):
    """A file takes several tasks; its lines keep their numbers, and one odd byte decides for all of it."""
    texts = {"utf.txt": ["zeile é %d" % i for i in range(4000)], "latin.txt": ["ligne %d" % i for i in range(4000)]}
    texts["latin.txt"][3210] = "é"
    for name, lines in texts.items():
        (tmp_path / name).write_bytes("\n".join(lines).encode("latin-1" if name == "latin.txt" else "utf-8"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        got = files.text_log(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
        rows = got.orderBy("file", "line_no").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for name, lines in texts.items():
        assert [(r.line_no, r.line) for r in rows if r.file.endswith("/" + name)] == list(enumerate(lines))


def test_resolved_inputs(spark, tmp_path):
    made = lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)
    values = lambda **k: [r.value for r in files.resolved_inputs(spark, **k).orderBy("n").collect()]
    assert values(values=[" a ", "", "b"]) == ["a", "b"]
    assert values(path=made("x.txt", " one \n# no\n\ntwo")) == ["one", "two"]
    assert values(path=made("x.JSON", '["p ", "", "q"]')) == ["p", "q"]
    for bad in ('{"a": 1}', "[1]", '["a", 1]', '["a", null]', "no json", "[]", '[" "]'):
        with pytest.raises(ValueError):
            values(path=made("y.json", bad))
    for none in ({}, {"values": ["a"], "path": "p"}, {"values": [" "]}, {"path": made("z.txt", "# only\n")}):
        with pytest.raises(ValueError):
            values(**none)


def test_mojibake_marks(spark):
    broken = "â\x80\x9cHi 日 itâ\x80\x99sâ\x80¦"  # does not decode as a whole
    texts = [broken, "â\x80\x9cHiâ\x80\x9d", "don’t – é".encode().decode("latin-1")]
    from loomline.functions import text as T

    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.mojibake_repaired("t")).collect()]
    assert got == ['"Hi 日 it\'s...', "“Hi”", "don’t – é"]


def test_languages_shuffle_no_trigrams(spark):
    from loomline.operators import language

    docs = spark.createDataFrame([(1, "ab ab ab", "x"), (2, "cd cd", "y"), (3, "", "y"), (4, None, "x"), (5, "ab \U00010400\U00010401", None), (5, "??", None)], "doc_id int, text string, lang string")
    assert docs.where("doc_id = 5").select(language.trigrams(F.col("text"))).first()[0] == [" ab", "ab ", "b \U00010428", " \U00010428\U00010429", "\U00010428\U00010429 "]
    got = language.identified(docs.select("doc_id", "text"), language.learnt(docs.where("lang is not null")))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert [x.language for x in got.orderBy("doc_id", F.desc("text")).collect()] == ["x", "y", None, None, "x", None]


def test_languages_learn_from_every_text(spark, monkeypatch):
    import math
    from collections import Counter

    import pandas as pd

    from loomline.operators import language

    # 27,000 texts with a language, more than the 20,000 that a model once took; one language has a single text
    lang = F.when(F.col("id") == 7, "w").otherwise(F.element_at(F.array(F.lit("x"), F.lit("y"), F.lit("z"), F.lit(None)), (F.col("id") % 4 + 1).cast("int")))
    text = F.when(F.col("id") % 1000 != 3, F.translate(F.concat(F.col("id") * 37, F.lit(" "), F.col("id")), "0123456789", "abcdeé\u0301\U00010428日Z"))
    docs = spark.range(36_000).select(F.col("id").alias("doc_id"), text.alias("text"), lang.alias("lang")).cache()
    count = {}
    for row in docs.where("lang is not null").select("lang", F.explode(language.trigrams(F.col("text"))).alias("gram")).collect():
        of = count.setdefault(row.gram, dict.fromkeys("wxyz", 0))
        of[row.lang] += 1
    kept = sorted(count, key=lambda g: (-sum(count[g].values()), g.encode()))[:700]
    size = {x: sum(count[g][x] + 0.5 for g in kept) for x in "wxyz"}
    got = {(r.gram, r.lang): r.weight for r in language.learnt(docs, grams=700).collect()}
    assert len(count) > 700 and set(got) == {(g, x) for g in kept for x in "wxyz"}
    assert all(abs(w - math.log((count[g][x] + 0.5) / size[x])) < 1e-9 for (g, x), w in got.items())

    batch = pd.DataFrame({"lang": ["x", "y", "x", "x"], "t": [" abab ", "  ", " a\U00010428 ", " b b " * 9]})
    want = Counter((x, t[i : i + 3]) for x, t in zip(batch["lang"], batch["t"]) for i in range(len(t) - 2))
    for size, n_pieces in ((1 << 20, 2), (4, 4)):
        monkeypatch.setattr(language, "PIECE", size)
        pieces = list(language.counted(iter([batch])))
        assert len(pieces) == n_pieces and pd.concat(pieces).groupby(["lang", "gram"])["n"].sum().to_dict() == want


def test_ocr_wraps_once_and_spaces_twice(spark):
    import textwrap

    r = random.Random(2)
    for _ in range(3000):
        line = r.choice([" ", " ", "  ", "\x0b"]).join("W" * r.choice([1, 2, 5, 9, 33, 34, 35, 50]) for _ in range(r.randint(1, 9)))
        assert media.wrapped(line) == ([line] if len(line) <= 34 else textwrap.wrap(line, 34, break_long_words=False, break_on_hyphens=False))
    parts = ["A", "b", " ", "  ", "\n", "\r\n", "\t", ",", ".", "!", "\u00a0", "\u2003", "SWIPETOWATCH", "\u017fwipe to watch", "LIN\u212aINBIO", "OPENAI", "THATHASNEVER"]
    frame = spark.createDataFrame([("".join(r.choice(parts) for _ in range(r.randint(0, 12))),) for _ in range(2000)], "t string")
    once = frame.select(T.spaced(F.col("t")).alias("t"))
    assert once.where(~T.spaced(F.col("t")).eqNullSafe(F.col("t"))).count() == 0
    every = T.replaced(F.col("t"), *[("(?iU)" + p, by) for p, by in T.PHRASE_RULES])
    fixed = once.select(T.phrases_repaired(F.col("t")).alias("t"), every.alias("want"))
    assert fixed.where("t <> want").count() == 0
    assert fixed.where(T.spaced(F.col("t")) != F.col("t")).count() == 0
    assert len(T.PHRASE_PARTS) == len(T.PHRASE_RULES) - 1  # two rules share one
