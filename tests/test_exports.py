"""Exports: sessions by meaning against plain loops, file types against the standard library, odd payloads."""

import mimetypes
import random
import urllib.parse
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomline.operators import exports

NEAR, FAR = [1.0, 0.0], [0.0, 1.0]
START = datetime(2024, 1, 1)


def talk(spark, rows):
    """rows: hours, sender, chars, vector; one chat."""
    data = [(1, i, START + timedelta(hours=h), s, c, v) for i, (h, s, c, v) in enumerate(rows)]
    return spark.createDataFrame(data, "chat long, seq long, ts timestamp_ntz, sender string, chars long, vector array<float>")


def sessions(df):
    return [r.session for r in df.orderBy("seq").collect()]


def test_drift_cuts_on_meaning(spark):
    got = exports.drift_sessions(talk(spark, [(0, "a", 30, NEAR), (0.1, "me", 30, NEAR), (0.2, "me", 10, FAR), (0.3, "me", 30, FAR), (0.4, "me", 30, NEAR), (3, "a", 30, None), (3.1, "me", 30, NEAR)]), "me")
    assert sessions(got) == [0, 0, 0, 1, 2, 3, 3]


def test_drift_waits_longer_in_a_burst(spark):
    got = exports.drift_sessions(talk(spark, [(0, "a", 0, None), (1, "a", 0, None), (4, "a", 0, None), (9, "a", 0, None), (12, "b", 0, None)]), "me")
    assert sessions(got) == [0, 0, 0, 1, 2]


def test_topics_bridge_gaps_once_they_last(spark):
    steady = [(0, "a", 30, NEAR), (1.5, "b", 30, NEAR), (3, "a", 30, NEAR), (5.5, "b", 30, NEAR), (9, "a", 30, NEAR), (10.5, "b", 30, FAR), (13, "b", 30, FAR)]
    assert sessions(exports.topic_sessions(talk(spark, steady))) == [0, 0, 0, 0, 1, 2, 3]
    assert sessions(exports.topic_sessions(talk(spark, [(0, "a", 30, NEAR), (1.5, "b", 5, FAR), (2, "a", 30, FAR)]))) == [0, 0, 0]


def test_topics_wait_for_an_answer(spark):
    burst = [(0, "a", 0, None), (0.1, "a", 0, None), (0.2, "a", 0, None)]
    assert sessions(exports.topic_sessions(talk(spark, [*burst, (9, "b", 0, None), (20, "b", 0, None)]))) == [0, 0, 0, 0, 1]
    assert sessions(exports.topic_sessions(talk(spark, [*burst, (9, "a", 0, None), (20, "b", 0, None)]))) == [0, 0, 0, 1, 2]
    assert sessions(exports.topic_sessions(talk(spark, [*burst[1:], (9, "b", 0, None)]))) == [0, 0, 1]


def plain_topics(rows):
    """The rule over one chat's whole list: each session is kept as a list."""
    out, session, number, topic, times = [], [], 0, None, 0
    for i, (hours, sender, chars, vector) in enumerate(rows):
        meant = vector if chars >= 25 else None
        gap = hours - rows[i - 1][0] if i else 0
        same = topic is not None and meant is not None and exports._cosine(topic, meant) >= 0.4
        fresh = False
        if session and gap > 2:
            if len(session) >= 3 and len({s for s in session[-3:]}) == 1 and sender != session[-1]:
                session.append(sender)
                out.append(number)
                continue
            fresh = True
            if topic is not None and meant is not None and gap <= 3:
                times = times + 1 if same else 0
                fresh = not (same and times >= 3)
            if fresh:
                topic = None
        elif session and gap > 1 and topic is not None and meant is not None:
            fresh = not same
            times += 1
        if fresh:
            session, number, times = [], number + 1, 0
        session.append(sender)
        out.append(number)
        topic = meant or topic
    return out


def plain_drift(rows):
    out, number, recent = [], 0, []
    for i, (hours, sender, chars, vector) in enumerate(rows):
        meant = vector if chars >= 25 else None
        if i:
            burst = i > 1 and rows[i - 1][1] == rows[i - 2][1] == sender
            near = [exports._cosine(v, meant) for v in recent[-3:] if v] if meant and sender == "me" else []
            if hours - rows[i - 1][0] > (4 if burst else 2) or near and sum(near) / len(near) < 0.4:
                number, recent = number + 1, []
        recent.append(meant)
        out.append(number)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_sessions_in_pieces(spark, seed):
    r, at, rows, who = random.Random(seed), 0.0, [], "a"
    for _ in range(400):
        at += r.choice([0.25, 0.5, 1.5, 1.5, 2.5, 3.5, 4.5, 8])
        who = who if r.random() < 0.6 else r.choice(["a", "b", "me"])
        rows.append((at, who, r.choice([5, 30, 30, 30]), r.choice([NEAR, NEAR, FAR, [0.75, 0.5], None])))
    assert sessions(exports.topic_sessions(talk(spark, rows))) == plain_topics(rows)
    assert sessions(exports.drift_sessions(talk(spark, rows), "me")) == plain_drift(rows)


def test_no_messages(spark):
    assert sessions(exports.drift_sessions(talk(spark, []), "me")) == sessions(exports.topic_sessions(talk(spark, []))) == []


def test_types_and_links_as_the_standard_library(spark):
    names = ["a.mp3", "b.tar.gz", ".mp3", "..mp3", "a..MP3", "x.tgz", "gz", "q.gz", "p.html.br", "ü x/ä.PDF", "a+b~c*d.json", "", "n.unknown"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", exports.content_type_of(F.col("n")).alias("t"), exports.quoted(F.col("n")).alias("q")).collect()
    known = mimetypes.MimeTypes(filenames=())
    assert [(r.t, r.q) for r in rows] == [(known.guess_type(n)[0] or exports.UNKNOWN_TYPE, urllib.parse.quote(n)) for n in names]


def test_payloads(spark):
    texts = ['{"title":" a ","duration_ms":"7"}', '{"title":null}', "[]", None, "", '{"title":"t","duration_ms":1.5e}', '{"title":"t","artist":null,"duration_ms":9.0}']
    got = spark.createDataFrame([(x,) for x in texts], "x string").select(exports.track_of(F.col("x")).alias("t")).select("t.*").collect()
    assert [r.problem for r in got] == [None, "missing_title", "invalid", "invalid", "invalid", "invalid", None]
    assert (got[0].title, got[0].duration_ms, got[6].duration_ms, got[6].artist) == ("a", 7, 9, "")


def test_reply_contexts_of_blank_and_outgoing_chats(spark):
    rows = [(1, 1, False, "hi"), (1, 2, True, ""), (1, 3, False, None), (2, 1, True, "x"), (3, 1, False, "")]
    got = exports.reply_contexts(spark.createDataFrame(rows, "chat long, seq long, outgoing boolean, text string"), 1).collect()
    assert {r.chat: [tuple(m) for m in r.context] for r in got} == {1: [], 3: []}
