"""Exports of chats and of media posts: sessions by meaning, contexts by session, post texts, artifact links."""

from __future__ import annotations

import mimetypes

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.operators.chat import HOUR, adaptive_length
from loomline.operators.folds import folded_in_pieces

# Shortest text with a meaning, least cosine of one topic, messages a topic must last, and the texts that
# stand around posts.
MEANT = 25
ALIKE = 0.4
LASTING = 3
NO_TEXT = "[No text extracted]"
UNKNOWN_TYPE = "application/octet-stream"


def _cosine(a, b) -> float:
    size = float(np.linalg.norm(a)) * float(np.linalg.norm(b))
    return float(np.dot(a, b)) / size if size else 0.0


def _micros_since_epoch(ts: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def _numbered(cuts: DataFrame) -> DataFrame:
    """chat, seq, session of rows that say whether they start one."""
    so_far = Window.partitionBy("chat").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return cuts.select("chat", "seq", F.count_if(F.col("fresh") | F.col("cut")).over(so_far).alias("session"))


def drift_sessions(messages: DataFrame, target: str, hard: float = 2.0, soft: float = 4.0) -> DataFrame:
    """chat, seq and session of messages (chat, seq, ts, sender, chars, vector), counted from 0 in each chat.

    The gaps of chat.sessions() start a session, and so does a message of target whose vector is, on average, less than
    ALIKE to those of the session's last LASTING messages. Messages under MEANT characters or without a vector count as
    no meaning; without any to compare with, nothing drifts. A cut depends on the cuts before it: a fold in order, in
    pieces that begin at the gaps that start a session in any case.
    """
    order = Window.partitionBy("chat").orderBy("seq")
    rows = messages.select("chat", "seq", "sender", "chars", _micros_since_epoch("ts").alias("t"), F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    rows = rows.withColumn("before", F.lag("sender").over(order))

    def start() -> dict:
        return {"t": None, "said": None, "recent": []}

    def step(state: dict, row) -> bool:
        vector = np.asarray(row.vector) if row.vector is not None and row.chars >= MEANT else None
        cut = False
        if state["t"] is not None:
            burst = state["said"] == [row.sender, row.sender]
            cut = row.t - state["t"] > (soft if burst else hard) * HOUR
            if not cut and row.sender == target and vector is not None:
                near = [_cosine(vector, v) for v in state["recent"] if v is not None]
                cut = bool(near) and sum(near) / len(near) < ALIKE
            if cut:
                state["recent"] = []
        state["t"] = row.t
        state["said"] = [row.before, row.sender]
        state["recent"] = [*state["recent"], vector][-LASTING:]
        return cut

    sure = F.col("t") - F.lag("t").over(order) > max(hard, soft) * HOUR
    return _numbered(folded_in_pieces(rows, "chat", ["seq"], sure, start, step, "cut boolean"))


def topic_sessions(messages: DataFrame, hard: float = 2.0, soft: float = 3.0) -> DataFrame:
    """chat, seq and session of messages (chat, seq, ts, sender, chars, vector), counted from 0 in each chat.

    Over hard hours a session ends, unless its last LASTING messages are one sender's and wait for this answer of
    another's, or the gap is at most soft hours and the topic goes on for the LASTING-th time; over half of hard it ends
    if the topic changes. The topic goes on at a cosine of ALIKE or more with the last vector, for which an answer that
    was waited for does not count; messages under MEANT characters or without a vector neither go on nor change it.
    Sessions are folded in order, in pieces that begin at the gaps that end one in any case.
    """
    order = Window.partitionBy("chat").orderBy("seq")
    rows = messages.select("chat", "seq", "sender", "chars", _micros_since_epoch("ts").alias("t"), F.transform("vector", lambda x: x.cast("double")).alias("vector"))

    def start() -> dict:
        return {"t": None, "topic": None, "times": 0, "said": []}

    def step(state: dict, row) -> bool:
        vector = np.asarray(row.vector) if row.vector is not None and row.chars >= MEANT else None
        gap = 0 if state["t"] is None else row.t - state["t"]
        both = vector is not None and state["topic"] is not None
        long, said = gap > hard * HOUR, state["said"]
        answers = long and len(said) == LASTING and len(set(said)) == 1 and row.sender != said[0]
        cut = False
        if gap > hard / 2 * HOUR and not answers:
            same = both and _cosine(state["topic"], vector) >= ALIKE
            judged = both and (gap <= soft * HOUR or not long)
            if judged:
                state["times"] = state["times"] + 1 if same else 0
            cut = not (judged and same and state["times"] >= LASTING) if long else judged and not same
            if cut:
                state.update(topic=None if long else state["topic"], times=0, said=[])
        if vector is not None and not answers:
            state["topic"] = vector
        state["t"] = row.t
        state["said"] = [*state["said"], row.sender][-LASTING:]
        return cut

    who = [F.lag("sender", i).over(order) for i in range(1, LASTING + 1)]
    awaited = who[0].eqNullSafe(who[1]) & who[1].eqNullSafe(who[2]) & ~F.col("sender").eqNullSafe(who[0])
    sure = (F.col("t") - F.lag("t").over(order) > max(hard, soft) * HOUR) & ~awaited
    return _numbered(folded_in_pieces(rows, "chat", ["seq"], sure, start, step, "cut boolean"))


def session_contexts(messages: DataFrame, target: Column, least: int = 3) -> DataFrame:
    """Target messages of (chat, session, seq, ts, chars, item) with k and context: the session's last k items before.

    k is the session's adaptive_length(); a span under a minute counts as one. At least so many must come before.
    """
    whole = Window.partitionBy("chat", "session")
    before = whole.orderBy("seq").rowsBetween(-15, -1)
    minutes = F.expr("timestampdiff(MICROSECOND, _from, _to)") / 60_000_000
    rows = messages.withColumns({"_from": F.min("ts").over(whole), "_to": F.max("ts").over(whole), "_n": F.count(F.lit(1)).over(whole), "_chars": F.sum("chars").over(whole), "_before": F.collect_list("item").over(before)})
    rows = rows.withColumn("k", adaptive_length(F.col("_chars") / F.col("_n"), F.col("_n") / F.greatest(minutes, F.lit(1.0))))
    took = F.least("k", F.size("_before"))
    return rows.withColumn("context", F.slice("_before", -took, took)).where(target & (F.size("_before") >= least)).drop("_from", "_to", "_n", "_chars", "_before")


def reply_contexts(messages: DataFrame, pairs: int = 10) -> DataFrame:
    """chat and context (role, content) of the last 2 * pairs messages (chat, seq, outgoing, text), oldest first and
    without blank ones, of the chats whose last message came in."""
    newest = messages.withColumn("_n", F.row_number().over(Window.partitionBy("chat").orderBy(F.desc("seq")))).where(F.col("_n") <= 2 * pairs)
    said = F.struct("seq", F.when(F.col("outgoing"), "assistant").otherwise("user").alias("role"), F.col("text").alias("content"))
    each = F.array_sort(F.collect_list(F.when(F.coalesce("text", F.lit("")) != "", said)))
    got = newest.groupBy("chat").agg(each.alias("_c"), F.max_by("outgoing", "seq").alias("_out"))
    return got.where(~F.coalesce("_out", F.lit(False))).select("chat", F.transform("_c", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("context"))


def track_of(payload: Column) -> Column:
    """A chosen track's JSON as title, artist, album, image_url, duration_ms, with problem: invalid, missing_title or null.

    Texts are trimmed and "" where they are missing; so is 0 for the duration. A duration that is no whole number, and a
    text that is no JSON object, are invalid.
    """
    names = ("title", "artist", "album", "image_url")
    read = F.from_json(payload, ", ".join(f"{n} STRING" for n in (*names, "duration_ms", "_bad")), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    told = F.coalesce(F.nullif(F.trim(read["duration_ms"]), F.lit("")), F.lit("0"))
    length = told.try_cast("double").cast("bigint")
    broken = payload.isNull() | read.isNull() | read["_bad"].isNotNull() | ~F.rlike(told, F.lit(r"^-?\d+(\.\d+)?$")) | length.isNull()
    fields = [F.trim(F.coalesce(read[n], F.lit(""))) for n in names]
    problem = F.when(broken, "invalid").when(fields[0] == "", "missing_title")
    return F.struct(*[f.alias(n) for f, n in zip(fields, names)], F.coalesce(length, F.lit(0)).alias("duration_ms"), problem.alias("problem"))


def media_text(entries: Column) -> Column:
    """Post media (pos, kind, text), an array in order, as one text with a numbered header each."""
    block = lambda e: F.concat(
        F.lit("--- MEDIA "), (e["pos"] + 1).cast("string"), F.lit(": "), F.upper(F.coalesce(e["kind"], F.lit("unknown"))), F.lit(" ---\n"), F.coalesce(F.nullif(e["text"], F.lit("")), F.lit(NO_TEXT))
    )
    return F.regexp_replace(F.array_join(F.transform(entries, block), "\n\n"), r"(?U)^\s+|\s+$", "")


def heard_and_seen(audio: Column, seen: Column) -> Column:
    """A post's transcript and its texts in pictures (an array in order), where there are any."""
    texts = F.filter(seen, lambda t: t != "")
    heard = F.when(audio != "", F.concat(F.lit("--- AUDIO ---\n"), audio, F.lit("\n")))
    return F.concat_ws("\n", heard, F.when(F.size(texts) > 0, F.concat(F.lit("--- VISUAL ---\n"), F.array_join(texts, "\n\n"))))


def post_block(link: Column, kind: Column, caption: Column, text: Column) -> Column:
    """A post's link, type and caption (if it has one), a rule of 40 and its text."""
    head = F.concat_ws("\n", F.concat(F.lit("Post: "), link), F.concat(F.lit("Type: "), kind), F.when(caption != "", F.concat(F.lit("Caption: "), caption)), F.lit("-" * 40))
    return F.concat(head, F.lit("\n"), text, F.lit("\n"))


def content_type_of(name: Column) -> Column:
    """The MIME type of a file name by the standard library's table; a suffix of compression counts as none."""
    known = mimetypes.MimeTypes(filenames=())
    table = lambda d: F.create_map(*[F.lit(x) for item in sorted(d.items()) for x in item])
    end = r"(?s)^\.*[^.].*(\.[^.]*)$"
    long = {short: full[: full.rindex(".")] for short, full in known.suffix_map.items()}
    last = F.regexp_extract(name, end, 1)
    packed = last.isin(*known.encodings_map)
    bare = F.when(packed, F.regexp_extract(F.substr(name, F.lit(1), F.length(name) - F.length(last)), end, 1)).otherwise(last)
    suffix = F.coalesce(F.element_at(table(long), last), bare)
    types = table(known.types_map[1])
    return F.coalesce(F.element_at(types, suffix), F.element_at(types, F.lower(suffix)), F.lit(UNKNOWN_TYPE))


def quoted(path: Column) -> Column:
    """A path for links: UTF-8 octets in percent form, but for letters, digits, _ . - ~ and the slash."""
    got = F.url_encode(path)
    for form, plain in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        got = F.replace(got, F.lit(form), F.lit(plain))
    return got
