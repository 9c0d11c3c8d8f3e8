"""Chat logs and exports: parsing, sessions, context windows, filters. DataFrame to DataFrame or Column to Column.

Messages are rows of (chat, seq, ts, sender, ...); seq gives the order that the source had. Windows are partitioned by
chat, so the one shuffle that a chain of these operators needs is by chat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.operators.folds import folded_in_pieces

HOUR = 3_600_000_000  # microseconds

# Notices that a text log mixes with messages, and the form of a message's first line. Notices are looked for
# anywhere, so of a name before a verb (or after it) the character next to the blank is enough; whole names would be
# tried from every place of a long line.
SYSTEM_PATTERNS = (
    "Messages and calls are end-to-end encrypted",
    "You deleted this message",
    "This message was deleted",
    r"You sent ₹[\d,]+\.?\d* to",
    r"You received ₹[\d,]+\.?\d* from",
    r"[^:]\schanged the subject to",
    r"[^:]\schanged this group's icon",
    r"[^:]\sadded\s[^:]",
    r"[^:]\sremoved\s[^:]",
    r"[^:]\sleft",
    r"[^:]\sjoined using this group's invite link",
    "Security code changed",
    "Missed voice call",
    "Missed video call",
)
HEADER = r"(?U)^(\d{1,2}[/-]\d{1,2}[/-]\d{2,4},?\s+\d{1,2}:\d{2}(?::\d{2})?\s?(?:[aApP][mM])?)\s*[-–—]\s*([^:]+):\s+(.+)"


def is_system(body: Column) -> Column:
    """Whether a notice's wording occurs anywhere."""
    return F.rlike(body, F.lit("(?iU)" + "|".join(SYSTEM_PATTERNS)))


def log_timestamp(stamp: Column) -> Column:
    """Day first; month first only where a slashed date with a two-digit year and a 12-hour clock fails day first.

    Two-digit years from 69 are of the last century.
    """
    s = F.replace(F.regexp_replace(F.trim(stamp), r"(?U)\s+", " "), F.lit(","), F.lit(""))
    form = r"^(\d{1,2})([/-])(\d{1,2})[/-](\d{2,4}) (\d{1,2}):(\d{2})(?::(\d{2}))? ?([aApP][mM])?$"

    def read(parts: Column) -> Column:
        a, sep, b, year, hour, minute, second, half = (F.get(parts, F.lit(i)) for i in range(8))
        short = F.length(year) == 2
        full = F.when(short, F.when(year.cast("int") >= 69, 1900).otherwise(2000) + year.cast("int")).otherwise(year.cast("int"))
        h = hour.cast("int")
        clock = F.when(half == "", h).when(h.between(1, 12), h % 12 + F.when(F.lower(half) == "pm", 12).otherwise(0))
        time = F.concat(F.lpad(clock.cast("string"), 2, "0"), F.lit(":"), minute, F.lit(":"), F.when(second == "", "00").otherwise(second))

        def made(day: Column, month: Column) -> Column:
            date = F.concat(F.lpad(full.cast("string"), 4, "0"), F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0"))
            return F.try_to_timestamp(F.concat(date, F.lit(" "), time), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")

        day_first = F.when((sep == "/") | ((half != "") & (second == "")), made(a, b))
        return F.coalesce(day_first, F.when((sep == "/") & short & (half != "") & (second == ""), made(b, a)))

    # one look takes all parts
    parts = F.split(F.regexp_replace(s, form, "$1|$2|$3|$4|$5|$6|$7|$8"), r"\|", -1)
    return T.evaluated_once(F.when(F.rlike(s, F.lit(form)), parts), read)


def assembled(lines: DataFrame) -> DataFrame:
    """file, seq, ts, sender, content of each message from lines (file, line_no, line).

    A header line opens a message and other lines are added to the open one; a notice or an unreadable time closes it.
    """
    line = T.unicode_cleaned(F.col("line"))
    parts = [F.when(F.col("head"), F.regexp_extract("line", HEADER, i)) for i in (1, 2, 3)]
    clean = lines.select("file", "line_no", line.alias("line")).withColumn("head", F.rlike("line", F.lit(HEADER)))
    head = clean.select("*", *[p.alias(k) for p, k in zip(parts, ("stamp", "sender", "body"))])
    head = head.withColumn("ts", F.when(F.col("head") & ~is_system(F.col("body")), log_timestamp(F.col("stamp"))))
    order = Window.partitionBy("file").orderBy("line_no")
    island = head.withColumn("seq", F.sum(F.col("head").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    part = F.when(F.col("head"), F.col("body")).otherwise(F.col("line"))
    grouped = island.where("seq > 0").groupBy("file", "seq").agg(
        F.max(F.when(F.col("ts").isNotNull(), F.struct("ts", F.trim("sender").alias("sender")))).alias("h"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", part.alias("t")))), lambda x: x["t"]), "\n").alias("content"),
    )
    return grouped.where("h is not null").select("file", "seq", "h.ts", "h.sender", "content")


def message_type(content: Column, link: Column, shared: Column, has_photo: Column) -> Column:
    """Kind of an exported message; the first rule that holds wins. shared: whether it shares something."""
    l = F.coalesce(F.lower(link), F.lit(""))
    c = F.coalesce(content, F.lit(""))
    return (
        F.when(shared & F.contains(l, F.lit("reel")), "reel_share")
        .when(shared & (F.contains(l, F.lit("giphy.com")) | F.contains(l, F.lit("gif"))), "gif")
        .when(shared, "post_share")
        .when(has_photo & (c == ""), "photo")
        .when(F.contains(c, F.lit("Reacted")) | F.contains(c, F.lit("Liked a message")), "reaction")
        .when(F.trim(c) == "", "empty")
        .when(F.contains(c, F.lit("sent an attachment")), "attachment_text")
        .otherwise("text")
    )


def export_valid(kind: Column, clean: Column) -> Column:
    """Whether an exported message counts: a text by its length and words; posts and photos also without one."""
    text = F.coalesce(clean, F.lit(""))
    fine = (F.length(F.regexp_replace(text, r"(?U)^\s+|\s+$", "")) >= 2) & (F.length(text) <= 2000) & F.rlike(text, F.lit(T.WORD))
    return F.when(kind == "text", fine).otherwise(kind.isin("post_share", "photo"))


def rejection(clean: Column) -> Column:
    """Why a cleaned first line is no message (null: it is one)."""
    return (
        F.when(clean == "[MEDIA_SENT]", "media_only")
        .when((F.trim(clean) == "") | (F.length(clean) < 2), "too_short")
        .when(F.length(clean) > 2000, "too_long")
        .otherwise(T.quality_log(clean)["reason"])
    )


def _micros(end: str, start: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, {start}, {end})")


def sessions(messages: DataFrame, chat: str = "chat", seq: str = "seq", ts: str = "ts", sender: str = "sender", hard: float = 2.0, soft: float = 4.0) -> DataFrame:
    """messages with gap_us, burst and session: a gap over hard hours starts one, over soft hours within a burst.

    A burst is a third message of one sender in a row. Sessions count from 0 in each chat.
    """
    order = Window.partitionBy(chat).orderBy(seq)
    lagged = messages.withColumn("_t", F.lag(ts).over(order)).withColumn("gap_us", _micros(ts, "_t"))
    burst = F.coalesce((F.col(sender) == F.lag(sender, 1).over(order)) & (F.col(sender) == F.lag(sender, 2).over(order)), F.lit(False))
    over = F.when(F.col("burst"), F.col("gap_us") > int(soft * HOUR)).otherwise(F.col("gap_us") > int(hard * HOUR))
    cut = F.coalesce(over, F.lit(False)).cast("long")
    return lagged.drop("_t").withColumn("burst", burst).withColumn("session", F.sum(cut).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def turn_sessions(messages: DataFrame, chat: str = "chat", seq: str = "seq", ts: str = "ts", sender: str = "sender", hard: float = 2.0) -> DataFrame:
    """messages with session: a gap over hard hours starts one, unless one sender's last three messages of the session
    wait for another's answer."""
    order = Window.partitionBy(chat).orderBy(seq)
    step = messages.withColumn("_t", F.lag(ts).over(order)).withColumn("_gap", _micros(ts, "_t"))
    s = [F.col(sender), *[F.lag(sender, i).over(order) for i in (1, 2, 3)]]
    gaps = [F.col("_gap"), *[F.lag("_gap", i).over(order) for i in (1, 2)]]
    most = int(hard * HOUR)
    waits = (s[1] == s[2]) & (s[2] == s[3]) & (s[0] != s[1]) & (gaps[1] <= most) & (gaps[2] <= most)
    cut = F.coalesce((gaps[0] > most) & ~F.coalesce(waits, F.lit(False)), F.lit(False)).cast("long")
    return step.withColumn("session", F.sum(cut).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_t", "_gap")


def session_stats(messages: DataFrame, chat: str = "chat", ts: str = "ts", sender: str = "sender") -> DataFrame:
    """Per chat and session: messages, senders, duration_us, and whether it is valid (2 messages, 2 senders, 12 hours)."""
    got = messages.groupBy(chat, "session").agg(
        F.count(F.lit(1)).alias("messages"), F.countDistinct(sender).alias("senders"), F.min(ts).alias("_a"), F.max(ts).alias("_b")
    )
    got = got.withColumn("duration_us", _micros("_b", "_a")).drop("_a", "_b")
    return got.withColumn("valid", (F.col("messages") >= 2) & (F.col("senders") >= 2) & (F.col("duration_us") <= 12 * HOUR))


def contexts(messages: DataFrame, target: Column, chat: str = "chat", seq: str = "seq", ts: str = "ts", sender: str = "sender", item: str = "seq") -> DataFrame:
    """Target messages of sessions() with k, context (items of the last k messages of the session so far) and the
    running checks; at least 3 messages must come before.

    k follows the mean of the chat's last five gaps: 15 below 5 minutes, 5 above 30, else 10.
    """
    whole = Window.partitionBy(chat).orderBy(seq)
    own = Window.partitionBy(chat, "session").orderBy(seq)
    so_far = own.rowsBetween(Window.unboundedPreceding, 0)
    mean = F.avg("gap_us").over(whole.rowsBetween(-4, 0))
    k = F.when(mean < HOUR / 12, 15).when(mean > HOUR / 2, 5).otherwise(10)
    rows = (
        messages.withColumn("k", k)
        .withColumn("_before", F.collect_list(item).over(own.rowsBetween(-15, -1)))
        .withColumn("so_far", F.row_number().over(own) - 1)
        .withColumn("_two", F.min(sender).over(so_far) != F.max(sender).over(so_far))
        .withColumn("_first", F.first(ts).over(so_far))
    )
    rows = rows.withColumn("elapsed_us", _micros(ts, "_first")).withColumn("context", F.slice("_before", -F.least("k", F.size("_before")), F.least("k", F.size("_before"))))
    ok = target & (F.col("so_far") >= 3) & F.col("_two") & (F.col("elapsed_us") <= 12 * HOUR)
    return rows.where(ok).drop("_before", "_first", "_two")


def adaptive_length(mean_chars: Column, per_minute: Column) -> Column:
    """Context length of a session: 15 for long or slow ones, 7 for short and quick ones, else 10."""
    return F.when((mean_chars > 100) | (per_minute < 0.5), 15).when((mean_chars < 30) & (per_minute > 2), 7).otherwise(10)


def without_share_replies(messages: DataFrame, is_share: Column, chars: Column, chat: str = "chat", ms: str = "ts_ms") -> DataFrame:
    """messages without those under 50 characters that follow a share of the same chat by 1 to 299 999 ms."""
    near = Window.partitionBy(chat).orderBy(ms).rangeBetween(-299_999, -1)
    shares = F.sum(is_share.cast("long")).over(near)
    return messages.withColumn("_shares", F.coalesce(shares, F.lit(0))).where(is_share | ~((F.col("_shares") > 0) & (chars < 50))).drop("_shares")


def reciprocal(partner: Column, response: Column, high: int = 150, low: int = 15, ratio: float = 0.2) -> Column:
    """Whether a response to partner's last messages (an array) is worth its input: false for lazy ones."""
    said = F.array_join(F.slice(partner, -F.least(F.lit(3), F.greatest(F.size(partner), F.lit(1))), F.lit(3)), " ")

    def judged(e: Column) -> Column:
        lazy = (e["i"] > high) & (e["o"] < low) & (e["o"] / e["i"] < ratio)
        return e["q"] | ~lazy

    energies = F.struct(T.energy(said).alias("i"), T.energy(response).alias("o"), T.is_question(said).alias("q"))
    return F.when(F.size(partner) == 0, True).otherwise(T.evaluated_once(energies, judged))


def rate_limited(rows: DataFrame, key: str, ts: str, order: str, most: int = 10, seconds: int = 60) -> DataFrame:
    """rows (key, order, ts) with admitted: at most so many admitted ones of a key within the last seconds.

    Refused submissions do not count, so each key is folded in order, with the last admitted times as state, in pieces
    that begin where nothing was submitted for longer than the seconds before.
    """
    from collections import deque

    timed = rows.select(key, order, F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})").alias("t"))
    span = seconds * 1_000_000

    def step(held: deque, row) -> bool:
        while held and row.t - held[0] > span:
            held.popleft()
        if len(held) >= most:
            return False
        held.append(row.t)
        return True

    idle = F.col("t") - F.lag("t").over(Window.partitionBy(key).orderBy("t", order)) > span
    return folded_in_pieces(timed, key, ["t", order], idle, deque, step, "admitted boolean").drop("t", "fresh")
