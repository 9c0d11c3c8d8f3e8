"""Sessions of message streams by the batch rules, with event-time timers.

A chat's messages wait in state until the watermark has passed them, so that late ones find their place; then they are
taken in order, each with the session that the batch operators give it. A closed session is reported once no message
can join it any more: when the next one has begun, or when the watermark has passed its end by the larger gap.

Chats are dealt over a fixed number of groups by a hash. A group is one key of the state: its tables hold the messages
that wait, the last three of each chat with its session, and the open sessions by sender, as Arrow bytes. So the calls
to the state store grow with groups and batches and not with chats, and the rules are reckoned in arrays.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomline.streaming.state import with_states

HOUR = 3_600_000_000  # microseconds
GROUPS, NO_CHAT = 1024, -1
MESSAGES = "chat long, id long, t long, gap_us long, burst boolean, session long"
SESSIONS = "chat long, session long, first_us long, last_us long, messages long, senders long"
WAITING = pa.schema({"chat": pa.int64(), "t": pa.int64(), "id": pa.int64(), "sender": pa.string()})
LAST = pa.schema({"chat": pa.int64(), "t": pa.int64(), "sender": pa.string(), "session": pa.int64()})
OPEN = pa.schema({"chat": pa.int64(), "session": pa.int64(), "sender": pa.string(), "first_us": pa.int64(), "last_us": pa.int64(), "messages": pa.int64()})


def _packed(rows: pd.DataFrame, schema: pa.Schema) -> tuple[bytes]:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, schema) as writer:
        writer.write_table(pa.Table.from_pandas(rows, schema, preserve_index=False))
    return (out.getvalue().to_pybytes(),)


def _unpacked(values: Iterable[tuple], schema: pa.Schema) -> pd.DataFrame:
    return pa.concat_tables([schema.empty_table(), *[pa.ipc.open_stream(bytes(v[0])).read_all() for v in values]]).to_pandas()


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def ruled(last: pd.DataFrame, ready: pd.DataFrame, hard: int, soft: int | None) -> tuple[pd.DataFrame, pd.DataFrame]:
    """ready (WAITING) in order with gap_us, burst and session, and what LAST is after them.

    The rules look back three messages, so the last three of a chat stand before its new ones.
    """
    old = last["chat"].isin(ready["chat"])
    ready = ready.sort_values(["chat", "t", "id"], kind="stable")
    rows = pd.concat([last[old].assign(id=0, new=False), ready.assign(session=0, new=True)], ignore_index=True).sort_values("chat", kind="stable", ignore_index=True)
    chat, t, new, held = (rows[c].to_numpy() for c in ("chat", "t", "new", "session"))
    who, at = pd.factorize(rows["sender"])[0], np.arange(len(rows))
    other = chat[1:] != chat[:-1]
    start = np.maximum.accumulate(np.where(np.r_[True, other], at, 0))
    end = np.minimum.accumulate(np.where(np.r_[other, True], at, len(rows))[::-1])[::-1]
    place = at - start  # a look back of k counts from place k on
    who1, who2, who3 = (np.roll(who, k) for k in (1, 2, 3))
    gap = t - np.roll(t, 1)
    burst = (place >= 2) & (who >= 0) & (who == who1) & (who == who2)
    if soft is not None:
        cut = gap > np.where(burst, soft, hard)
    else:  # one sender's last three messages of the session wait for another's answer
        waits = (place >= 3) & (who >= 0) & (who1 >= 0) & (who1 == who2) & (who2 == who3) & (who != who1) & (np.roll(gap, 1) <= hard) & (np.roll(gap, 2) <= hard)
        cut = (gap > hard) & ~waits
    cuts = np.cumsum(cut & new & (place >= 1))
    session = held[start] + cuts - cuts[start]
    rows["gap_us"] = pd.Series(gap).astype("Int64").mask(place < 1)
    rows["burst"], rows["session"] = burst, session
    kept = rows[end - at < 3].assign(session=session[end][end - at < 3])
    return rows[new].drop(columns="new"), pd.concat([last[~old], kept[LAST.names]], ignore_index=True)


def by_sender(messages: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
    """held (OPEN) after more messages with their sessions."""
    each = messages.assign(first_us=messages["t"], last_us=messages["t"], messages=1)[OPEN.names]
    grouped = pd.concat([held, each], ignore_index=True).groupby(["chat", "session", "sender"], dropna=False, sort=False, as_index=False)
    return grouped.agg({"first_us": "min", "last_us": "max", "messages": "sum"})


class _Sessions(StatefulProcessor):
    def __init__(self, hard: int, soft: int | None, closed: bool) -> None:
        self.hard, self.soft, self.closed = hard, soft, closed
        self.limit = None if soft is None else max(hard, soft)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.last = handle.getValueState("last", "rows binary")
        self.open = handle.getValueState("open", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[0] != NO_CHAT:  # a filter would keep such messages from the watermark
            new = pd.concat([pdf[WAITING.names] for pdf in rows], ignore_index=True)
            new = new.astype({"chat": "int64", "t": "int64", "id": "int64"})
            self.waiting.appendValue(_packed(new, WAITING))
            self._timer(int(new["t"].min()))
        yield from ()

    def _timer(self, t: int) -> None:
        self.handle.registerTimer(-(-t // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = _unpacked(self.waiting.get() if self.waiting.exists() else [], WAITING)
        late = waiting["t"] > passed
        ready, rest = waiting[~late], waiting[late]
        if len(ready):
            ready, last = ruled(self._held(self.last, LAST), ready, self.hard, self.soft)
            self.last.update(_packed(last, LAST))
            if len(rest):
                self.waiting.put([_packed(rest, WAITING)])
            else:
                self.waiting.clear()
        if len(rest):
            self._timer(int(rest["t"].min()))
        if self.closed:
            yield self._over(ready, passed)
        elif len(ready):
            yield ready[_names(MESSAGES)]

    @staticmethod
    def _held(state, schema: pa.Schema) -> pd.DataFrame:
        return _unpacked([state.get()] if state.exists() else [], schema)

    def _over(self, ready: pd.DataFrame, passed: int) -> pd.DataFrame:
        """The sessions that are closed; the others stay open, with a timer for the one that ends first."""
        parts = self._held(self.open, OPEN)
        if len(ready):
            parts = by_sender(ready, parts)
        ends = parts.groupby(["chat", "session"])["last_us"].transform("max")
        over = parts["session"] < parts.groupby("chat")["session"].transform("max")
        if self.limit is not None:
            over |= passed > ends + self.limit
        if len(ready) or over.any():
            self.open.update(_packed(parts[~over], OPEN))
        if self.limit is not None and not over.all():
            self._timer(int(ends[~over].min()) + self.limit + 1000)
        done = parts[over].groupby(["chat", "session"], as_index=False)
        return done.agg(first_us=("first_us", "min"), last_us=("last_us", "max"), messages=("messages", "sum"), senders=("sender", "count"))[_names(SESSIONS)]

    def close(self) -> None:
        pass


def _run(messages: DataFrame, late: str, hard: float, soft: float | None, closed: bool) -> DataFrame:
    group = F.when(F.col("chat").isNull(), NO_CHAT).otherwise(F.pmod(F.xxhash64("chat"), F.lit(GROUPS)).cast("int"))
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP'1970-01-01 00:00:00', ts)")
    timed = messages.withWatermark("ts", late).select(group.alias("part"), F.col("chat").cast("long").alias("chat"), "ts", F.col("id").cast("long").alias("id"), micros.alias("t"), F.col("sender").cast("string").alias("sender"))
    processor = _Sessions(int(hard * HOUR), None if soft is None else int(soft * HOUR), closed)
    return with_states(timed.groupBy("part"), processor, SESSIONS if closed else MESSAGES, "EventTime")


def message_sessions(messages: DataFrame, late: str = "10 minutes", hard: float = 2.0, soft: float | None = 4.0) -> DataFrame:
    """chat, id, t (microseconds), gap_us, burst, session of every message of a stream (chat long, id long, ts timestamp,
    sender string), once the watermark has passed it.

    A gap over hard hours begins a session, within a burst (a third message of one sender in a row) over soft hours;
    with soft None, one sender's last three messages wait for another's answer instead. Messages of one time follow id.
    Those that come after the watermark are left out. Messages with a null chat only move the watermark on.
    """
    return _run(messages, late, hard, soft, False)


def closed_sessions(messages: DataFrame, late: str = "10 minutes", hard: float = 2.0, soft: float = 4.0) -> DataFrame:
    """chat, session, first_us, last_us, messages, senders of every session of such a stream, once it is closed."""
    return _run(messages, late, hard, soft, True)
