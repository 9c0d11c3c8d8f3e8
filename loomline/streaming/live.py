"""Stateful streams: sessions, rate limits, high-water marks, first arrivals, running estimates, expiry."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomline.operators.runtime import event_seconds


class _Limiter(StatefulProcessor):
    def __init__(self, most: int, seconds: int) -> None:
        self.most, self.span = most, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "t double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [t for (t,) in self.held.get()] if self.held.exists() else []
        out = []
        for pdf in rows:
            for ident, ts in sorted(zip(pdf["id"], pdf["ts"]), key=lambda r: (r[1], r[0])):
                now = ts.timestamp()
                held = [t for t in held if now - t <= self.span]
                ok = len(held) < self.most
                if ok:
                    held.append(now)
                out.append((key[0], ident, ok))
        self.held.put([(t,) for t in held])
        yield pd.DataFrame(out, columns=["key", "id", "admitted"])

    def close(self) -> None:
        pass


def rate_limited(events: DataFrame, most: int = 10, seconds: int = 60) -> DataFrame:
    """key, id, admitted of a stream (key string, id long, ts timestamp): the state is the last admitted times."""
    return events.groupBy("key").transformWithStateInPandas(_Limiter(most, seconds), "key string, id long, admitted boolean", "Append", "None")


class _Newest(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mark = handle.getValueState("mark", "id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark = self.mark.get()[0] if self.mark.exists() else -(1 << 62)
        last = None
        for pdf in rows:
            at = pdf["id"].idxmax()
            if last is None or pdf["id"][at] > last[0]:
                last = int(pdf["id"][at]), bool(pdf["incoming"][at]), pdf["text"][at]
        if last[0] > mark:
            self.mark.update((last[0],))
            if last[1]:
                yield pd.DataFrame({"key": [key[0]], "id": [last[0]], "text": [last[2]]})

    def close(self) -> None:
        pass


def to_answer(messages: DataFrame) -> DataFrame:
    """key, id, text of a stream (key string, id long, incoming boolean, text string): the latest message of each batch,
    if it came in and is newer than what was handled."""
    return messages.groupBy("key").transformWithStateInPandas(_Newest(), "key string, id long, text string", "Append", "None")


def gap_sessions(events: DataFrame, key: str, ts: str, gap: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    """Sessions by a plain gap, with their counts, once the watermark has passed them."""
    session = F.session_window(ts, gap)
    return events.withWatermark(ts, late).groupBy(key, session.alias("s")).agg(F.count(F.lit(1)).alias("messages")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "messages")


def first_arrivals(items: DataFrame, code: str, ts: str, late: str = "2 hours") -> DataFrame:
    """Items with a code, once each within the watermark."""
    return items.where(F.col(code).isNotNull()).withWatermark(ts, late).dropDuplicatesWithinWatermark([code])


def live_estimates(events: DataFrame, task: str = "task_id", message: str = "message") -> DataFrame:
    """Each task's estimate so far: the most seconds that one of its messages asked for."""
    return events.groupBy(task).agg(F.max(event_seconds(F.col(message))).alias("estimate"))


def alive(rows: DataFrame, modified: str, hours: float, now: str | None = None) -> DataFrame:
    """Rows modified within the last hours."""
    at = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    return rows.where(F.unix_micros(F.col(modified).cast("timestamp")) >= F.unix_micros(at) - int(hours * 3_600_000_000))
