"""Feeds of items with codes: each code once while its state lives, and the end of sources that bring nothing new."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomline.streaming.state import with_states

FEED = "source string, code string, event string"
TWO_HOURS, ROUND, IDLE = 7_200_000, 1_000, 3


class Feed(StatefulProcessor):
    """State of a source: its codes, each forgotten after ttl_ms, and the rounds in a row that brought no new code.

    A round is a processing-time timer of round_ms. After idle rounds without a new code the source has ended, and all
    that was known of it goes; an item that comes later begins it anew.
    """

    def __init__(self, ttl_ms: int = TWO_HOURS, round_ms: int = ROUND, idle: int = IDLE) -> None:
        self.ttl_ms, self.round_ms, self.idle = ttl_ms, round_ms, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.codes = handle.getMapState("codes", "code string", "seen boolean", self.ttl_ms)
        self.rounds = handle.getValueState("rounds", "idle int, fresh boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = []
        # each look is a call to the state store, so a code is looked up once however often it comes
        for code in dict.fromkeys(code for pdf in rows for code in pdf["code"]):
            if code is not None and not self.codes.containsKey((code,)):
                self.codes.updateValue((code,), (True,))
                new.append(code)
        if not self.rounds.exists():
            self.rounds.update((0, bool(new)))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.round_ms)
        elif new:
            self.rounds.update((0, True))
        yield pd.DataFrame({"source": [key[0]] * len(new), "code": new, "event": ["new"] * len(new)}, dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        idle, fresh = self.rounds.get()
        idle = 0 if fresh else idle + 1
        if idle >= self.idle:
            self.rounds.clear()
            self.codes.clear()
            yield pd.DataFrame({"source": [key[0]], "code": [None], "event": ["ended"]}, dtype=object)
        else:
            self.rounds.update((idle, False))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.round_ms)
            yield pd.DataFrame({"source": [], "code": [], "event": []}, dtype=object)

    def close(self) -> None:
        pass


def feed(items: DataFrame, ttl_ms: int = TWO_HOURS, round_ms: int = ROUND, idle: int = IDLE) -> DataFrame:
    """source, code, event of a stream (source string, code string): new for each code that is not known, ended for a
    source whose last idle rounds brought none. Items without a code count as nothing new."""
    return with_states(items.groupBy("source"), Feed(ttl_ms, round_ms, idle), FEED, "ProcessingTime")
