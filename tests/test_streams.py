"""Stateful streams against the batch rules, and expiry on a manual clock."""

import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomline.operators import chat
from loomline.streaming import feeds, sessions

SCHEMA = "chat long, id long, ts timestamp, sender string"
START = datetime.datetime(2024, 1, 1)


def talk(seed, n=400):
    """Messages whose gaps lie around the rule's limits; some come up to nine minutes late."""
    r = random.Random(seed)
    rows, now = [], {c: START for c in range(3)}
    for i in range(n):
        c = r.randrange(3)
        now[c] += datetime.timedelta(seconds=r.choice([0, 1, 60, 7199, 7200, 7201, 9000, 14399, 14400, 14401, 30000]) if r.random() < 0.5 else r.randint(1, 600))
        rows.append((c, i, now[c], r.choice(["a", "a", "a", "b", None])))
    rows.sort(key=lambda x: x[2] + datetime.timedelta(seconds=r.randint(0, 540)))
    return rows


def run(spark, path, rows, made, batches):
    size = -(-len(rows) // batches)
    parts = [rows[i : i + size] for i in range(0, len(rows), size)] + [[(None, None, max(x[2] for x in rows) + datetime.timedelta(days=9), None)]]
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
        out = made(spark.readStream.schema(SCHEMA).parquet(f"{path}/in"))
        out.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").option("path", f"{path}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")


@pytest.mark.parametrize("rule", ["gap", "turn"])
def test_sessions_equal_the_batch(spark, tmp_path, rule):
    rows = talk(3)
    batch = spark.createDataFrame(rows, SCHEMA).withColumn("seq", F.struct("ts", "id")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    if rule == "gap":
        want = chat.sessions(batch)
        got = run(spark, tmp_path, rows, sessions.message_sessions, 4)
        columns = ["id", "gap_us", "burst", "session"]
    else:
        want = chat.turn_sessions(batch)
        got = run(spark, tmp_path, rows, lambda m: sessions.message_sessions(m, soft=None), 4)
        columns = ["id", "session"]
    got = sorted(tuple(x) for x in got.select(columns).collect())
    assert got == sorted(tuple(x) for x in want.select(columns).collect())
    assert len({x[-1] for x in got}) > 20


def test_closed_sessions(spark, tmp_path):
    rows = talk(5, 200)
    batch = spark.createDataFrame(rows, SCHEMA).withColumn("seq", F.struct("ts", "id")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    stats = chat.session_stats(chat.sessions(batch)).select("chat", "session", "messages", "senders", "duration_us")
    got = run(spark, tmp_path, rows, sessions.closed_sessions, 3)
    got = got.select("chat", "session", "messages", "senders", (F.col("last_us") - F.col("first_us")).alias("duration_us"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stats.collect()))


def test_what_comes_after_the_watermark_is_left_out(spark, tmp_path):
    at = lambda m: START + datetime.timedelta(minutes=m)
    rows = [(1, 1, at(0), "a"), (1, 2, at(60), "a"), (1, 3, at(10), "b"), (1, 4, at(55), "b"), (1, 5, at(61), "a"), (1, 6, at(62), "a")]
    got = run(spark, tmp_path, rows, sessions.message_sessions, 3)
    assert sorted((x.id, x.gap_us) for x in got.collect()) == [(1, None), (2, 5 * 60_000_000), (4, 55 * 60_000_000), (5, 60_000_000), (6, 60_000_000)]


@pytest.mark.parametrize("rule", ["gap", "turn", "closed"])
def test_state_grows_with_groups_and_not_with_chats(spark, tmp_path, monkeypatch, rule):
    """Many chats, ids and senders that no text state could hold, in two batches; few keys of state, the batch's sessions."""
    monkeypatch.setattr(sessions, "GROUPS", 4, raising=False)
    r = random.Random(7)
    rows = [(2**60 + c, 2**61 + 1000 * c + i, START + datetime.timedelta(seconds=r.choice([1, 600, 7200, 7201, 9000, 14401]) * i + r.randint(0, 9)), r.choice(["a", "a", "a", "b\x1fc", "", None])) for c in range(150) for i in range(6)]
    rows.sort(key=lambda x: x[2])
    made = {"gap": sessions.message_sessions, "turn": lambda m: sessions.message_sessions(m, soft=None), "closed": sessions.closed_sessions}[rule]
    keys = 0
    for part in (rows[:450], rows[450:], [(None, None, rows[-1][2] + datetime.timedelta(days=9), None)]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = made(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"))
        query = out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        query.awaitTermination()
        keys = max([keys, *[p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]])
    got = spark.read.schema(out.schema).parquet(f"{tmp_path}/out")
    batch = spark.createDataFrame(rows, SCHEMA).withColumn("seq", F.struct("ts", "id")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    want = chat.turn_sessions(batch) if rule == "turn" else chat.sessions(batch)
    columns = ["chat", "id", "session"]
    if rule == "closed":
        want, columns = chat.session_stats(want), ["chat", "session", "messages", "senders"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    assert 0 < keys < 100


class Clock:
    """Stands in for a state store and its timers, on a clock that the test moves."""

    def __init__(self):
        self.now, self.timers, self.codes, self.value, self.ttl = 0, [], {}, None, 0

    def getMapState(self, name, key, value, ttl):
        self.ttl = ttl
        return self

    def getValueState(self, name, schema):
        clock = self

        class Value:
            exists = staticmethod(lambda: clock.value is not None)
            get = staticmethod(lambda: clock.value)
            clear = staticmethod(lambda: setattr(clock, "value", None))
            update = staticmethod(lambda v: setattr(clock, "value", v))

        return Value

    def registerTimer(self, t):
        self.timers.append(t)

    def getCurrentProcessingTimeInMs(self):
        return self.now

    def containsKey(self, key):
        return key in self.codes and self.now - self.codes[key] < self.ttl

    def updateValue(self, key, value):
        self.codes[key] = self.now

    def clear(self):
        self.codes = {}


def played(processor, arrivals, until):
    """What a source gives when its items arrive at these times; timers fire when they are due."""
    clock, out = Clock(), []
    processor.init(clock)
    for at, codes in [*arrivals, (until, [])]:
        while clock.timers and min(clock.timers) <= at:
            clock.now = min(clock.timers)
            clock.timers.remove(clock.now)
            out += [(clock.now, *x[1:]) for f in processor.handleExpiredTimer(("s",), clock, None) for x in f.itertuples(index=False)]
        clock.now = at
        if codes:
            out += [(at, *x[1:]) for f in processor.handleInputRows(("s",), iter([pd.DataFrame({"code": codes})]), clock) for x in f.itertuples(index=False)]
    return out


def test_codes_expire_and_sources_end():
    hour = 3_600_000
    quick = feeds.Feed(ttl_ms=2 * hour, round_ms=1000, idle=3)
    got = played(quick, [(0, ["a", "b", "a", None]), (500, ["a"]), (1500, ["c"]), (4200, ["a"])], 20_000)
    assert got == [(0, "a", "new"), (0, "b", "new"), (1500, "c", "new"), (5000, None, "ended")]
    assert played(quick, [(0, ["a"]), (9000, ["a"])], 30_000) == [(0, "a", "new"), (4000, None, "ended"), (9000, "a", "new"), (13000, None, "ended")]
    slow = feeds.Feed(ttl_ms=2 * hour, round_ms=hour, idle=3)
    arrivals = [(0, ["a"]), (hour, ["a", "b"]), (2 * hour - 1, ["a"]), (2 * hour, ["a"]), (3 * hour, ["a", "b"])]
    assert [x for x in played(slow, arrivals, 4 * hour) if x[2] == "new"] == [(0, "a", "new"), (hour, "b", "new"), (2 * hour, "a", "new"), (3 * hour, "b", "new")]


def test_a_code_is_looked_up_once_a_batch():
    clock, looks = Clock(), []
    known = clock.containsKey
    clock.containsKey = lambda key: looks.append(key) or known(key)
    feed = feeds.Feed()
    feed.init(clock)
    parts = [pd.DataFrame({"code": ["a", "b", "a", None]}), pd.DataFrame({"code": ["b", "c", "a"]})]
    got = [x.code for f in feed.handleInputRows(("s",), iter(parts), clock) for x in f.itertuples()]
    assert got == ["a", "b", "c"] and len(looks) == 3


def test_feed_on_a_stream(spark, tmp_path):
    rows = [("s", "a"), ("s", "b"), ("s", "a"), ("t", "a"), ("t", None)]
    for n in range(2):
        spark.createDataFrame(rows + [("s", f"n{n}")], "source string, code string").write.mode("append").parquet(f"{tmp_path}/in")
        out = feeds.feed(spark.readStream.schema("source string, code string").parquet(f"{tmp_path}/in"), round_ms=60_000)
        out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").trigger(once=True).start().awaitTermination()
    got = spark.read.schema(feeds.FEED).parquet(f"{tmp_path}/out").collect()
    assert sorted(tuple(x) for x in got) == [("s", c, "new") for c in ("a", "b", "n0", "n1")] + [("t", "a", "new")]
