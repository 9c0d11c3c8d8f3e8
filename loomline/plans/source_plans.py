"""Sources, sinks and streams over the given tables, with the SQL each must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.operators.rounds import shared_path
from loomline.plans.catalogue_plans import _KEY, _TRACKS, tracks
from loomline.plans.chat_plans import _GAPS, _TURN_SQL
from loomline.operators import match
from loomline.sources import cache, fanout, pages
from loomline.streaming import feeds, resume, sessions


def file_fanout(spark, sf_dir):
    """Every conversation as a file of its turns; one that does not end with an answer is quarantined."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    line = F.concat_ws(": ", "role", F.replace("text", F.lit("\n"), F.lit("\\n")))
    last = t.groupBy("conv_id").agg(F.max_by("role", "turn").alias("last"))
    error = F.when(~F.col("last").eqNullSafe(F.lit("assistant")), F.concat(F.lit("ends with "), F.coalesce("last", F.lit("nobody"))))
    name = F.concat(F.lit("chat/"), F.col("conv_id").cast("string"), F.lit(".txt"))
    path = shared_path(spark, "fanout")
    fanout.write_each(t.join(last, "conv_id").select(name.alias("file"), F.col("turn").cast("long").alias("pos"), line.alias("value"), error.alias("error")), path)
    got = fanout.read_each(spark, path)
    return got.select(F.regexp_extract("file", "([0-9]+)[.]txt$", 1).cast("long").alias("conv_id"), F.sha2("value", 256).alias("digest"), "error")


_FANOUT_SQL = """WITH g AS (SELECT conv_id, arg_max(role, turn) AS last, string_agg(concat_ws(': ', role, replace(text, chr(10), '\\n')) || chr(10), '' ORDER BY turn) AS value FROM conversations GROUP BY 1)
SELECT conv_id, CASE WHEN last = 'assistant' THEN sha256(value) END AS digest, CASE WHEN last <> 'assistant' THEN 'ends with ' || last END AS error FROM g"""


def paged_customers(spark, sf_dir):
    """The customers, read by pages."""
    table = f"{sf_dir}/customer.parquet"
    return pages.read_pages(spark, "loomline.sources.pages:parquet_page", spark.read.parquet(table).schema, limit=400, table=table)


def cache_upsert(spark, sf_dir):
    """A cache of the even tracks' keys after every third track was put in with another value."""
    c = F.col
    base = tracks(spark, sf_dir).withColumn("key", match.cache_key(c("title"), c("artist"), c("album"), c("duration_ms")))
    rows = base.select("key", F.col("p_partkey").cast("long").alias("value"))
    store = cache.KeyedCache(spark, shared_path(spark, "cache"), rows.schema, ["key"])
    store.upsert(rows.where("value % 2 = 0"), ["value"])
    store.upsert(rows.where("value % 3 = 0").withColumn("value", -F.col("value")), ["value"])
    return store.read()


_UPSERT_SQL = f"""WITH {_TRACKS}, k AS (SELECT p_partkey AS value, {_KEY} AS key FROM t), a AS (SELECT key, max(value) AS value FROM k WHERE value % 2 = 0 GROUP BY key),
b AS (SELECT key, max(-value) AS value FROM k WHERE value % 3 = 0 GROUP BY key) SELECT coalesce(b.key, a.key) AS key, coalesce(b.value, a.value) AS value FROM a FULL JOIN b ON a.key = b.key"""


def resumable_orders(spark, sf_dir):
    """Customers' orders as files that come one by one; each customer is handled once, by the first batch that has it."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey")
    path = shared_path(spark, "resumable")
    job = resume.Resumable(spark, path, o.schema, ["o_custkey"], lambda rows: rows.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("times")))
    for part in range(3):
        o.where(F.col("o_orderkey") % 3 == part).write.mode("append").parquet(f"{path}/in")
        job.run(f"{path}/in", files=1000)
    return job.output().groupBy("o_custkey", "batch").agg(F.sum("times").alias("times"))


_RESUMABLE_SQL = "SELECT o_custkey, min(o_orderkey % 3) AS batch, CAST(1 AS BIGINT) AS times FROM orders GROUP BY 1"

CHAT = "chat long, id long, ts timestamp, sender string"


def _streamed(spark, sf_dir, made, **trigger):
    """made of events as a stream of three batches by time; the end of time, of no chat, closes what is open."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e = e.select(F.col("user_id").cast("long").alias("chat"), F.col("event_id").cast("long").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("sender"))
    path = shared_path(spark, "events")
    low, high = e.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    third = (high - low) // 3 + 1 if low is not None else 1
    end = e.agg(F.expr("max(ts) + interval 30 days").alias("ts")).where("ts is not null")
    nothing = [F.lit(None).cast(kind).alias(name) for name, kind in (("chat", "long"), ("id", "long"), ("sender", "string"))]
    slices = [e.where(F.floor((F.unix_micros("ts") - low) / third) == part) for part in range(3)] + [end.select("ts", *nothing).select(e.columns)]
    for rows in slices:
        rows.write.mode("append").parquet(f"{path}/in")
        out = made(spark.readStream.schema(CHAT).parquet(f"{path}/in"))
        writer = out.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").option("path", f"{path}/out")
        writer.trigger(**(trigger or {"availableNow": True})).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")


def stream_sessions(spark, sf_dir):
    return _streamed(spark, sf_dir, sessions.message_sessions).select(F.col("id").alias("event_id"), "gap_us", "burst", "session")


def stream_turn_sessions(spark, sf_dir):
    return _streamed(spark, sf_dir, lambda m: sessions.message_sessions(m, soft=None)).select(F.col("id").alias("event_id"), "session")


def stream_closed_sessions(spark, sf_dir):
    return _streamed(spark, sf_dir, sessions.closed_sessions)


_CLOSED_SQL = _GAPS + """ SELECT chat, session, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS messages, count(DISTINCT sender) AS senders FROM s GROUP BY 1, 2"""


def stream_feed(spark, sf_dir):
    """Users of each event type as codes of a source, each once; rounds of processing time never end such a stream, so
    each part is a batch of its own."""
    return _streamed(spark, sf_dir, lambda m: feeds.feed(m.where("chat is not null").select(F.col("sender").alias("source"), F.col("chat").cast("string").alias("code"))), once=True)


QUERIES = {
    "file_fanout": (file_fanout, _FANOUT_SQL),
    "paged_customers": (paged_customers, "SELECT * FROM customer"),
    "cache_upsert": (cache_upsert, _UPSERT_SQL),
    "resumable_orders": (resumable_orders, _RESUMABLE_SQL),
    "stream_sessions": (stream_sessions, _GAPS + " SELECT event_id, gap_us, burst, session FROM s"),
    "stream_turn_sessions": (stream_turn_sessions, _TURN_SQL),
    "stream_closed_sessions": (stream_closed_sessions, _CLOSED_SQL),
    "stream_feed": (stream_feed, "SELECT DISTINCT event_type AS source, CAST(user_id AS VARCHAR) AS code, 'new' AS event FROM events WHERE user_id IS NOT NULL"),
}
