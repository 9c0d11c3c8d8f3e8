"""Operators on exports, with the SQL each must equal. Sessions by meaning have none: tests fold them by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.operators import chat, corpus, exports
from loomline.plans.catalogue_plans import t
from loomline.plans.chat_plans import _CONVS, _GAPS, _REPAIRED, events, turns


def _spoken(spark, sf_dir):
    """Vectors as messages: a label is a chat; half an hour to three hours lie between two of them."""
    e = t(spark, sf_dir, "embeddings")
    near = F.transform("embedding", lambda x, i: x + F.when(F.col("vec_id") % 3 > 0, 0.2).otherwise(0.0))
    at = F.timestamp_seconds(F.col("vec_id") * 900 + F.col("vec_id") % 11 * 300).cast("timestamp_ntz")
    return e.select(F.col("label").alias("chat"), F.col("vec_id").alias("seq"), at.alias("ts"), F.concat(F.lit("s"), (F.col("vec_id") % 3).cast("string")).alias("sender"), (F.col("vec_id") % 7 * 10).alias("chars"), near.alias("vector"))


def drift_sessions(spark, sf_dir):
    return exports.drift_sessions(_spoken(spark, sf_dir), "s1")


def topic_sessions(spark, sf_dir):
    return exports.topic_sessions(_spoken(spark, sf_dir))


def session_contexts(spark, sf_dir):
    m = chat.sessions(events(spark, sf_dir)).withColumns({"chars": F.floor("value").cast("long"), "item": F.col("event_id")})
    got = exports.session_contexts(m, F.col("sender") == "purchase")
    return got.select("event_id", F.col("k").cast("long").alias("k"), F.array_join("context", ",").alias("context"))


_SESSION_SQL = _GAPS + """, w AS (SELECT s.*, events.value, list(event_id) OVER (PARTITION BY chat, session ORDER BY s.ts, event_id ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING) AS before FROM s JOIN events USING (event_id)),
a AS (SELECT chat, session, sum(CAST(floor(value) AS BIGINT)) / count(*) AS mean, count(*) / greatest((epoch_us(max(ts)) - epoch_us(min(ts))) / 60000000, 1.0) AS rate FROM w GROUP BY ALL),
k AS (SELECT event_id, before, CASE WHEN mean > 100 OR rate < 0.5 THEN 15 WHEN mean < 30 AND rate > 2 THEN 7 ELSE 10 END AS k FROM w JOIN a USING (chat, session) WHERE sender = 'purchase' AND len(before) >= 3)
SELECT event_id, CAST(k AS BIGINT) AS k, array_to_string(before[-k:], ',') AS context FROM k"""


def conv_overlap(spark, sf_dir):
    """Conversations without those of fewer than three messages after repair, and without repeats of kept ones."""
    c = corpus.gathered(turns(spark, sf_dir)).select("conv_id", corpus.repaired(F.col("messages")).alias("messages")).where(F.size("messages") >= 3)
    said = F.transform(F.filter("messages", lambda m: m["role"] != "system"), lambda m: F.regexp_replace(F.coalesce(m["content"], F.lit("")), r"(?U)^\s+|\s+$", ""))
    return corpus.overlap_deduped(c.select("conv_id", said.alias("said")).where(F.size("said") > 0), "conv_id", "said").select("conv_id")


_OVERLAP_SQL = _CONVS.replace("WITH", "WITH RECURSIVE", 1) + f""", r AS (SELECT conv_id, {_REPAIRED} AS ms FROM c),
i AS (SELECT row_number() OVER (ORDER BY conv_id) AS n, conv_id, list_transform(list_filter(ms, lambda m: m.role <> 'system'), lambda m: md5(regexp_replace(lower(coalesce(m.content, '')), '^\\s+|\\s+$', '', 'g'))) AS items FROM r WHERE len(ms) >= 3),
v AS (SELECT row_number() OVER (ORDER BY n) AS n, conv_id, items FROM i WHERE len(items) > 0),
f AS (SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS conv_id, CAST([] AS VARCHAR[]) AS seen UNION ALL
 SELECT v.n, CASE WHEN o <= 0.5 THEN v.conv_id END, CASE WHEN o <= 0.5 THEN list_distinct(seen || v.items) ELSE seen END
 FROM f JOIN v ON v.n = f.n + 1, LATERAL (SELECT CAST(len(list_filter(v.items, lambda x: list_contains(f.seen, x))) AS DOUBLE) / len(v.items) AS o))
SELECT conv_id FROM f WHERE conv_id IS NOT NULL"""


def reply_contexts(spark, sf_dir):
    m = turns(spark, sf_dir).where("conv_id % 3 <> 0 or role = 'user'").select(F.col("conv_id").alias("chat"), F.col("turn").alias("seq"), (F.col("role") == "assistant").alias("outgoing"), "text")
    return exports.reply_contexts(m, 2).select("chat", F.to_json("context").alias("context"))


def track_payloads(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    form = F.element_at(F.array(*[F.lit(x) for x in ('{"title":" %s ","artist":"%s"}', '{"title":"","album":"%s%s"}', '{"title":"%s","duration_ms":%s', '{"title":"%s","duration_ms":12%s,"image_url":null}', '{"artist":"%s","title":"x","duration_ms":"z%s"}')]), (F.col("p_partkey") % 5 + 1).cast("int"))
    got = exports.track_of(F.call_function("format_string", form, F.col("p_name"), (F.col("p_size")).cast("string")))
    return p.select("p_partkey", got.alias("t")).select("p_partkey", F.when(F.col("t.problem").isNull(), F.col("t.title")).alias("title"), F.when(F.col("t.problem").isNull(), F.col("t.artist")).alias("artist"), F.when(F.col("t.problem").isNull(), F.col("t.duration_ms")).alias("duration_ms"), "t.problem")


def post_texts(spark, sf_dir):
    l = t(spark, sf_dir, "lineitem")
    entry = F.struct((F.col("l_linenumber") - 1).alias("pos"), F.when(F.col("l_returnflag") == "A", "image").when(F.col("l_returnflag") == "N", "video").alias("kind"), F.when(F.col("l_linestatus") == "F", F.concat(F.lit("supplier "), F.col("l_suppkey").cast("string"))).alias("text"), F.col("l_partkey"), F.col("l_suppkey"))
    got = l.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(entry)).alias("media"))
    seen = F.transform("media", lambda m: F.coalesce(m["text"], F.lit("")))
    even = F.col("l_orderkey") % 2 == 0
    text = F.when(even, exports.media_text(F.col("media"))).otherwise(exports.heard_and_seen(F.when(F.col("l_orderkey") % 3 == 0, "said"), seen))
    caption = F.when(F.col("l_orderkey") % 5 == 0, "").otherwise(F.concat(F.lit("order "), F.col("l_orderkey").cast("string")))
    return got.select("l_orderkey", exports.post_block(F.concat(F.lit("https://example.org/p/"), F.col("l_orderkey").cast("string"), F.lit("/")), F.when(even, "post").otherwise("reel"), caption, text).alias("block"))


_POST_SQL = """WITH m AS (SELECT l_orderkey AS k, list({'pos': l_linenumber, 'kind': CASE l_returnflag WHEN 'A' THEN 'IMAGE' WHEN 'N' THEN 'VIDEO' ELSE 'UNKNOWN' END, 'text': CASE WHEN l_linestatus = 'F' THEN 'supplier ' || l_suppkey END}
 ORDER BY l_linenumber, CASE l_returnflag WHEN 'A' THEN 'image' WHEN 'N' THEN 'video' END NULLS FIRST, CASE WHEN l_linestatus = 'F' THEN 'supplier ' || l_suppkey END NULLS FIRST, l_partkey, l_suppkey) AS m FROM lineitem GROUP BY 1),
x AS (SELECT k, CASE WHEN k % 2 = 0 THEN array_to_string(list_transform(m, lambda e: '--- MEDIA ' || e.pos || ': ' || e.kind || ' ---' || chr(10) || coalesce(e.text, '[No text extracted]')), chr(10) || chr(10))
 ELSE array_to_string(list_filter([CASE WHEN k % 3 = 0 THEN '--- AUDIO ---' || chr(10) || 'said' || chr(10) END, '--- VISUAL ---' || chr(10) || nullif(array_to_string(list_transform(list_filter(m, lambda e: e.text IS NOT NULL), lambda e: e.text), chr(10) || chr(10)), '')], lambda s: s IS NOT NULL), chr(10)) END AS t FROM m)
SELECT k AS l_orderkey, 'Post: https://example.org/p/' || k || '/' || chr(10) || 'Type: ' || CASE WHEN k % 2 = 0 THEN 'post' ELSE 'reel' END || chr(10) || CASE WHEN k % 5 = 0 THEN '' ELSE 'Caption: order ' || k || chr(10) END || repeat('-', 40) || chr(10) || t || chr(10) AS block FROM x"""

_SUFFIXES = (".mp3", ".tar.gz", ".TXT", "", ".json", ".é", ".pdf.xz", ".mp4", ".tgz")
_TYPES = ("audio/mpeg", "application/x-tar", "text/plain", exports.UNKNOWN_TYPE, "application/json", exports.UNKNOWN_TYPE, "application/pdf", "video/mp4", "application/x-tar")


def artifact_links(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    path = F.concat(F.lit("out/a~b*c+ü "), "p_name", F.element_at(F.array(*[F.lit(s) for s in _SUFFIXES]), (F.col("p_partkey") % len(_SUFFIXES) + 1).cast("int")))
    return p.select("p_partkey", exports.content_type_of(F.substring_index(path, "/", -1)).alias("content_type"), exports.quoted(path).alias("link"))


QUERIES = {
    "drift_sessions": (drift_sessions, None),
    "topic_sessions": (topic_sessions, None),
    "session_contexts": (session_contexts, _SESSION_SQL),
    "conv_overlap": (conv_overlap, _OVERLAP_SQL),
    "reply_contexts": (
        reply_contexts,
        """WITH m AS (SELECT conv_id AS chat, turn, role, text FROM conversations WHERE conv_id % 3 <> 0 OR role = 'user'), n AS (SELECT *, row_number() OVER (PARTITION BY chat ORDER BY turn DESC) AS n FROM m)
SELECT chat, CAST(to_json(coalesce(list({'role': CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'user' END, 'content': text} ORDER BY turn) FILTER (coalesce(text, '') <> ''), [])) AS VARCHAR) AS context FROM n WHERE n <= 4 GROUP BY chat HAVING arg_max(role, turn) <> 'assistant'""",
    ),
    "track_payloads": (
        track_payloads,
        """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 3 THEN p_name END AS title, CASE p_partkey % 5 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 3 THEN '' END AS artist,
 CASE p_partkey % 5 WHEN 0 THEN 0 WHEN 3 THEN CAST('12' || p_size AS BIGINT) END AS duration_ms, CASE p_partkey % 5 WHEN 1 THEN 'missing_title' WHEN 2 THEN 'invalid' WHEN 4 THEN 'invalid' END AS problem FROM part""",
    ),
    "post_texts": (post_texts, _POST_SQL),
    "artifact_links": (
        artifact_links,
        f"SELECT p_partkey, {list(_TYPES)!r}[p_partkey % {len(_TYPES)} + 1] AS content_type, replace(url_encode('out/a~b*c+ü ' || p_name || {list(_SUFFIXES)!r}[p_partkey % {len(_SUFFIXES)} + 1]), '%2F', '/') AS link FROM part",
    ),
}
