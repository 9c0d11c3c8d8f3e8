"""Chat and corpus operators over events and conversations, with the SQL each must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.operators import chat, corpus

_H = 3_600_000_000


def events(spark, sf_dir):
    """events as messages: a user is a chat, an event type a sender."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("user_id").alias("chat"), F.struct("ts", "event_id").alias("seq"), "event_id", "ts", F.col("event_type").alias("sender"), "value")


def turns(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


_GAPS = f"""
WITH e AS (SELECT event_id, user_id AS chat, event_type AS sender, ts FROM events),
l AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER o) AS gap_us, coalesce(sender = lag(sender, 1) OVER o AND sender = lag(sender, 2) OVER o, false) AS burst,
  lag(sender, 1) OVER o AS s1, lag(sender, 2) OVER o AS s2, lag(sender, 3) OVER o AS s3 FROM e WINDOW o AS (PARTITION BY chat ORDER BY ts, event_id)),
s AS (SELECT *, CAST(sum(CASE WHEN burst THEN CAST(coalesce(gap_us > {4 * _H}, false) AS INTEGER) ELSE CAST(coalesce(gap_us > {2 * _H}, false) AS INTEGER) END) OVER (PARTITION BY chat ORDER BY ts, event_id) AS BIGINT) AS session FROM l)"""


def _sessions(spark, sf_dir):
    return chat.sessions(events(spark, sf_dir))


def session_gap(spark, sf_dir):
    return _sessions(spark, sf_dir).select("event_id", F.col("gap_us").cast("long"), "burst", "session")


def session_turn(spark, sf_dir):
    return chat.turn_sessions(events(spark, sf_dir)).select("event_id", "session")


_TURN_SQL = _GAPS + f""", t AS (SELECT *, lag(gap_us, 1) OVER o AS g1, lag(gap_us, 2) OVER o AS g2 FROM l WINDOW o AS (PARTITION BY chat ORDER BY ts, event_id))
SELECT event_id, CAST(sum(CAST(coalesce(gap_us > {2 * _H} AND NOT coalesce(s1 = s2 AND s2 = s3 AND sender <> s1 AND g1 <= {2 * _H} AND g2 <= {2 * _H}, false), false) AS INTEGER)) OVER (PARTITION BY chat ORDER BY ts, event_id) AS BIGINT) AS session FROM t"""


def session_stats(spark, sf_dir):
    return chat.session_stats(_sessions(spark, sf_dir))


_STATS_SQL = _GAPS + f""", g AS (SELECT chat, session, count(*) AS messages, count(DISTINCT sender) AS senders, CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS BIGINT) AS duration_us FROM s GROUP BY 1, 2)
SELECT *, messages >= 2 AND senders >= 2 AND duration_us <= {12 * _H} AS valid FROM g"""


def context_window(spark, sf_dir):
    got = chat.contexts(_sessions(spark, sf_dir), F.col("sender") == "purchase", item="event_id")
    return got.select("event_id", F.col("k").cast("long").alias("k"), F.array_join("context", ",").alias("context"))


_CONTEXT_SQL = _GAPS + f""", c AS (
  SELECT *, avg(gap_us) OVER (PARTITION BY chat ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS mean,
    list(event_id) OVER (PARTITION BY chat, session ORDER BY ts, event_id ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING) AS before,
    row_number() OVER (PARTITION BY chat, session ORDER BY ts, event_id) - 1 AS so_far,
    epoch_us(ts) - epoch_us(first_value(ts) OVER (PARTITION BY chat, session ORDER BY ts, event_id)) AS elapsed,
    len(list_distinct(list(sender) OVER (PARTITION BY chat, session ORDER BY ts, event_id))) AS senders FROM s
), k AS (SELECT *, CASE WHEN mean < {_H // 12} THEN 15 WHEN mean > {_H // 2} THEN 5 ELSE 10 END AS k FROM c WHERE sender = 'purchase' AND so_far >= 3 AND senders >= 2 AND elapsed <= {12 * _H})
SELECT event_id, CAST(k AS BIGINT) AS k, array_to_string(before[-k:], ',') AS context FROM k"""


def recent_share(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("ts_ms", F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"))
    return chat.without_share_replies(e, F.col("sender") == "signup", F.round(F.col("value")).cast("int")).select("event_id")


_SHARE_SQL = """WITH e AS (SELECT event_id, user_id, event_type, value, epoch_ms(ts) AS ms FROM events),
n AS (SELECT *, coalesce(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ms RANGE BETWEEN 299999 PRECEDING AND 1 PRECEDING), 0) AS shares FROM e)
SELECT event_id FROM n WHERE event_type = 'signup' OR NOT (shares > 0 AND round(value) < 50)"""


def message_types(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    kind = chat.message_type(F.col("html"), F.col("url"), F.col("page_id") % 3 == 0, F.col("page_id") % 5 == 0)
    return p.select("page_id", kind.alias("kind"))


def reciprocity(spark, sf_dir):
    """Each assistant turn against the last three user turns of its conversation before it.

    Users' turns are numbered, and a frame over that number holds the last three and no more text.
    """
    from pyspark.sql import Window

    own = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    said = (F.col("role") == "user") & F.col("text").isNotNull()
    t = turns(spark, sf_dir).withColumn("seen", F.sum(F.coalesce(said, F.lit(False)).cast("long")).over(own))
    last = Window.partitionBy("conv_id").orderBy("seen").rangeBetween(-2, 0)
    each = F.collect_list(F.when(said, F.struct("seen", "text"))).over(last)
    t = t.withColumn("partner", F.transform(F.array_sort(each), lambda x: x["text"])).where("role = 'assistant'")
    return t.select("conv_id", "turn", chat.reciprocal(F.col("partner"), F.col("text")).alias("keep"))


def _energy(x):
    return f"(length({x}) + 5 * (length({x}) - length(replace({x}, '!', ''))) + 5 * (length({x}) - length(replace({x}, '?', ''))) + (length({x}) - length(replace({x}, '...', ''))) + 5 * length(regexp_replace({x}, '[\\x00-\\x7F]', '', 'g')))"


_RECIPROCITY_SQL = f"""WITH t AS (SELECT *, list(text) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS partner FROM conversations),
j AS (SELECT conv_id, turn, text AS response, coalesce(len(partner), 0) AS n, array_to_string(partner[-3:], ' ') AS said FROM t WHERE role = 'assistant'),
e AS (SELECT *, {_energy("said")} AS i, {_energy("response")} AS o FROM j)
SELECT conv_id, turn, CASE WHEN n = 0 THEN true ELSE contains(said, '?') OR coalesce(regexp_extract(lower(said), '[^\\s]+') IN ('what','where','when','who','why','how','which','can','could'), false) OR NOT (i > 150 AND o < 15 AND CAST(o AS DOUBLE) / i < 0.2) END AS keep FROM e"""


def log_messages(spark, sf_dir):
    """Conversations written as a text log and parsed again; a turn's further lines continue its message."""
    t = turns(spark, sf_dir).where("role <> 'system'")
    minute = (F.col("turn") % 60).cast("string")
    head = F.concat(F.lit("13/02/24, 9:"), F.lpad(minute, 2, "0"), F.lit(" pm - "), "role", F.lit(": "), F.get(F.split("text", "\n"), F.lit(0)))
    rest = F.slice(F.split("text", "\n"), F.lit(2), F.size(F.split("text", "\n")))
    lines = t.select("conv_id", "turn", F.posexplode(F.concat(F.array(head), rest)).alias("n", "line"))
    rows = lines.select(F.col("conv_id").alias("file"), (F.col("turn").cast("long") * (1 << 31) + F.col("n")).alias("line_no"), "line")
    return chat.assembled(rows).select(F.col("file").alias("conv_id"), "ts", "sender", F.length("content").cast("long").alias("chars"))


_LOG_SQL = """WITH t AS (SELECT conv_id, turn, role, string_split(text, chr(10)) AS parts FROM conversations WHERE role <> 'system')
SELECT conv_id, TIMESTAMP '2024-02-13 21:00:00' + to_minutes(turn % 60) AS ts, role AS sender, CAST(length(array_to_string(parts, chr(10))) AS BIGINT) AS chars FROM t
WHERE NOT regexp_matches(parts[1], '(?i)[^:]+\\s+(added|removed)\\s+[^:]+|[^:]+\\s+left') AND length(parts[1]) > 0"""


def rate_limit(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return chat.rate_limited(e, "event_type", "ts", "event_id", 10, 3600).select("event_id", "admitted")


def convs(spark, sf_dir):
    return corpus.gathered(turns(spark, sf_dir))


_CONVS = "WITH c AS (SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS ms FROM conversations GROUP BY conv_id)"
_BLANK = "(m.content IS NULL OR trim(m.content) = '')"


def conv_validate(spark, sf_dir):
    return convs(spark, sf_dir).select("conv_id", F.coalesce(corpus.invalid_reason(F.col("messages")), F.lit("valid")).alias("reason"))


_VALIDATE_SQL = _CONVS + f""", b AS (SELECT conv_id, ms, list_filter(range(1, len(ms) + 1), lambda i: ms[i].role IS NULL OR ms[i].content IS NULL OR trim(ms[i].content) = '') AS bad FROM c)
SELECT conv_id, CASE WHEN len(ms) < 2 THEN 'insufficient_messages' WHEN len(bad) > 0 THEN 'message_' || (bad[1] - 1) || CASE WHEN ms[bad[1]].role IS NULL THEN '_missing_fields' ELSE '_invalid_content' END
 WHEN NOT list_contains(list_transform(ms, lambda m: m.role), 'user') THEN 'no_user_message' WHEN NOT list_contains(list_transform(ms, lambda m: m.role), 'assistant') THEN 'no_assistant_message' ELSE 'valid' END AS reason FROM b"""


def _flat(messages):
    return F.array_join(F.transform(messages, lambda m: F.concat_ws(":", m["role"], F.length(m["content"]).cast("string"))), ",")


_FLAT = "array_to_string(list_transform({}, lambda m: m.role || ':' || length(m.content)), ',')"


def conv_repair(spark, sf_dir):
    return convs(spark, sf_dir).select("conv_id", _flat(corpus.repaired(F.col("messages"))).alias("shape"))


_REPAIRED = "CASE WHEN ms[1].role = 'system' AND ms[2].role = 'assistant' THEN ms[1:1] || ms[3:] ELSE ms END"


def conv_merge_roles(spark, sf_dir):
    return corpus.merged_roles(turns(spark, sf_dir))


_MERGE_SQL = """WITH f AS (SELECT *, CASE WHEN role = 'system' OR role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS new FROM conversations),
r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM f)
SELECT conv_id, min(turn) AS turn, role, string_agg(text, chr(10) ORDER BY turn) AS text FROM r GROUP BY conv_id, run, role"""


def conv_filler(spark, sf_dir):
    return convs(spark, sf_dir).select("conv_id", corpus.filler_only(F.col("messages")).alias("filler"))


_FILLER_SQL = _CONVS + rf""", w AS (SELECT conv_id, list_transform(list_filter(ms, lambda m: m.role = 'assistant'), lambda m: list_filter(regexp_split_to_array(lower(trim(regexp_replace(m.content, '[^\p{{L}}\p{{N}}_\s]', '', 'g'))), '\s+'), lambda x: x <> '')) AS a FROM c)
SELECT conv_id, len(list_filter(a, lambda ws: len(ws) > 2 OR len(list_filter(ws, lambda x: NOT list_contains({list(corpus.FILLERS)!r}, x))) > 0)) = 0 AS filler FROM w"""


def conv_english(spark, sf_dir):
    got = convs(spark, sf_dir).select("conv_id", corpus.english_only(F.col("messages")).alias("messages")).where("messages is not null")
    return got.select("conv_id", _flat(F.col("messages")).alias("shape"))


def _english(m):
    ws = rf"regexp_extract_all(lower({m}), '[\p{{L}}\p{{N}}_]+')"
    return f"(trim({m}) = '' OR (len({ws}) > 0 AND NOT list_has_any({ws}, {list(T.LOCAL_WORDS)!r})))"


_ENGLISH_SQL = _CONVS + f""", k AS (SELECT conv_id, ms FROM c WHERE len(list_filter(ms, lambda m: NOT {_english("m.content")})) = 0 AND len(ms) >= 2),
o AS (SELECT conv_id, CASE WHEN ms[2].role = 'assistant' THEN ms[1:1] || ms[3:] ELSE ms END AS ms FROM k)
SELECT conv_id, {_FLAT.format("ms")} AS shape FROM o WHERE len(ms) >= 2"""


def conv_sink(spark, sf_dir):
    return convs(spark, sf_dir).where(corpus.writable(F.col("messages"))).select("conv_id", F.size("messages").cast("long").alias("n_messages"))


def exact_dedupe(spark, sf_dir):
    """Conversations by the role and content of every message; of equal ones the first stays."""
    c = convs(spark, sf_dir)
    c = c.unionByName(c.where("conv_id % 3 = 0").withColumn("conv_id", F.col("conv_id") + 1_000_000_000))  # with copies
    return corpus.first_of_equal(c, F.to_json("messages"), "conv_id").select("conv_id", _flat(F.col("messages")).alias("shape"))


def split_hash(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return corpus.split_train(d, F.col("doc_id")).select("doc_id", "part")


def overlap_dedupe(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return corpus.overlap_deduped(d.select("doc_id", F.split("text", "\n").alias("lines")), "doc_id", "lines").select("doc_id")


def edited_pairs(spark, sf_dir):
    t = turns(spark, sf_dir)
    doubled = t.unionByName(t.where("turn % 3 = 1").withColumn("turn", F.col("turn") * 10 + 5).withColumn("text", F.concat("text", F.lit(" (edited)"))).withColumn("turn", F.col("turn")))
    return corpus.edited_dropped(t.withColumn("turn", F.col("turn") * 10).unionByName(doubled.where("text like '% (edited)'"))).select("conv_id", "turn", "role", F.length("text").cast("long").alias("chars"))


def corpus_stats(spark, sf_dir):
    c = conv_validate(spark, sf_dir)
    n, ok = F.count(F.lit(1)), F.count_if(F.col("reason") == "valid")
    return c.agg(n.alias("total"), ok.alias("valid"), (n - ok).alias("invalid"), F.round(ok / F.greatest(F.lit(1), n), 3).alias("rate"))


def rejection_samples(spark, sf_dir):
    from pyspark.sql import Window

    q = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.substring("text", 1, 200).alias("preview"), T.quality_log(F.col("text"))["reason"].alias("reason"))
    n = F.row_number().over(Window.partitionBy("reason").orderBy("doc_id"))
    return q.where("reason is not null").withColumn("n", n).where("n <= 20").select("doc_id", "preview", "reason")


def type_counts(spark, sf_dir):
    return events(spark, sf_dir).groupBy("sender").agg(F.count(F.lit(1)).alias("messages"), F.countDistinct("chat").alias("chats"))


from loomline.plans.text_plans import _QUALITY_CTE  # noqa: E402

QUERIES = {
    "session_gap": (session_gap, _GAPS + " SELECT event_id, gap_us, burst, session FROM s"),
    "session_turn": (session_turn, _TURN_SQL),
    "session_stats": (session_stats, _STATS_SQL),
    "context_window": (context_window, _CONTEXT_SQL),
    "recent_share_filter": (recent_share, _SHARE_SQL),
    "message_types": (
        message_types,
        """WITH p AS (SELECT page_id, html AS c, lower(url) AS l, page_id % 3 = 0 AS shared, page_id % 5 = 0 AS photo FROM pages) SELECT page_id, CASE WHEN shared AND contains(l, 'reel') THEN 'reel_share'
 WHEN shared AND (contains(l, 'giphy.com') OR contains(l, 'gif')) THEN 'gif' WHEN shared THEN 'post_share' WHEN photo AND coalesce(c, '') = '' THEN 'photo' WHEN contains(c, 'Reacted') OR contains(c, 'Liked a message') THEN 'reaction'
 WHEN trim(coalesce(c, '')) = '' THEN 'empty' WHEN contains(c, 'sent an attachment') THEN 'attachment_text' ELSE 'text' END AS kind FROM p""",
    ),
    "energy_reciprocity": (reciprocity, _RECIPROCITY_SQL),
    "log_messages": (log_messages, _LOG_SQL),
    "rate_limit_batch": (rate_limit, None),
    "type_counts": (type_counts, "SELECT event_type AS sender, count(*) AS messages, count(DISTINCT user_id) AS chats FROM events GROUP BY 1"),
    "conv_validate": (conv_validate, _VALIDATE_SQL),
    "conv_repair": (conv_repair, _CONVS + f" SELECT conv_id, {_FLAT.format(_REPAIRED)} AS shape FROM c"),
    "conv_merge_roles": (conv_merge_roles, _MERGE_SQL),
    "conv_filler": (conv_filler, _FILLER_SQL),
    "conv_english": (conv_english, _ENGLISH_SQL),
    "conv_sink": (
        conv_sink,
        _CONVS + " SELECT conv_id, CAST(len(ms) AS BIGINT) AS n_messages FROM c WHERE len(ms) >= 2 AND len(list_filter(ms, lambda m: m.role NOT IN ('system', 'user', 'assistant') OR trim(m.content) = '')) = 0",
    ),
    "exact_dedupe": (
        exact_dedupe,
        _CONVS + f", s AS (SELECT conv_id, ms FROM c UNION ALL SELECT conv_id + 1000000000, ms FROM c WHERE conv_id % 3 = 0) SELECT min(conv_id) AS conv_id, {_FLAT.format('ms')} AS shape FROM s GROUP BY ms",
    ),
    "split_hash": (
        split_hash,
        "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || '|42'), doc_id) AS r, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN r <= floor(n * 0.9) THEN 'train' ELSE 'val' END AS part FROM r",
    ),
    "overlap_dedupe": (overlap_dedupe, None),
    "edited_pairs": (edited_pairs, None),
    "corpus_stats": (
        corpus_stats,
        _VALIDATE_SQL.replace("SELECT conv_id, CASE WHEN len(ms) < 2", ", v AS (SELECT conv_id, CASE WHEN len(ms) < 2").replace(", b AS", ", b AS", 1)
        + ") SELECT count(*) AS total, count(*) FILTER (reason = 'valid') AS valid, count(*) - count(*) FILTER (reason = 'valid') AS invalid, round(CAST(count(*) FILTER (reason = 'valid') AS DOUBLE) / greatest(1, count(*)), 3) AS rate FROM v",
    ),
    "rejection_samples": (
        rejection_samples,
        _QUALITY_CTE + ", n AS (SELECT doc_id, reason, row_number() OVER (PARTITION BY reason ORDER BY doc_id) AS k FROM q WHERE reason IS NOT NULL) SELECT n.doc_id, substr(text, 1, 200) AS preview, reason FROM n JOIN documents ON documents.doc_id = n.doc_id WHERE k <= 20",
    ),
}
