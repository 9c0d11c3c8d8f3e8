"""Operators on results and on exported messages, with the SQL each must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.operators import chat, results, runtime
from loomline.plans.catalogue_plans import _TASKS, t, tasks
from loomline.plans.text_plans import _WORDS, docs


def export_quality(spark, sf_dir):
    got = docs(spark, sf_dir).select("doc_id", T.quality_export(F.col("text")).alias("q"))
    return got.select("doc_id", F.col("q.repetition").cast("long").alias("repetition"), F.col("q.marks").cast("long").alias("marks"), F.round("q.score", 6).alias("score"), "q.reason")


_RUNS = r"""s AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[.!?]+')) AS s, generate_subscripts(string_split_regex(lower(text), '[.!?]+'), 1) AS k FROM documents),
w AS (SELECT doc_id, k, unnest(list_filter(string_split_regex(s, '\s+'), lambda x: x <> '')) AS w, generate_subscripts(list_filter(string_split_regex(s, '\s+'), lambda x: x <> ''), 1) AS i FROM s),
e AS (SELECT doc_id, k, i, w = lag(w) OVER (PARTITION BY doc_id, k ORDER BY i) AS same FROM w),
g AS (SELECT doc_id, k, i - row_number() OVER (PARTITION BY doc_id, k ORDER BY i) AS run FROM e WHERE same),
r AS (SELECT doc_id, max(n) + 1 AS r FROM (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id, k, run) GROUP BY doc_id)"""
_STORY = " + ".join(f"CAST(contains(lower(text), '{p}') AS INT)" for p in T.STORY_PHRASES)
_EXPORT_SQL = f"""WITH {_RUNS}, d AS (SELECT d.doc_id, text, {_WORDS} AS ws, coalesce(r.r, 0) AS r FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id),
m AS (SELECT doc_id, text, len(ws) AS n, CASE WHEN len(ws) >= 10 THEN CAST(len(list_distinct(ws)) AS DOUBLE) / len(ws) ELSE 0 END AS diversity,
 CASE WHEN len(ws) >= 10 THEN r ELSE 0 END AS repetition, CASE WHEN len(ws) >= 50 THEN CAST(len(list_filter(ws, lambda w: w IN {T.PRONOUNS_EXPORT!r})) AS DOUBLE) / len(ws) ELSE 0 END AS third,
 CASE WHEN len(ws) >= 50 THEN {_STORY} ELSE 0 END AS marks FROM d),
q AS (SELECT *, (CASE WHEN diversity > 0 THEN 0.6 + 0.4 * least(diversity / 0.4, 1.0) ELSE 1 END) * (CASE WHEN repetition > 2 THEN 1 - 0.3 * least(repetition / 5, 1.0) ELSE 1 END)
 * (1 - (CASE WHEN third > 0.1 THEN 0.15 * least(third / 0.3, 1.0) ELSE 0 END) - (CASE WHEN marks > 0 THEN 0.15 * least(marks / 3, 1.0) ELSE 0 END)) AS score FROM m)
SELECT doc_id, CAST(repetition AS BIGINT) AS repetition, CAST(marks AS BIGINT) AS marks, round(CAST(score AS DOUBLE), 6) AS score, CASE WHEN text IS NULL OR length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) < 2 THEN 'too_short' WHEN length(text) > 2000 THEN 'too_long'
 WHEN n < 1 THEN 'insufficient_words' WHEN n >= 10 AND diversity < 0.4 THEN 'low_lexical_diversity' WHEN repetition > 5 THEN 'excessive_repetition' WHEN third > 0.3 THEN 'high_third_person' WHEN marks > 3 THEN 'narrative_detected' WHEN score < 0.5 THEN 'low_quality_score' END AS reason FROM q"""
SENTENCE_SQL = f"WITH {_RUNS}, o AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id) SELECT d.doc_id, CAST(coalesce(r.r, CASE WHEN o.n > 0 THEN 1 ELSE 0 END) AS BIGINT) AS repetition FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id LEFT JOIN o ON o.doc_id = d.doc_id"


def export_validity(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    text = F.when(F.col("page_id") % 7 == 0, "").when(F.col("page_id") % 11 == 0, F.substring_index("html", "<", 2)).otherwise(F.col("html"))
    kind = chat.message_type(text, F.col("url"), F.col("page_id") % 3 == 0, F.col("page_id") % 5 == 0)
    return p.select("page_id", kind.alias("kind"), chat.export_valid(kind, text).alias("valid"))


_VALID_SQL = r"""WITH h AS (SELECT page_id, lower(url) AS l, page_id % 3 = 0 AS shared, page_id % 5 = 0 AS photo, CASE WHEN page_id % 7 = 0 THEN '' WHEN page_id % 11 = 0 THEN array_to_string(string_split(html, '<')[1:2], '<') ELSE html END AS c FROM pages),
k AS (SELECT *, CASE WHEN shared AND contains(l, 'reel') THEN 'reel_share' WHEN shared AND (contains(l, 'giphy.com') OR contains(l, 'gif')) THEN 'gif' WHEN shared THEN 'post_share' WHEN photo AND coalesce(c, '') = '' THEN 'photo'
 WHEN contains(c, 'Reacted') OR contains(c, 'Liked a message') THEN 'reaction' WHEN trim(coalesce(c, '')) = '' THEN 'empty' WHEN contains(c, 'sent an attachment') THEN 'attachment_text' ELSE 'text' END AS kind FROM h)
SELECT page_id, kind, CASE WHEN kind = 'text' THEN length(trim(c)) >= 2 AND length(c) <= 2000 AND regexp_matches(c, '[\p{L}\p{N}_]') ELSE kind IN ('post_share', 'photo') END AS valid FROM k"""


def audio_artifacts(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (F.col("p_partkey") % len(v) + 1).cast("int"))
    kind, suffix = pick("audio/mpeg", "Audio/X-New", "video/mp4", "", "text/plain", "application/zip", "x"), pick(".MP3", ".txt", "", ".flac.zip", ".opus")
    return p.select("p_partkey", results.is_audio(kind, F.concat("p_name", suffix)).alias("audio"))


def tray_members(spark, sf_dir):
    k = tasks(spark, sf_dir).withColumn("own", F.concat(F.lit("s"), (F.col("seq") % 7).cast("string"))).withColumn("mine", F.when(F.col("seq") % 2 == 0, F.concat(F.lit("c"), (F.col("seq") % 5).cast("string"))))
    member = results.in_tray(F.col("service"), F.col("status"), F.col("items"), F.lit("s3"), F.lit("c2"), F.col("own"), F.col("mine"))
    return k.where(member).select("seq", "service")


def reviews(spark, sf_dir):
    l = t(spark, sf_dir, "lineitem")
    status = F.when(F.col("l_returnflag") == "R", " Needs Review ").when(F.col("l_returnflag") == "A", "failed").otherwise("completed")
    found = F.when(F.col("l_quantity") > 49, F.array(F.col("l_linestatus")))
    got = l.groupBy("l_orderkey").agg(F.collect_list(F.struct(status.alias("status"), found.alias("candidates"))).alias("items"), F.count_if(F.col("l_discount") == 0.1).alias("n"))
    return got.select("l_orderkey", results.needs_review(F.when(F.col("n") > 1, F.col("n")), F.col("items")).alias("review"))


def result_counts(spark, sf_dir):
    l = t(spark, sf_dir, "lineitem")
    status = F.when(F.col("l_returnflag") == "R", "needs_review").when(F.col("l_returnflag") == "A", "failed").otherwise("completed")
    return results.result_stats(l.select("l_suppkey", status.alias("status")), "l_suppkey", "status")


def job_tasks(spark, sf_dir):
    jobs = t(spark, sf_dir, "lineitem").where("l_returnflag = 'N'").select(F.concat(F.lit("job-"), F.col("l_orderkey").cast("string")).alias("job_id"), "l_linenumber")
    known = tasks(spark, sf_dir).where("status = 'queued'").select(F.concat(F.lit("job-"), F.col("seq").cast("string")).alias("job_id"), "seq", "lane")
    return results.tasks_of_jobs(jobs, known)


def ordered_projection(spark, sf_dir):
    refs = t(spark, sf_dir, "orders").select(F.concat(F.lit("Customer#"), F.lpad((F.col("o_custkey") * 2).cast("string"), 9, "0")).alias("c_name"), F.col("o_orderkey").alias("position"))
    return results.projected(refs, t(spark, sf_dir, "customer").select("c_name", "c_custkey"), "c_name", "position")


def secrets(spark, sf_dir):
    c = t(spark, sf_dir, "customer")
    value = F.element_at(F.array(F.lit(" ChangeMe "), F.col("c_name"), F.lit(""), F.lit("TODO"), F.concat("c_name", F.lit("_"), "c_mktsegment")), (F.col("c_custkey") % 5 + 1).cast("int"))
    return c.select("c_custkey", results.is_secret(value).alias("secret"), results.is_session_id(value).alias("session_id"))


def elapsed(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("event_id", F.col("ts").cast("string").alias("started"), F.when(F.col("event_id") % 10 > 0, (F.col("ts") + F.make_dt_interval(secs=F.col("event_id") % 7000 - 500)).cast("string")).otherwise("soon").alias("finished"))
    return e.select("event_id", runtime.elapsed_seconds("started", "finished").cast("long").alias("seconds"))


QUERIES = {
    "export_quality": (export_quality, _EXPORT_SQL),
    "export_validity": (export_validity, _VALID_SQL),
    "audio_artifacts": (audio_artifacts, f"SELECT p_partkey, starts_with(lower(['audio/mpeg', 'Audio/X-New', 'video/mp4', '', 'text/plain', 'application/zip', 'x'][p_partkey % 7 + 1]), 'audio/') OR regexp_extract(lower(p_name || ['.MP3', '.txt', '', '.flac.zip', '.opus'][p_partkey % 5 + 1]), '\\.[^.]*$') IN {results.AUDIO_SUFFIXES!r} AS audio FROM part"),
    "tray_members": (tray_members, _TASKS + f" SELECT seq, service FROM k WHERE service IN {results.TRAY_SERVICES!r} AND status = 'completed' AND items > 0 AND (seq % 7 = 3 OR (seq % 2 = 0 AND seq % 5 = 2))"),
    "needs_review": (reviews, "SELECT l_orderkey, count(*) FILTER (l_discount = 0.1) > 1 OR bool_or(l_returnflag = 'R' OR (l_quantity > 49 AND l_linestatus IS NOT NULL)) AS review FROM lineitem GROUP BY 1"),
    "result_stats": (result_counts, "SELECT l_suppkey, count(*) AS submitted, count(*) FILTER (l_returnflag NOT IN ('R', 'A')) AS completed, count(*) FILTER (l_returnflag = 'A') AS failed, count(*) FILTER (l_returnflag = 'R') AS needs_review FROM lineitem GROUP BY 1"),
    "job_tasks": (job_tasks, _TASKS + " SELECT 'job-' || l_orderkey AS job_id, l_linenumber, seq, lane FROM lineitem JOIN k ON seq = l_orderkey WHERE l_returnflag = 'N' AND status = 'queued'"),
    "ordered_projection": (ordered_projection, "WITH r AS (SELECT 'Customer#' || lpad(CAST(o_custkey * 2 AS VARCHAR), 9, '0') AS c_name, min(o_orderkey) AS position FROM orders GROUP BY 1) SELECT r.c_name, position, c_custkey FROM r JOIN customer ON customer.c_name = r.c_name"),
    "secrets": (secrets, f"WITH v AS (SELECT c_custkey, [' ChangeMe ', c_name, '', 'TODO', c_name || '_' || c_mktsegment][c_custkey % 5 + 1] AS v FROM customer) SELECT c_custkey, lower(trim(v)) NOT IN {results.NO_SECRETS!r} AS secret, regexp_full_match(v, '[A-Za-z0-9_-]{{20,128}}') AS session_id FROM v"),
    "elapsed_seconds": (elapsed, "SELECT event_id, CASE WHEN event_id % 10 > 0 THEN CAST(greatest(event_id % 7000 - 500, 0) AS BIGINT) END AS seconds FROM events"),
}
