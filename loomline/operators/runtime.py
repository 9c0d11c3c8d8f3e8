"""Tasks, queues, artifacts: estimates, labels, waits, summaries."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.operators.folds import folded

# Initial estimates by service (base and per-item seconds, style), and the fallback.
ESTIMATES = (
    ("media.instagram_auth", 300, 0, "user_wait"),
    ("media.youtube", 90, 360, "approx"),
    ("media.public_user", 90, 180, "approx"),
    ("media.private_user", 120, 180, "approx"),
    ("media.post", 90, 180, "approx"),
    ("media.ig_bulk", 90, 180, "approx"),
    ("media.clean_bulk", 30, 90, "approx"),
    ("music.song", 20, 55, "approx"),
    ("music.yt", 15, 45, "approx"),
    ("music.link", 30, 60, "approx"),
    ("music.user_playlists", 45, 0, "approx"),
    ("music.user_download", 20, 45, "approx"),
    ("music.candidate_download", 15, 45, "approx"),
    ("telegram.agent", 30, 0, "open_ended"),
)
FALLBACK = (60, 120, "approx")
SHARED_SESSION = ("media.instagram_auth", "media.public_user", "media.private_user", "media.post", "media.ig_bulk")
# Progress messages and the seconds they stand for (base, then per captured number).
PROGRESS = (
    (r"(?i)Fetched\s+\d+\s+post\(s\):\s+(\d+)\s+visual,\s+(\d+)\s+reel/video,\s+(\d+)\s+other", 60, (75, 240, 45)),
    (r"(?i)Running OCR for\s+(\d+)\s+Instagram image", 45, (60,)),
    (r"(?i)Transcribing\s+(\d+)\s+Instagram video", 60, (240,)),
    (r"(?i)Processing\s+(\d+)\s+new post", 60, (150,)),
    (r"(?i)Resolved Spotify metadata:\s+(\d+)\s+track", 30, (45,)),
    (r"(?i)Downloading\s+(\d+)\s+YouTube match", 20, (45,)),
)
TRANSCRIPTION = r"(?i)Estimated transcription time:\s*(?:(\d+)\s*min\s*)?(\d+)\s*sec"


def lane(service: Column) -> Column:
    return (
        F.when(service == "media.instagram_auth", "auth")
        .when(F.startswith(service, F.lit("music.")), "music")
        .when(F.startswith(service, F.lit("telegram.")), "agent")
        .otherwise("heavy_media")
    )


def lane_label(of: Column) -> Column:
    named = F.when(of == "heavy_media", "Media / ML").when(of == "music", "Music")
    return F.coalesce(named, F.initcap(F.replace(of, F.lit("_"), F.lit(" "))))


def exclusive_group(service: Column) -> Column:
    return F.when(service.isin(*SHARED_SESSION), "instagram_session")


def status_variant(status: Column) -> Column:
    return (
        F.when(status == "completed", "success")
        .when(status == "failed", "danger")
        .when(status.isin("cancelled", "needs_review"), "warning")
        .when(status == "running", "accent")
        .otherwise("muted")
    )


def with_estimates(tasks: DataFrame, items: Column, service: str = "service") -> DataFrame:
    """tasks with estimate (seconds, 15 at least) and style; the dimension has 14 rows, so it is broadcast."""
    known = tasks.sparkSession.createDataFrame(list(ESTIMATES), f"{service} string, _base int, _per int, style string")
    joined = tasks.join(F.broadcast(known), service, "left")
    base, per = F.coalesce("_base", F.lit(FALLBACK[0])), F.coalesce("_per", F.lit(FALLBACK[1]))
    value = F.greatest(base + per * F.greatest(items, F.lit(1)), F.lit(15))
    return joined.withColumn("estimate", value.cast("long")).withColumn("style", F.coalesce("style", F.lit(FALLBACK[2]))).drop("_base", "_per")


# Where a task's number of items may stand, on top and within workload.
COUNTS = ("submitted_count", "track_count", "url_count", "input_count", "item_count")
WORKLOAD = ("submitted_count", "posts", "tracks", "urls", "inputs")


def submitted_count(meta: Column) -> Column:
    """Items of a task: the first positive count of its meta (JSON), else of the workload in it, else 1."""
    tree = F.try_parse_json(meta)
    paths = [f"$.{k}" for k in COUNTS] + [f"$.workload.{k}" for k in WORKLOAD]
    counts = [F.try_variant_get(tree, p, "long") for p in paths]
    return F.coalesce(*[F.when(c > 0, c) for c in counts], F.lit(1).cast("long"))


def remaining_seconds(status: Column, started: Column, runtime: Column, now: Column) -> Column:
    """Seconds that a task has left at now (timestamps): its runtime less what has passed while it runs, 15 at least; a
    task that does not run, or of which no start is known, has all of it."""
    passed = F.greatest(F.floor((F.unix_micros(now) - F.unix_micros(started)) / 1_000_000), F.lit(0))
    return F.when((status == "running") & started.isNotNull(), F.greatest(runtime - passed, F.lit(15))).otherwise(runtime).cast("long")


def event_seconds(message: Column) -> Column:
    """Seconds that a progress message asks for, null if it asks for none; an estimate is the largest so far."""
    options = []
    for pattern, base, weights in PROGRESS:
        total = F.lit(base)
        for i, w in enumerate(weights, 1):
            total = total + F.regexp_extract(message, pattern, i).try_cast("int") * w
        options.append(F.when(F.rlike(message, F.lit(pattern)), total))
    minutes, seconds = (F.coalesce(F.regexp_extract(message, TRANSCRIPTION, i).try_cast("int"), F.lit(0)) for i in (1, 2))
    options.append(F.when(F.rlike(message, F.lit(TRANSCRIPTION)), minutes * 60 + seconds + 45))
    return F.greatest(*options)


def duration_label(seconds: Column, prefix: str = "") -> Column:
    """1h 05m, 2m 03s, 12m or 9s; Now for 0 and Calculating for null."""
    s = F.greatest(seconds.cast("long"), F.lit(0))
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    two = lambda v: F.lpad(v.cast("string"), 2, "0")
    text = (
        F.when(h > 0, F.concat(h.cast("string"), F.lit("h "), two(m), F.lit("m")))
        .when((m > 0) & (r > 0) & (m < 10), F.concat(m.cast("string"), F.lit("m "), two(r), F.lit("s")))
        .when(m > 0, F.concat(m.cast("string"), F.lit("m")))
        .otherwise(F.concat(r.cast("string"), F.lit("s")))
    )
    return F.when(seconds.isNull(), "Calculating").when(s == 0, "Now").otherwise(F.concat(F.lit(prefix), text))


def short_label(seconds: Column) -> Column:
    """1m 05s or 9s; null for null and 0."""
    s = F.greatest(seconds.cast("long"), F.lit(0))
    m = F.floor(s / 60)
    text = F.when(m > 0, F.concat(m.cast("string"), F.lit("m "), F.lpad((s % 60).cast("string"), 2, "0"), F.lit("s"))).otherwise(F.concat(s.cast("string"), F.lit("s")))
    return F.when(seconds != 0, text)


def transcription_label(seconds: Column) -> Column:
    total = F.floor(F.when(seconds >= 180, 75 + seconds * 1.15).otherwise(210 + seconds * 0.9))
    text = F.when(total >= 60, F.concat(F.floor(total / 60).cast("string"), F.lit(" min "), (total % 60).cast("string"), F.lit(" sec"))).otherwise(F.concat(total.cast("string"), F.lit(" sec")))
    return F.when((seconds.isNull()) | (seconds == 0), "Unknown").otherwise(text)


def elapsed_seconds(start: str, end: str) -> Column:
    """Whole seconds between two ISO times, 0 at least, null if either cannot be read."""
    a, b = (F.try_to_timestamp(F.col(c)) for c in (start, end))
    seconds = F.floor((F.unix_micros(b) - F.unix_micros(a)) / 1_000_000)
    return F.when(seconds.isNotNull(), F.greatest(seconds, F.lit(0)))


def queue_positions(queued: DataFrame, lane_col: str = "lane", order: str = "seq") -> DataFrame:
    return queued.withColumn("queue_position", F.row_number().over(Window.partitionBy(lane_col).orderBy(order)).cast("long"))


def single_waits(queued: DataFrame, remaining: Column, lane_col: str = "lane", order: str = "seq", runtime: str = "estimate") -> DataFrame:
    """queued with wait and total for lanes of one slot: what runs now, then every job before."""
    before = Window.partitionBy(lane_col).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    wait = remaining + F.coalesce(F.sum(runtime).over(before), F.lit(0))
    return queued.withColumn("wait", wait.cast("long")).withColumn("total", (F.col("wait") + F.col(runtime)).cast("long"))


def slot_waits(queued: DataFrame, capacity: int, remaining: Column | None = None, lane_col: str = "lane", order: str = "seq", runtime: str = "estimate") -> DataFrame:
    """lane, seq, wait for lanes of several slots: each job takes the slot that is free first.

    remaining: seconds that the job's exclusive group is still busy (null: it has none); no job of the group starts
    before, and queued jobs do not extend it. Jobs with a null runtime take no time.
    """
    rest = F.lit(0) if remaining is None else F.coalesce(remaining, F.lit(0))
    jobs = queued.select(lane_col, F.col(order).cast("long").alias("seq"), F.coalesce(F.col(runtime), F.lit(0)).cast("long").alias("r"), rest.cast("long").alias("g"))

    def step(slots: list, job) -> int:
        wait = max(heapq.heappop(slots), job.g)
        heapq.heappush(slots, wait + job.r)
        return wait

    return folded(jobs, lane_col, ["seq"], lambda: [0] * capacity, step, "wait long").select(lane_col, "seq", "wait")


def queue_summary(tasks: DataFrame, lane_col: str = "lane", order: str = "seq", label: str = "service") -> DataFrame:
    """Per lane: queued and running tasks, and the label of the first queued one."""
    queued = F.col("status") == "queued"
    return tasks.groupBy(lane_col).agg(
        F.count_if(queued).alias("queued"), F.count_if(F.col("status") == "running").alias("running"), F.min_by(F.when(queued, F.col(label)), F.when(queued, F.col(order))).alias("first_queued")
    )


def bundled(files: DataFrame, task: str = "task_id", most: int = 10) -> DataFrame:
    """Per task: files, whether they go into one archive, and how many artifacts there are (media: the archive alone)."""
    got = files.groupBy(task).agg(F.count(F.lit(1)).alias("files"))
    big = F.col("files") > most
    return got.select(task, "files", big.alias("bundled"), F.when(big, 1).otherwise(F.col("files")).cast("long").alias("artifacts_media"), F.when(big, F.col("files") + 1).otherwise(F.col("files")).cast("long").alias("artifacts_music"))
