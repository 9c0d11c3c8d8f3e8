"""What is decided on finished tasks: artifacts, trays, reviews, counts, lookups. Column to Column or DataFrame to DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Suffixes of audio files, services whose artifacts a tray shows, values that stand for no secret, and
# the form of a session id.
AUDIO_SUFFIXES = (".aac", ".aiff", ".alac", ".flac", ".m4a", ".mp3", ".oga", ".ogg", ".opus", ".wav", ".weba", ".webm")
TRAY_SERVICES = ("music.song", "music.yt", "music.link", "music.user_download", "music.candidate_download")
NO_SECRETS = ("", "replace-me", "changeme", "change-me", "todo", "none", "null")
SESSION_ID = r"^[A-Za-z0-9_-]{20,128}$"


def is_audio(content_type: Column, name: Column) -> Column:
    """An audio content type, or else a name with an audio suffix; null counts as empty."""
    suffix = F.regexp_extract(F.lower(F.coalesce(name, F.lit(""))), r"\.[^.]*$", 0)
    return F.startswith(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("audio/")) | suffix.isin(*AUDIO_SUFFIXES)


def in_tray(service: Column, status: Column, artifacts: Column, session: Column, client: Column, own_session: Column, own_client: Column) -> Column:
    """A completed download with artifacts, of this session or this client; empty and null ids match nothing."""
    same = lambda a, b: F.coalesce((a != "") & (a == b), F.lit(False))
    done = service.isin(*TRAY_SERVICES) & (status == "completed") & (artifacts > 0)
    return F.coalesce(done, F.lit(False)) & (same(own_session, session) | same(own_client, client))


def needs_review(review_count: Column, items: Column) -> Column:
    """A count over zero, or an item (status, candidates) that waits for review or has candidates."""
    waits = F.exists(
        F.coalesce(items, F.array().cast("array<struct<status:string,candidates:array<string>>>")),
        lambda i: (F.replace(F.lower(F.trim(F.coalesce(i["status"], F.lit("")))), F.lit(" "), F.lit("_")) == "needs_review") | (F.size(F.coalesce(i["candidates"], F.array().cast("array<string>"))) > 0),
    )
    return F.coalesce(review_count > 0, F.lit(False)) | waits


def is_secret(value: Column) -> Column:
    """Whether a setting holds a secret and no placeholder; quotes and blanks around it do not count."""
    return ~F.lower(F.trim(F.coalesce(value, F.lit("")))).isin(*NO_SECRETS)


def is_session_id(value: Column) -> Column:
    return F.coalesce(F.rlike(value, F.lit(SESSION_ID)), F.lit(False))


def result_stats(items: DataFrame, task: str, status: str) -> DataFrame:
    """Per task: submitted, completed, failed and needs_review counts of its items."""
    count = lambda v: F.count_if(F.col(status) == v).alias(v)
    return items.groupBy(task).agg(F.count(F.lit(1)).alias("submitted"), count("completed"), count("failed"), count("needs_review"))


def tasks_of_jobs(jobs: DataFrame, tasks: DataFrame, job: str = "job_id") -> DataFrame:
    """jobs with the columns of the task that each belongs to; jobs without one go."""
    return jobs.join(tasks, job)


def projected(refs: DataFrame, known: DataFrame, name: str, position: str) -> DataFrame:
    """The known rows that refs name, with the position of the name, each name at its first one."""
    first = refs.groupBy(name).agg(F.min(position).alias(position))
    return first.join(known, name)
