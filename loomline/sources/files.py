"""Readers and writers: chat logs, JSON exports, JSON lines, input lists, blocks, keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.operators import corpus

EXPORT = (
    "participants ARRAY<STRUCT<name: STRING>>, messages ARRAY<STRUCT<sender_name: STRING, timestamp_ms: BIGINT, content: STRING, "
    "share: STRUCT<link: STRING, share_text: STRING>, photos ARRAY<STRUCT<uri: STRING>>, reactions ARRAY<STRUCT<reaction: STRING>>>>"
).replace("photos ARRAY", "photos: ARRAY").replace("reactions ARRAY", "reactions: ARRAY")


def text_log(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 0), line of text logs: UTF-8 where all of a file is, else Latin-1.

    Files are read in splits, line by line as bytes. One pass over them gives each file's encoding and each split's number
    of lines, so a file of any size takes as many tasks as it has splits, and lines are numbered within splits.
    """
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    raw = spark.read.text(path).select(*where, "value", F.monotonically_increasing_id().alias("at"))
    splits = raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.is_valid_utf8("value")).alias("utf8"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    known = splits.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.min("utf8").over(Window.partitionBy("file")).alias("utf8"))
    place = F.row_number().over(Window.partitionBy("file", "block").orderBy("at")) - 1
    joined = raw.withColumn("place", place).join(known, ["file", "block"])
    line = F.when(F.col("utf8"), F.col("value")).otherwise(F.decode(F.col("value").cast("binary"), "ISO-8859-1"))
    return joined.select("file", (F.col("place") + F.col("before")).cast("long").alias("line_no"), line.alias("line"))


def json_export(spark: SparkSession, path: str) -> DataFrame:
    """file, seq (from the oldest) and message fields of JSON exports, which list the newest first."""
    raw = spark.read.schema(EXPORT).json(path, multiLine=True).withColumn("file", F.input_file_name())
    one = raw.select("file", F.size("messages").alias("n"), F.posexplode("messages").alias("pos", "m"))
    return one.select("file", (F.col("n") - F.col("pos")).alias("seq"), "m.*")


def json_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """messages and malformed of each line that is not blank; malformed lines have null messages."""
    kept = lines.where(F.trim(col) != "")
    parsed = F.from_json(col, f"messages {corpus.MESSAGES}, _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return kept.withColumn("_p", parsed).select(*[c for c in lines.columns if c != col], F.col("_p.messages").alias("messages"), F.col("_p._bad").isNotNull().alias("malformed"))


def listed_inputs(lines: DataFrame, col: str = "value") -> DataFrame:
    """lines trimmed, without blank ones and comments."""
    return lines.withColumn(col, F.trim(col)).where((F.col(col) != "") & ~F.startswith(F.col(col), F.lit("#")))


def resolved_inputs(spark: SparkSession, values: list[str] | None = None, path: str | None = None) -> DataFrame:
    """n, value of the inputs that a user gives, either directly or as a file, trimmed and without blank ones.

    A .json file is a list of texts; another has one input a line, and comments. Both or neither of the two ways, a list
    of something else, and no input at all are errors (ValueError).
    """
    if bool(values) == bool(path):
        raise ValueError("give either values or a file of them")
    if path and path.lower().endswith(".json"):
        whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
        kind = whole.select(F.schema_of_variant("v")).first()
        if kind is None or kind[0] not in ("ARRAY<STRING>", "ARRAY<VOID>") or not whole.where(F.exists(F.variant_get("v", "$", "array<string>"), lambda x: x.isNull())).isEmpty():
            raise ValueError(f"{path} is no list of texts")
        got = whole.select(F.posexplode(F.variant_get("v", "$", "array<string>")).alias("n", "value"))
        got = got.select(F.col("n").cast("long"), F.trim("value").alias("value")).where("value <> ''")
    elif path:
        got = listed_inputs(text_log(spark, path).select(F.col("line_no").alias("n"), F.col("line").alias("value")))
    else:
        got = spark.createDataFrame([(n, v) for n, v in enumerate(values or [])], "n long, value string").select("n", F.trim("value").alias("value")).where("value <> ''")
    if got.isEmpty():
        raise ValueError("no inputs")
    return got


def conversations_to_lines(conversations: DataFrame) -> DataFrame:
    """One JSON text for each conversation that the sink accepts."""
    return conversations.where(corpus.writable(F.col("messages"))).select(F.to_json(F.struct("messages")).alias("value"))


def append_new(history: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """history and the rows whose keys it lacks, the first of each key."""
    order = Window.partitionBy(*keys).orderBy(*[F.col(c) for c in rows.columns])
    fresh = rows.join(history.select(*keys).distinct(), keys, "left_anti").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return history.unionByName(fresh)


def playlist_text(files: DataFrame, group: str, name: str, order: str) -> DataFrame:
    """group and text: the playlist header and its file names in order."""
    each = F.transform(F.array_sort(F.collect_list(F.struct(order, name))), lambda f: f[name])
    return files.groupBy(group).agg(F.concat(F.lit("#EXTM3U\n"), F.array_join(each, "\n")).alias("text"))


def has_suffix(path: Column, suffixes: list[str]) -> Column:
    """Whether a path ends in one of the suffixes, whatever their case and with or without the dot."""
    dotted = [s.lower() if s.startswith(".") else "." + s.lower() for s in suffixes]
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).isin(*dotted)
