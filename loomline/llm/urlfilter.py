"""URL verdicts from host and path rules, in DataFrame functions only.

A URL expands to its host suffixes joined with its path prefixes (as many labels as the longest rule host has, the
prefix lengths that rules have). Expressions meet rules in an equi-join on the first PREFIX hex digits of their
SHA-256, full digests confirm, and the longest rule wins. Only distinct URLs are expanded, so a URL that a third of
the rows share is matched once; the join back of the rules found is between two stored inputs, so that Spark's
adaptive execution can split such a URL's rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.store import save

PREFIX = 8
MAX_BROADCAST_RULES = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty if there is none."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, "^[^/?#]*+", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty if there is no host."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*+([^?#]*+)", 1), F.lit(""))


def expressions(host: Column, path: Column, labels: int, lengths: Sequence[int]) -> Column:
    """Suffixes of up to so many labels, each with the prefixes of these lengths that the path has."""
    parts = F.split(host, "\\.", -1)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))),
        lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."),
    )
    prefixes = F.transform(
        F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n)
    )
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict for every row. rules: (verdict, host, path) triples.

    A rule fits its host and all subdomains if the path starts with its own. The longest host and path together win,
    then the longest host; of equal rules block wins. Null URLs and those without :// have an empty host and path;
    without a fitting rule, rule is null and verdict is default. Repeated rows are all judged; other columns are
    ignored; an empty table gives an empty result.
    """
    spark: SparkSession = pages.sparkSession
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    judged = rows.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not rules:
        return judged.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    known = spark.createDataFrame([(v, h, p) for v, h, p in rules], "verdict string, rule_host string, rule_path string")
    digest = F.sha2(F.concat("rule_host", "rule_path"), 256)
    known = known.withColumn("rule", F.concat("rule_host", "rule_path")).withColumn("digest", digest).withColumn("short", F.substring(digest, 1, PREFIX))
    known = F.broadcast(known) if len(rules) <= MAX_BROADCAST_RULES else known
    labels = max(h.count(".") + 1 for _, h, _ in rules)
    lengths = sorted({len(p) for _, _, p in rules})
    distinct = rows.where(F.contains("url", F.lit("://"))).select("url").distinct()
    spread = distinct.withColumn("expression", F.explode(F.array_distinct(expressions(host_of(F.col("url")), path_of(F.col("url")), labels, lengths))))
    spread = spread.withColumn("full", F.sha2("expression", 256)).withColumn("short", F.substring("full", 1, PREFIX))
    order = F.struct(F.length("rule"), F.length("rule_host"), F.col("verdict"), F.col("rule"))
    best = save(spread.join(known, "short").where("full = digest").groupBy("url").agg(F.max(order).alias("best")), "rules")
    return judged.join(best, "url", "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
