"""Tracks and candidates: sanitising, tokens, scores, ranking, review, caches and histories."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from loomline.functions.text import evaluated_once, replaced
from loomline.operators.rounds import stored

# Fixed values of the scoring rules.
IGNORED = ("a", "an", "and", "audio", "feat", "featuring", "from", "ft", "official", "original", "song", "the", "video", "with")
ALTERNATES = (
    "acoustic", "bootleg", "cover", "dance", "demo", "instrumental", "karaoke", "live", "making of", "making video",
    "mashup", "orchestra", "orchestral", "parody", "podcast", "reaction", "rehearsal", "remake", "remix", "reverb",
    "review", "rework", "slowed", "sped up", "symphony", "tribute", "tutorial", "unboxing",
)
PREFERRED = (("official audio", 12), ("official video", 8), ("provided to youtube by", 12))


def sanitized_title(title: Column) -> Column:
    return F.trim(
        replaced(
            title,
            (r"""(?iU)\s*\(From\s+["'].+?["']\)""", ""),
            (r"(?iU)\s*\(feat\..+?\)", ""),
            (r"(?iU)\s*[\[\(]Remastered[\]\)]", ""),
            (r"(?iU)\s-\sFrom\s.*", ""),
        )
    )


def sanitized_album(album: Column) -> Column:
    cut = replaced(
        album,
        (r"(?iU)\s*[\[\(]?Original Motion Picture Soundtrack[\]\)]?\s*", ""),
        (r"(?iU)\s*[\[\(]?(?:Motion Picture|Original) Soundtrack[\]\)]?\s*", ""),
    )
    return F.regexp_replace(cut, r"^[ \-()\[\]]+|[ \-()\[\]]+$", "")


def needs_album(title: Column, album: Column) -> Column:
    return F.rlike(title, F.lit(r"(?iU)\bfrom\b")) | F.rlike(album, F.lit(r"(?iU)\bsoundtrack\b"))


def acronym(album: Column) -> Column:
    """Initials of a name of 10 characters and two plain words or more, else empty."""
    ws = F.filter(F.split(F.trim(album), r"(?U)\s+"), lambda w: F.rlike(w, F.lit(r"^[\p{L}\p{N}]+$")))
    short = F.upper(F.array_join(F.transform(ws, lambda w: F.substring(w, 1, 1)), ""))
    return F.when((F.length(album) >= 10) & (F.size(ws) >= 2), short).otherwise("")


def search_query(title: Column, artist: Column, album: Column, free_form: Column) -> Column:
    t, kept = sanitized_title(title), sanitized_album(album)
    first = F.trim(F.get(F.split(artist, r"feat\."), F.lit(0)))
    quoted = F.concat(F.lit('"'), t, F.lit('"'))
    n = F.size(F.filter(F.split(t, r"(?U)\s+"), lambda w: w != ""))
    full = F.array_join(F.filter(F.array(quoted, first, kept, F.lit("official audio")), lambda p: p != ""), " ")
    return (
        F.when(free_form, F.concat(t, F.lit(" official audio")))
        .when((n <= 1) | (F.length(t) < 4), F.concat_ws(" ", quoted, first, F.lit("official audio")))
        .otherwise(full)
    )


@F.pandas_udf(StringType())
def folded(values: pd.Series) -> pd.Series:
    """Decomposed, without combining marks, case-folded: the one step that has no built-in function."""
    import unicodedata

    return values.fillna("").map(lambda v: "".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c)).casefold())


def normalized(value: Column, ascii_only: bool = False) -> Column:
    """a-z and 0-9 with single blanks between; ascii_only skips the Unicode folding (and the Python stage)."""
    base = F.lower(F.coalesce(value, F.lit(""))) if ascii_only else folded(value)
    return F.trim(F.regexp_replace(base, "[^a-z0-9]+", " "))


def meaningful(norm: Column) -> Column:
    """Words of normalized text that are longer than a letter and not ignored."""
    return F.filter(F.split(norm, " "), lambda w: (F.length(w) > 1) & ~w.isin(*IGNORED))


def exact_coverage(expected: Column, actual: Column) -> Column:
    """Share of the distinct expected words among the actual ones; 0 without expected words."""
    e = F.array_distinct(expected)
    return F.when(F.size(e) > 0, F.size(F.array_intersect(e, actual)).cast("double") / F.size(e)).otherwise(0.0)


@F.pandas_udf(DoubleType())
def fuzzy_coverage(expected: pd.Series, actual: pd.Series) -> pd.Series:
    """Share of the distinct expected words that equal, or are 0.82 alike to, an actual one."""
    from difflib import SequenceMatcher
    from functools import lru_cache

    @lru_cache(1 << 16)
    def alike(e: str, a: str) -> bool:
        bound = 2 * min(len(e), len(a)) / (len(e) + len(a))  # the ratio cannot exceed it
        return bound >= 0.82 and SequenceMatcher(None, e, a).ratio() >= 0.82

    def one(e, a) -> float:
        if e is None or not len(e):
            return 0.0
        want, have = set(e), set(() if a is None else a)
        return sum(w in have or any(alike(w, x) for x in have) for w in want) / len(want)

    return pd.Series([one(e, a) for e, a in zip(expected, actual)])


def longest_ordered(expected: Column, actual: Column) -> Column:
    """Most consecutive expected words found in order among the actual ones, from any start."""

    def from_start(s: Column) -> Column:
        rest = F.slice(expected, s, F.size(expected))
        return F.aggregate(actual, F.lit(0), lambda m, w: F.when(F.get(rest, m) == w, m + 1).otherwise(m))

    starts = F.when(F.size(expected) > 0, F.sequence(F.lit(1), F.size(expected))).otherwise(F.array().cast("array<int>"))
    return F.coalesce(F.array_max(F.transform(starts, from_start)), F.lit(0))


def alternate(norm_title: Column) -> Column:
    """Whether an alternate-version word occurs as whole words."""
    return F.rlike(norm_title, F.lit(r"(?:^| )(?:" + "|".join(ALTERNATES) + r")(?: |$)"))


def score(free_form: Column, seconds: Column, rank: Column, title: Column, channel: Column, description: Column, coverage: dict[str, Column], sizes: dict[str, Column], ordered: Column, duration_ms: Column) -> Column:
    """A candidate's score, 0 at least. title, channel, description are normalized; coverage and sizes (word counts of
    the track's side) are by title, artist, album and query."""
    off = F.abs(seconds - duration_ms / 1000)
    timed = (F.coalesce(duration_ms, F.lit(0)) > 0) & (F.coalesce(seconds, F.lit(0)) > 0)
    by_time = F.when(~timed, 0).when(off <= 3, 18).when(off <= 8, 12).when(off <= 15, 5).when(off > 30, -20).otherwise(0)
    topic = F.rlike(channel, F.lit(r"(?:^| )topic(?: |$)"))
    official = (coverage["artist"] >= 0.8) & (F.contains(channel, F.lit("official")) | F.contains(channel, F.lit("vevo")))
    phrase = F.lit(0)
    for text, bonus in reversed(PREFERRED):
        phrase = F.when(F.contains(title, F.lit(text)) | F.contains(description, F.lit(text)), bonus).otherwise(phrase)
    part = lambda k, weight: F.when(sizes[k] > 0, F.bround(coverage[k] * weight)).otherwise(0)
    known = F.bround(coverage["title"] * 45) + part("artist", 25) + part("album", 10) + F.when(topic, 12).when(official, 10).otherwise(0) + phrase + by_time
    near = F.when(F.coalesce(rank, F.lit(0)) > 0, F.greatest(12 - (rank - 1) * 3, F.lit(0))).otherwise(0)
    free = F.bround(coverage["query"] * 60) + F.least(ordered * 8, F.lit(24)) + near
    implausible = (F.coalesce(seconds, F.lit(0)) > 0) & ((seconds < 45) | (seconds > 600))
    value = F.when(implausible | alternate(title), 0).when(free_form, free).when(coverage["title"] < 0.8, 0).otherwise(F.greatest(known, F.lit(0)))
    return value.cast("int")


def ranked(candidates: DataFrame, key: str, score_col: str = "score", rank_col: str = "rank", tie: str = "seq") -> DataFrame:
    """candidates with place: by score downward, then rank (0, unknown, first), then tie."""
    order = Window.partitionBy(key).orderBy(F.col(score_col).desc(), F.col(rank_col), F.col(tie))
    return candidates.withColumn("place", F.row_number().over(order))


def resolved(candidates: DataFrame, key: str, url: str, free_form: Column, most: int = 5, score_col: str = "score") -> DataFrame:
    """key, url of the best candidate if it reaches 80 (60 free-form), else the candidates to review, best first."""
    top = ranked(candidates, key, score_col).where(F.col("place") <= most)
    first = F.col("place") == 1
    got = top.groupBy(key).agg(
        F.max(F.when(first, F.col(score_col))).alias("best"),
        F.max(F.when(first & (F.col(score_col) >= F.when(free_form, 60).otherwise(80)), F.col(url))).alias("url"),
        F.array_sort(F.collect_list(F.struct("place", F.col(url).alias("candidate"), F.col(score_col).alias("score")))).alias("candidates"),
    )
    return got.withColumn("candidates", F.when(F.col("url").isNull(), F.col("candidates")))


def ranked_list(found: Column, most: int) -> Column:
    """The best of an array of candidate, score and rank, in the order of ranked() with the candidate as tie."""
    ordered = F.array_sort(F.transform(found, lambda f: F.struct(-f["score"], f["rank"], f["candidate"].alias("candidate"), f["score"].alias("score"))))
    return F.slice(ordered, 1, most)


def resolved_list(found: Column, free_form: Column, most: int = 5) -> Column:
    """best, url and candidates as resolved() has them, of one row's array of candidate, score and rank."""

    def of(top: Column) -> Column:
        first = F.get(top, F.lit(0))
        url = F.when(first["score"] >= F.when(free_form, 60).otherwise(80), first["candidate"])
        listed = F.transform(top, lambda f, i: F.struct((i + 1).alias("place"), f["candidate"].alias("candidate"), f["score"].alias("score")))
        return F.struct(first["score"].alias("best"), url.alias("url"), F.when(url.isNull(), listed).alias("candidates"))

    return evaluated_once(ranked_list(found, most), of)


def cache_key(title: Column, artist: Column, album: Column, duration_ms: Column) -> Column:
    return F.concat_ws("|", F.lit("v5"), *[F.coalesce(c.cast("string"), F.lit("")) for c in (title, artist, album, duration_ms)])


def first_per_track(tracks: DataFrame) -> DataFrame:
    """tracks (playlist_pos, track_pos, title, artist, album, ...): the first of equal trimmed, lower-cased names."""
    same = [F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in ("title", "artist", "album")]
    order = Window.partitionBy(*same).orderBy("playlist_pos", "track_pos")
    return tracks.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def not_in(rows: DataFrame, history: DataFrame, keys: list[str]) -> DataFrame:
    """rows without those whose keys history has; rows with a null key go too."""
    known = rows.where(" and ".join(f"{k} is not null" for k in keys))
    return known.join(history.select(*keys).distinct(), keys, "left_anti")


def first_by(rows: DataFrame, keys: list[str], order: list, last: bool = False) -> DataFrame:
    """The first (or last) row of each key by order, a total one."""
    cols = [(F.col(o) if isinstance(o, str) else o) for o in order]
    w = Window.partitionBy(*keys).orderBy(*[c.desc() if last else c.asc() for c in cols])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


SUFFIXED = r"(?s)^(.*) \(([2-9]|[1-9][0-9]{1,17})\)$"


def suffixed(rows: DataFrame, name: str, order: str) -> DataFrame:
    """rows with name made unique: in order (unique), a name that is taken becomes "name (2)", "name (3)", ... with the
    first number that is free. Null names stay.

    A number is taken before its turn only by a row that itself is named so. Which of these come first is settled from
    the smallest number on, by ranking the repeats of each name over the numbers left, until nothing changes; names with
    more suffixes follow those with fewer, as a name may itself be taken when it first comes.
    """
    base = rows.select(F.col(order).alias("at"), F.col(name).alias("name")).where("name is not null")
    first = stored(base.groupBy("name").agg(F.min("at").alias("at")))
    literal = first.select(F.regexp_extract("name", SUFFIXED, 1).alias("of"), F.regexp_extract("name", SUFFIXED, 2).try_cast("long").alias("j"), "at", F.col("name").alias("full")).where("j is not null")
    literal = stored(literal.join(first.select(F.col("name").alias("of")), "of", "left_semi").withColumn("depth", F.length(F.regexp_extract("of", r"((?: \([1-9][0-9]*\))*)$", 1))))
    taken = stored(literal.select(F.col("full").alias("name"), "at").limit(0))  # names given to others before their first row
    blocks = stored(literal.select("of", "j").limit(0))
    for level in [r[0] for r in literal.select("depth").distinct().orderBy("depth").collect()]:
        mine = literal.where(F.col("depth") == level)
        repeats = stored(_repeats(base.join(mine.select(F.col("of").alias("name")).distinct(), "name", "left_semi"), taken))
        state = stored(mine.withColumn("blocks", F.lit(True)))
        while True:
            smaller = Window.partitionBy("of").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
            turn = F.col("j") - 1 - F.coalesce(F.sum(F.col("blocks").cast("long")).over(smaller), F.lit(0))
            timed = state.withColumn("r", turn).join(repeats.select(F.col("name").alias("of"), "r", F.col("at").alias("turn")), ["of", "r"], "left")
            now = stored(timed.select("of", "j", "at", "full", "depth", F.coalesce(F.col("at") < F.col("turn"), F.lit(True)).alias("blocks"), F.col("blocks").alias("before")))
            changed = not now.where("blocks <> before").isEmpty()
            state = now.drop("before")
            if not changed:
                break
        blocks = stored(blocks.unionByName(state.where("blocks").select("of", "j")))
        taken = stored(taken.unionByName(state.where("not blocks").select(F.col("full").alias("name"), "at")))
    order_of = Window.partitionBy("of").orderBy("j")
    shifts = blocks.select(F.col("of").alias("name"), (F.col("j") - F.row_number().over(order_of)).cast("long").alias("r"), F.lit(None).cast(base.schema["at"].dataType).alias("at"), F.lit(1).alias("shift"))
    ranked = _repeats(base, taken).withColumn("shift", F.lit(0)).unionByName(shifts)
    upto = Window.partitionBy("name").orderBy("r", F.col("shift").desc()).rowsBetween(Window.unboundedPreceding, 0)
    n, own = (k + "_" * (1 + max(map(len, rows.columns))) for k in "na")  # names that rows cannot have
    given = ranked.withColumn(n, F.col("r") + 1 + F.sum("shift").over(upto)).where("shift = 0").select(F.col("at").alias(own), n)
    made = F.when(F.col(n) > 1, F.concat(F.col(name), F.lit(" ("), F.col(n).cast("string"), F.lit(")"))).otherwise(F.col(name))
    return rows.join(given, rows[order] == F.col(own), "left").withColumn(name, made).select(*rows.columns)


def _repeats(named: DataFrame, taken: DataFrame) -> DataFrame:
    """name, at, r of named (name, at): 0 for the row that has the name as it is, 1, 2, ... for those that need a number."""
    counted = named.withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy("at")).cast("long"))
    late = taken.select("name", F.lit(1).alias("late"))
    return counted.join(late, "name", "left").select("name", "at", (F.col("r") - 1 + F.coalesce("late", F.lit(0))).alias("r"))


def similar(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio of two texts."""

    @F.pandas_udf(DoubleType())
    def ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        from difflib import SequenceMatcher

        for x, y in batches:
            yield pd.Series([None if p is None or q is None else SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y)])

    return ratio(a, b)


def spelled(value: Column) -> Column:
    """normalized() in one lambda, for use inside larger expressions."""
    return evaluated_once(value, lambda v: normalized(v, ascii_only=True))
