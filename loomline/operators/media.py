"""Media posts and recognised text: kinds, best fragments, slices, links, blocks, repair of glued capitals."""

from __future__ import annotations

import functools
import itertools
import operator
import re
import textwrap
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loomline.functions import text as T
from loomline.operators.rounds import stored

# Words that glued capitals are cut into.
VOCABULARY = (
    "a", "an", "and", "are", "as", "at", "be", "been", "before", "between", "big", "by", "can", "case", "change",
    "changes", "company", "could", "daily", "data", "day", "did", "do", "does", "economic", "economy", "evolving",
    "first", "for", "from", "future", "has", "have", "history", "how", "if", "in", "into", "is", "it", "its", "make",
    "market", "may", "more", "never", "new", "next", "not", "now", "of", "on", "one", "only", "or", "our", "over",
    "post", "predicts", "read", "reel", "said", "says", "see", "shows", "something", "story", "swipe", "that", "the",
    "their", "this", "to", "today", "top", "up", "watch", "what", "when", "why", "will", "with", "world", "you", "your",
    "ai", "anthropic", "artificial", "automation", "business", "chatgpt", "claude", "crypto", "dario", "deepmind",
    "finance", "gdp", "google", "inflation", "intelligence", "llm", "meta", "microsoft", "model", "models", "openai",
    "rate", "rates", "recession", "stock", "stocks", "tech", "technology", "tesla", "trade", "trump", "video",
)
CARD_WIDTH = 34
# Scores of known words by length and of unknown letters, and the share of known letters asked for.
WORD_SCORE, LETTER_SCORE, KNOWN_SHARE = (lambda n: 8 + 2 * n - (2 if n <= 2 else 0)), -7, 0.78


def content_type(media_type: Column, product_type: Column) -> Column:
    return (
        F.when(media_type == 8, "carousel").when(product_type == "clips", "reel").when(media_type == 2, "video").when(media_type == 1, "image").otherwise("unknown")
    )


def fragment_score(children: Column, has_video: Column, has_image: Column) -> Column:
    """Which fragment of one code is best: a carousel by its children, then video, then image."""
    return F.when(children > 0, 3000 + children).when(has_video, 2000).when(has_image, 1000).otherwise(0)


def best_fragments(items: DataFrame, code: str, score: Column, order: str) -> DataFrame:
    """The best item of each code, the first of equal ones; items without a code go."""
    w = Window.partitionBy(code).orderBy(F.col("_s").desc(), F.col(order))
    return items.where(F.col(code).isNotNull()).withColumn("_s", score).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_s", "_n")


def first_and_last(rows: DataFrame, group: str, order: str, first: int, last: int) -> DataFrame:
    """The first and last rows of each group; all of a group that has no more than both."""
    w = Window.partitionBy(group)
    n, up = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy(order))
    marked = rows.withColumn("_n", n).withColumn("_up", up)
    return marked.where((F.col("_up") <= first) | (F.col("_up") > F.col("_n") - last)).drop("_n", "_up")


def shortcode(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"/(?:p|reel|tv)/([A-Za-z0-9_-]+)", 1), F.lit(""))


def catalogue_kind(url: Column) -> Column:
    """track, playlist or album: the first that a link names, in this order."""
    kinds = ("track", "playlist", "album")
    return F.coalesce(*[F.when(F.rlike(url, F.lit(k + "/[a-zA-Z0-9]+")), k) for k in kinds])


def urls_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"""https?://[^\s<>"']+"""), F.lit(0))


def ordinal_names(items: DataFrame, group: list[str], order: str, kind: Column) -> DataFrame:
    """items with name: video for a group's first video and video_2, video_3, ... after; photo_1, photo_2, ..."""
    w = Window.partitionBy(*group).orderBy(order)
    n = F.row_number().over(w)
    return items.withColumn("_n", n.cast("string")).withColumn("name", F.when(kind == "video", F.when(n == 1, "video").otherwise(F.concat(F.lit("video_"), "_n"))).otherwise(F.concat(kind, F.lit("_"), "_n"))).drop("_n")


def blocks_joined(texts: Column) -> Column:
    """Blocks in one text, a rule of 80 between them."""
    return F.array_join(texts, "\n" + "=" * 80 + "\n")


def blocks_split(text: Column) -> Column:
    parts = F.transform(F.split(text, "={80}"), lambda b: F.regexp_replace(b, r"(?U)^\s+|\s+$", ""))
    return F.filter(parts, lambda b: b != "")


def segmented(token: str, words: Iterable[str], lengths: list[int] | None = None) -> str:
    """Glued capitals as known words and runs of unknown letters, or the token itself if too little of it is known.

    The best cut of each prefix: known words score WORD_SCORE, letters between them LETTER_SCORE; of equal cuts the one
    whose last part begins first.
    """
    low, size = token.lower(), len(token)
    known_words = frozenset(words)
    lengths = lengths or sorted({len(w) for w in known_words})
    best: list[tuple[float, int, bool]] = [(0, 0, True)]  # of the prefix up to j: score, where its last part begins, known
    for j in range(1, size + 1):
        ends = [(j - n, WORD_SCORE(n), True) for n in lengths if n <= j and low[j - n : j] in known_words] + [(j - 1, LETTER_SCORE, False)]
        value, begin, known = max((best[i][0] + s, -i, known) for i, s, known in ends)
        best.append((value, -begin, known))
    parts, j = [], size
    while j:
        _, i, known = best[j]
        parts.append((known, token[i:j]))
        j = i
    parts.reverse()
    share = sum(len(t) for known, t in parts if known) / size
    if share < KNOWN_SHARE or len(parts) < 2 or best[size][0] <= 0:
        return token
    runs = itertools.groupby(enumerate(parts), key=lambda p: (p[1][0], p[0] if p[1][0] else -1))  # a known word is a run of its own
    return " ".join("".join(t for _, (_, t) in run) for _, run in runs)


CAPITALS = re.compile(r"\b[A-Z]{10,}\b")


@F.pandas_udf(StringType())
def capitals_cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Texts with runs of 10 or more capitals cut into known words where that is sure; a token is cut once a task."""
    words, lengths = frozenset(VOCABULARY), sorted({len(w) for w in VOCABULARY})
    cut = functools.lru_cache(1 << 17)(lambda token: segmented(token, words, lengths))
    for texts in batches:
        yield texts.map(lambda t: None if t is None else CAPITALS.sub(lambda m: cut(m[0]), t))


# a word that is wider than a card, or as many words as fit; for lines whose only white space is single blanks
CARD_LINE = re.compile(rf"([^ ]{{{CARD_WIDTH + 1},}}|.{{1,{CARD_WIDTH}}})(?: |\Z)", re.DOTALL)
UNEVEN = re.compile(r"  |[\t\x0b\x0c\r]")


def wrapped(line: str) -> list[str]:
    """A stripped line in lines of at most a card's width, as textwrap has them; longer words stay whole."""
    if len(line) <= CARD_WIDTH:
        return [line]
    if UNEVEN.search(line):
        return textwrap.wrap(line, CARD_WIDTH, break_long_words=False, break_on_hyphens=False)
    return CARD_LINE.findall(line)


@F.pandas_udf(StringType())
def card_wrapped(texts: pd.Series) -> pd.Series:
    """Lines wrapped at the width of a card."""

    def one(text):
        if text is None:
            return None
        lines = [p.strip() for p in text.split("\n")]
        return "\n".join(w for p in lines if p for w in wrapped(p)).strip()

    return texts.map(one)


def ocr_cleaned(rows: DataFrame, col: str, into: str) -> DataFrame:
    """rows with into: spacing, phrases, glued capitals, spacing, card layout, spacing. Python sees only texts with a
    run of ten capitals, or mostly upper-case ones; the others pass by. Spaced texts are spaced again only after wrapping:
    phrases and cuts add nothing but single blanks between letters."""
    text = T.phrases_repaired(T.spaced(F.coalesce(F.col(col), F.lit(""))))
    got = rows.withColumn(into, text)
    got = got.withColumn("_need", F.when(F.rlike(into, F.lit(r"\b[A-Z]{10,}\b")), F.col(into)))
    got = got.withColumn(into, F.coalesce(capitals_cut("_need"), F.col(into)))
    calls = F.regexp_replace(F.col(into), r"(?iU)\s+(SWIPE TO WATCH|WATCH NOW|READ MORE|LINK IN BIO)\b", "\n$1")
    got = got.withColumn("_need", F.when(T.mostly_upper(F.col(into)), calls))
    return got.withColumn(into, F.coalesce(T.spaced(card_wrapped("_need")), F.col(into))).drop("_need")


SHORTCODE = "^[A-Za-z0-9_-]{5,20}$"
EMPTY = ("", "null", "false", "0", "0.0", "-0.0", "[]", "{}")


def _at(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def _given(v: Column, path: str) -> Column:
    """Whether a JSON value is there and neither null, false, 0 nor empty."""
    return F.coalesce(~_at(v, path, "string").isin(*EMPTY), F.lit(False))


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit(kind)), F.lit(False))


def _text(v: Column, path: str) -> Column:
    return F.when(_given(v, path), _at(v, path, "string"))


def _code(v: Column) -> Column:
    """The node's code or else its shortcode, if it is a text."""
    own = F.when(_given(v, "code"), _at(v, "code")).otherwise(_at(v, "shortcode"))
    return F.when(_is(own, "STRING"), own.cast("string"))


def _children(v: Column) -> Column:
    """A carousel's children in either shape."""
    edges = _at(v, "edge_sidecar_to_children.edges", "array<variant>")
    nodes = F.filter(F.transform(F.filter(edges, lambda e: _given(e, "node")), lambda e: _at(e, "node")), lambda n: n.isNotNull())
    return F.coalesce(F.when(_given(v, "carousel_media"), _at(v, "carousel_media", "array<variant>")).otherwise(nodes), F.array().cast("array<variant>"))


def _image(v: Column) -> Column:
    sizes = F.transform(F.filter(_at(v, "display_resources", "array<variant>"), lambda r: _given(r, "src")), lambda r: _at(r, "src", "string"))
    return (
        F.when(_given(v, "image_versions2"), _at(v, "image_versions2.candidates[0].url", "string"))
        .when(_given(v, "display_resources"), F.get(sizes, F.lit(0)))
        .when(_given(v, "display_url"), _at(v, "display_url", "string"))
        .when(_given(v, "thumbnail_src"), _at(v, "thumbnail_src", "string"))
    )


def _video(v: Column) -> Column:
    return F.when(_given(v, "video_versions"), _at(v, "video_versions[0].url", "string")).when(_given(v, "video_url"), _at(v, "video_url", "string"))


def _shown(v: Column) -> Column:
    """Whether a node has an image, a video or children."""
    keys = ("image_versions2", "display_url", "thumbnail_src", "display_resources", "video_versions", "video_url")
    return functools.reduce(operator.or_, [_given(v, k) for k in keys]) | (F.size(_children(v)) > 0)


def _media_type(v: Column) -> Column:
    moving = _given(v, "is_video") | _given(v, "video_versions") | _given(v, "video_url")
    return F.coalesce(_at(v, "media_type", "int"), F.when(F.size(_children(v)) > 0, 8).when(moving, 2).otherwise(1))


def is_media(v: Column) -> Column:
    """Whether a JSON object is a media object: it has a code of 5 to 20 letters, and an image, a video or children."""
    return F.coalesce(_is(v, "OBJECT") & F.rlike(_code(v), F.lit(SHORTCODE)) & _shown(v), F.lit(False))


def _child(code: Column, v: Column, i: Column) -> Column:
    own = _given(v, "code") | _given(v, "shortcode")
    name = F.when(own, _code(v)).otherwise(F.concat(code, F.lit("_"), i.cast("string")))
    kind = content_type(_media_type(v), _at(v, "product_type", "string"))
    made = F.struct(name.alias("code"), kind.alias("kind"), _image(v).alias("image_url"), _video(v).alias("video_url"))
    return F.when(_is(v, "OBJECT") & F.rlike(name, F.lit(SHORTCODE)) & _shown(v), made)


def walked(documents: DataFrame, json_col: str, hit: Callable[[Column], Column], stop: bool) -> DataFrame:
    """documents with path (keys and places from the root) and node of every JSON value that hit tells, at any depth.

    A walk stops at a hit or goes on below it. Each level is one narrow step, and its values are stored, so the number
    of steps is the depth of the deepest document. Texts that are no JSON, and ones with a key twice, have no values.
    """
    others = [c for c in documents.columns if c != json_col]
    start = documents.select(*others, F.array().cast("array<string>").alias("path"), F.try_parse_json(json_col).alias("node")).where("node is not null")
    found, level = None, start
    while True:
        level = stored(level.withColumn("_hit", hit(F.col("node"))))
        here = level.where("_hit").drop("_hit")
        found = here if found is None else found.unionByName(here)
        rest = level.where(~F.col("_hit")) if stop else level
        rest = rest.where(_is(F.col("node"), "OBJECT") | _is(F.col("node"), "ARRAY"))
        if rest.isEmpty():
            return found
        each = rest.lateralJoin(documents.sparkSession.tvf.variant_explode(F.col("node").outer()))
        level = each.select(*others, F.concat("path", F.array(F.coalesce("key", F.col("pos").cast("string")))).alias("path"), F.col("value").alias("node"))


def shortcodes_in(documents: DataFrame, json_col: str) -> DataFrame:
    """documents with path and code of every object that has a code of 5 to 20 letters, those within others too."""
    got = walked(documents, json_col, lambda v: F.coalesce(_is(v, "OBJECT") & F.rlike(_code(v), F.lit(SHORTCODE)), F.lit(False)), stop=False)
    return got.withColumn("code", _code(F.col("node"))).drop("node")


def normalised(documents: DataFrame, json_col: str) -> DataFrame:
    """code, kind, caption, username, image_url, video_url, children of every media object in documents.

    Both API shapes are read. A walk does not go on below a media object; a carousel's children are in it. A child
    without a code has its parent's and its place, from 0; one that is no media object is left out.
    """
    m, edge = F.col("node"), "edge_media_to_caption.edges[0].node.text"
    found = walked(documents, json_col, is_media, stop=True).withColumn("code", _code(m)).withColumn("type", _media_type(m))
    said = F.when(_is(_at(m, "caption"), "OBJECT"), _text(m, "caption.text")).when(_given(m, "caption"), _at(m, "caption", "string")).otherwise(_text(m, edge))
    user = F.when(_given(m, "user"), _at(m, "user")).otherwise(_at(m, "owner"))
    below = F.filter(F.transform(_children(m), lambda v, i: _child(F.col("code"), v, i)), lambda c: c.isNotNull())
    children = F.when(F.col("type") == 8, below).otherwise(F.array().cast("array<struct<code:string,kind:string,image_url:string,video_url:string>>"))
    return found.select(
        *[c for c in documents.columns if c != json_col],
        "code",
        content_type(F.col("type"), _at(m, "product_type", "string")).alias("kind"),
        F.coalesce(said, F.lit("")).alias("caption"),
        F.coalesce(_text(user, "username"), F.lit("unknown")).alias("username"),
        _image(m).alias("image_url"),
        _video(m).alias("video_url"),
        children.alias("children"),
    )
