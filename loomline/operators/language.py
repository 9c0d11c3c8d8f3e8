"""Language identification by character trigrams: a table of weights, learnt from texts of known language, that scores others."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.operators.rounds import stored

MAX_GRAMS, MAX_LANGUAGES, PIECE = 3_000, 500, 1 << 20


def trigrams(text: Column) -> Column:
    """All overlapping trigrams of a text's lower-cased words, blanks around each; other characters count as blanks."""
    return F.regexp_extract_all(plain(text), F.lit(r"(?s)(?=(.{3}))."), F.lit(1))


def plain(text: Column) -> Column:
    """A text's lower-cased words, one blank between and around them."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}]+", " ")), F.lit(" "))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _codes(grams: np.ndarray) -> np.ndarray:
    """Three code points as one number, of every place but the last two."""
    c = grams.astype(np.int64)
    return (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]


def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """lang, gram, n: grams of plain texts t by language, in pieces of about PIECE characters, so a batch may be of any length."""
    for batch in batches:
        for lang, texts in batch.groupby("lang")["t"]:
            for _, piece in texts.groupby(texts.str.len().cumsum() // PIECE):
                codes, n = np.unique(np.concatenate([_codes(_points(t)) for t in piece]), return_counts=True)
                points = np.stack([codes >> 42, (codes >> 21) & 0x1FFFFF, codes & 0x1FFFFF], axis=1).astype("<u4")
                yield pd.DataFrame({"lang": lang, "gram": points.view("<U3")[:, 0].astype(object), "n": n})


def learnt(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", grams: int = MAX_GRAMS) -> DataFrame:
    """gram, lang, weight: a naive Bayes model of the grams most common in docs.

    The grams of every text are counted where it is; the pieces' counts are summed. weight is the logarithm of the
    gram's smoothed share among the language's grams; every language has every gram of the model. Rows without a
    language take no part; more than MAX_LANGUAGES languages are an error.
    """
    texts = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), plain(F.col(text_col)).alias("t"))
    counts = stored(texts.mapInPandas(counted, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    kept = counts.groupBy("gram").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "gram").limit(grams).select("gram")
    languages = sorted(r[0] for r in counts.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    every = kept.withColumn("lang", F.explode(F.array(*[F.lit(x) for x in languages]).cast("array<string>")))
    own = every.join(counts, ["lang", "gram"], "left").withColumn("n", F.coalesce("n", F.lit(0)) + 0.5)
    share = F.col("n") / F.sum("n").over(Window.partitionBy("lang"))
    return stored(own.select("gram", "lang", F.log(share).alias("weight")))


def scored(grams: list[str], languages: list[str], weights: np.ndarray) -> Callable[[pd.Series], pd.Series]:
    """The language of each plain text by weights (grams x languages), texts as arrays of code points."""
    codes = np.array([_codes(_points(g))[0] for g in grams], dtype=np.int64)
    order = np.argsort(codes)
    codes, weights = codes[order], weights[order]

    def one(text: str) -> str | None:
        found = _codes(_points(text))
        at = np.searchsorted(codes, found)
        known = at[codes[np.minimum(at, len(codes) - 1)] == found]
        if not len(known):
            return None
        return languages[int(np.argmax(np.bincount(known, minlength=len(codes)) @ weights))]

    return lambda texts: texts.map(one).astype(object)


def identified(docs: DataFrame, model: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with language: the one of the greatest score, the first by name of equal ones; null without a known gram.

    The model has at most MAX_GRAMS rows a language, so it goes to every task as an array; rows and their texts stay
    where they are, and nothing is shuffled.
    """
    table = model.toPandas().pivot(index="gram", columns="lang", values="weight")
    if table.empty:
        return docs.select(id_col, text_col, F.lit(None).cast("string").alias("language"))
    one = scored(list(table.index), list(table.columns), table.to_numpy())

    @F.pandas_udf("string")
    def language(texts: pd.Series) -> pd.Series:
        return one(texts)

    return docs.select(id_col, text_col, language(plain(F.col(text_col))).alias("language"))
