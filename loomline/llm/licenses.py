"""Licence scan: a trained paragraph classifier, confirmed by template comparison. DataFrame functions only.

Lines with a licence word are candidates, each with its paragraph: all lines next to it up to a blank one, as a notice
is wrapped, at any width and length. A line names families itself or else its paragraph does; where that names none, as
notices of many families may outweigh each other, the lines right around it are looked at alone. Their word n-grams meet a table of weights, learnt by a lasso
logistic regression with one score for each licence family; a probability below the calibrated threshold is the
unknown class, and a family stands only if enough of one of its templates' n-grams occur. Every family that stands is
named, so a choice of two licences names both. Different lines and paragraphs are scored once, paragraphs only where
a line of theirs names none, so a notice that a third of the documents carry costs one paragraph; the joins back are between stored
tables, so that adaptive execution can split such a paragraph's rows. The model is fitted on TRAIN
examples that the module writes itself from the templates, from a fixed seed; the weight table is bounded by MAX_GRAMS.
"""

from __future__ import annotations

import random
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.llm.store import save

TRIGGER = r"(?i)licen[sc]e|licencia|licenz|lizenz|copyright|copyleft|spdx|warrant|redistribut|public domain|creative commons|permission (?:is|to)|without fee|gnu |mozilla|cc[ -]by|cc0|eupl|wtfpl|mpl |in no event"
WORD = r"[\p{L}\p{N}]+(?:[.+-][\p{L}\p{N}]+)*+"
GRAMS = 3
AROUND = REACH = (1 << 31) - 1  # lines and characters of a paragraph on either side of a line: all of it
NEAR_LINES, NEAR = 8, 480  # those looked at once more where the whole paragraph names no family
TRAIN, SEED, MAX_GRAMS, LASSO, PRECISION, COVER = 3000, 1, 6000, 2e-4, 0.99, 0.6

# Sentences by which licence families are known.
TEMPLATES = {
    "mit": (
        "released under the mit license",
        "licensed under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "the software is provided as is without warranty of any kind express or implied",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability",
        "spdx-license-identifier mit",
    ),
    "apache-2.0": (
        "licensed under the apache license version 2.0",
        "you may not use this file except in compliance with the license",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions",
        "spdx-license-identifier apache-2.0",
    ),
    "gpl": (
        "licensed under the gnu general public license version 3",
        "licensed under the gnu general public license version 2",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "spdx-license-identifier gpl-3.0-or-later",
        "spdx-license-identifier gpl-2.0-only",
    ),
    "lgpl": ("licensed under the gnu lesser general public license", "under the terms of the gnu lesser general public license", "spdx-license-identifier lgpl-2.1-or-later"),
    "agpl": ("licensed under the gnu affero general public license version 3", "under the terms of the gnu affero general public license", "spdx-license-identifier agpl-3.0-only"),
    "bsd": (
        "released under the bsd license",
        "redistribution and use in source and binary forms with or without modification are permitted",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties are disclaimed",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products",
        "spdx-license-identifier bsd-3-clause",
    ),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2.0", "licensed under the mozilla public license version 2.0", "if a copy of the mpl was not distributed with this file you can obtain one at", "spdx-license-identifier mpl-2.0"),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "released under the isc license", "the software is provided as is and the author disclaims all warranties with regard to this software", "spdx-license-identifier isc"),
    "unlicense": ("this is free and unencumbered software released into the public domain", "spdx-license-identifier unlicense"),
    "eupl": ("licensed under the european union public licence", "licensed under the eupl version 1.2", "under the terms of the eupl", "spdx-license-identifier eupl-1.2"),
    "epl-2.0": ("made available under the terms of the eclipse public license 2.0", "licensed under the eclipse public license version 2.0", "spdx-license-identifier epl-2.0"),
    "boost": ("distributed under the boost software license version 1.0", "licensed under the boost software license", "spdx-license-identifier bsl-1.0"),
    "zlib": ("this software is provided as is without any express or implied warranty", "altered source versions must be plainly marked as such", "released under the zlib license", "spdx-license-identifier zlib"),
    "wtfpl": ("do what the fuck you want to public license", "licensed under the wtfpl", "spdx-license-identifier wtfpl"),
    "cc0": ("dedicated to the public domain under cc0 1.0", "to the extent possible under law the author has waived all copyright and related rights", "licensed under cc0 1.0 universal"),
    "cc-by": ("licensed under cc by 4.0", "licensed under a creative commons attribution 4.0 international license"),
    "cc-by-sa": ("licensed under cc by-sa 4.0", "licensed under a creative commons attribution-sharealike 4.0 international license"),
    "cc-by-nc": ("licensed under cc by-nc 4.0", "licensed under a creative commons attribution-noncommercial 4.0 international license"),
    "cc-by-nd": ("licensed under cc by-nd 4.0", "licensed under a creative commons attribution-noderivatives 4.0 international license"),
}
# Sentences with licence words that name no family.
OTHERS = (
    "a driving license is required for this job", "the license fee is due in march", "all rights reserved", "copyright notice", "copyright 2019 by the author",
    "see the license file for details", "this product comes with a two year warranty", "the bar lost its licence to sell wine", "permission is required to enter the building",
    "please do not redistribute this memo", "the licence expired last year", "read the license agreement before you install", "he was granted permission to leave",
    "the hunting license costs ten dollars", "the institute of technology opened a new library", "the general public may enter the museum", "version 2.0 of the report is out",
    "the foundation published its terms", "licensed under the terms of the agreement", "this work is licensed", "the apache helicopter", "attribution is appreciated", "free of charge",
)
Model = tuple[dict[str, float], list[tuple[str, str, float]], float]


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+(?:[.+-][^\W_]+)*", text.lower())


def grams_of(words: list[str], most: int = GRAMS) -> list[str]:
    return list(dict.fromkeys(" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)))


def grams(text: Column, most: int = GRAMS) -> Column:
    """Distinct word n-grams of up to most words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))

    def of(ws: Column) -> Column:
        def wide(n: int) -> Column:
            places = F.when(F.size(ws) >= n, F.sequence(F.lit(1), F.size(ws) - n + 1)).otherwise(F.array().cast("array<int>"))
            return F.transform(places, lambda i: F.array_join(F.slice(ws, i, F.lit(n)), " "))

        return F.array_distinct(F.concat(*[wide(n) for n in range(1, most + 1)]))

    return F.get(F.transform(F.array(words), of), F.lit(0))


def examples(number: int = TRAIN, seed: int = SEED) -> list[tuple[str, set[str]]]:
    """Paragraphs and their families (none, one or two)."""
    r = random.Random(seed)
    filler = "the and of to in that was for with on by from this it as are were has an our their data house river code note time long small".split()
    some = lambda a, b: [r.choice(filler) for _ in range(r.randint(a, b))]
    families = list(TEMPLATES)
    out = []
    for n in range(number):
        family = families[n // 2 % len(families)] if n % 2 else ""
        text = r.choice(TEMPLATES[family] if family else OTHERS).split()
        told = {family} - {""}
        if family and r.random() < 0.3:  # two licences, of which the second may leave out the words before its name
            other = r.choice(families)
            told.add(other)
            second = r.choice([t for t in TEMPLATES[other] if t.startswith(text[0])] or TEMPLATES[other]).split()
            text = text + [r.choice(["or", "and", "either"])] + second[{"licensed": 2, "spdx-license-identifier": 1}.get(second[0], 0) if second[0] == text[0] else 0 :]
        if r.random() < 0.3:
            text = [w for w in text if r.random() > 0.06] or text
        if r.random() < 0.5:
            text = r.choice([["this", "work", "is"], ["this", "project", "is"], ["copyright", str(r.randint(1990, 2025))], some(1, 6)]) + text
        if r.random() < 0.4:
            text = text + some(1, 10)
        if not family and r.random() < 0.3:
            text = some(3, 20) + text
        out.append((" ".join(text), told))
    return out


def fit(number: int = TRAIN, seed: int = SEED, most: int = MAX_GRAMS) -> Model:
    """Intercepts by family, weights (n-gram, family, weight) and the margin that gives PRECISION on held-out examples."""
    import numpy as np

    texts = examples(number, seed)
    each = [grams_of(words_of(t)) for t, _ in texts]
    seen: dict[str, int] = {}
    for g in each:
        for x in g:
            seen[x] = seen.get(x, 0) + 1
    kept = sorted((x for x, n in seen.items() if n >= 4), key=lambda x: (-seen[x], x))[:most]
    place, families = {x: i for i, x in enumerate(kept)}, list(TEMPLATES)
    x = np.zeros((len(texts), len(kept)), np.float32)
    for i, g in enumerate(each):
        x[i, [place[k] for k in g if k in place]] = 1
    y = np.array([[float(k in told) for k in families] for _, told in texts], np.float32)
    held = np.arange(len(texts)) % 5 == 4
    a, target = x[~held], y[~held]
    rate = 4.0 / (np.linalg.norm(a @ a.T, 2) / len(a) + 1.0)
    w = np.zeros((len(kept), len(families)), np.float32)
    b, at, t = np.full(len(families), -2.5, np.float32), w, 1.0
    for _ in range(120):  # accelerated proximal gradient, all families at once
        miss = 1 / (1 + np.exp(-np.clip(a @ at + b, -30, 30))) - target
        b = b - rate * miss.mean(0)
        new = at - rate * (a.T @ miss) / len(a)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * LASSO, 0)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        at, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    margin = (x[held] @ w + b).ravel()
    order = np.argsort(-margin, kind="stable")
    precision = np.cumsum(y[held].ravel()[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(precision >= PRECISION)
    cut = float(margin[order][good[-1]]) if len(good) else float("inf")
    weights = [(kept[i], families[k], float(w[i, k])) for i, k in zip(*np.nonzero(w))]
    return {f: float(v) for f, v in zip(families, b)}, weights, max(cut, 0.0)


def paragraph_families(paragraphs: DataFrame, model: Model) -> DataFrame:
    """paragraph, families (sorted, not empty) of each different paragraph that names any."""
    spark: SparkSession = paragraphs.sparkSession
    starts, weights, cut = model
    shares = [(g, f, f"{f}/{n}", 1 / len(gs)) for f, ts in TEMPLATES.items() for n, t in enumerate(ts) for gs in [grams_of(words_of(t))] for g in gs]
    # one table for both: template is null for the classifier's weights; its size is bounded by MAX_GRAMS and TEMPLATES
    table = spark.createDataFrame([(g, f, None, w) for g, f, w in weights] + shares, "gram string, family string, template string, value double")
    one = paragraphs.select("paragraph").distinct().withColumn("gram", F.explode(grams(F.col("paragraph"))))
    hits = one.join(F.broadcast(table), "gram").groupBy("paragraph", "family", "template").agg(F.sum("value").alias("value"))
    by_family = hits.groupBy("paragraph", "family").agg(
        F.sum(F.when(F.col("template").isNull(), F.col("value"))).alias("margin"), F.max(F.when(F.col("template").isNotNull(), F.col("value"))).alias("cover")
    )
    start = F.coalesce(*[F.when(F.col("family") == f, v) for f, v in starts.items()])
    scored = by_family.withColumn("margin", F.coalesce("margin", F.lit(0.0)) + start)
    stands = scored.where((F.col("margin") >= cut) & (F.col("cover") >= COVER))
    return stands.groupBy("paragraph").agg(F.array_sort(F.collect_set("family")).alias("families"))


def _paragraphs(text: Column) -> Column:
    """size (lines) and paragraph of each piece of a text that has a licence word; paragraph: null for a piece without one.

    A text is cut at the line end before each blank line, which goes with it; so a piece's first line may be the empty
    end of a blank one.
    """
    has = lambda x: F.rlike(x, F.lit(TRIGGER))
    piece = lambda p: F.struct(F.size(F.split(p, "\n", -1)).alias("size"), F.when(has(p), p).alias("paragraph"))
    cut = F.transform(F.split(text, r"\n *+(?=\n)", -1), piece)
    return F.when(has(text), cut).otherwise(F.array().cast("array<struct<size:int,paragraph:string>>"))


def _near(lines: Column, n: Column) -> Column:
    """Line n (from 0) of a paragraph with the lines right around it."""
    above = F.array_join(F.slice(lines, F.greatest(n - NEAR_LINES, F.lit(0)) + 1, F.least(n, F.lit(NEAR_LINES))), "\n")
    below = F.array_join(F.slice(lines, n + 2, F.lit(NEAR_LINES)), "\n")
    return F.concat_ws("\n", F.right(above, F.lit(NEAR)), F.get(lines, n), F.left(below, F.lit(NEAR)))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """doc_id, n_paragraphs (lines), n_candidates, n_confirmed, families, found for every row.

    families: the confirmed ones, sorted and comma-joined (empty: none); found: line number (from 0) and families or
    unknown of each candidate, as n:family+family, in order, comma-joined. Null and empty texts have no lines. Rows that
    repeat an id are scanned one by one. Other columns are ignored; an empty table gives an empty result.
    """
    model = model or fit()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = F.when(F.length(text) > 0, F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).otherwise(0)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), size.alias("n_paragraphs"), _paragraphs(text).alias("each"))
    rows = save(rows, "licence-lines")  # the one scan of the texts; row holds from here on
    before = Window.partitionBy("row").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    pieces = rows.select("row", F.posexplode("each").alias("p", "e")).select("row", "p", "e.*")
    pieces = pieces.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("int")).drop("size")
    pieces = save(pieces.where("paragraph is not null"), "paragraphs")
    listed = pieces.withColumn("all", F.split("paragraph", "\n", -1)).select("row", "p", "start", "all", F.posexplode("all").alias("i", "line"))
    listed = listed.where(F.rlike("line", F.lit(TRIGGER))).select("row", "p", (F.col("start") + F.col("i")).alias("n"), "line", _near(F.col("all"), F.col("i")).alias("near"))
    own = save(paragraph_families(listed.select(F.col("line").alias("paragraph")), model), "families").withColumnsRenamed({"paragraph": "line", "families": "own"})
    by_line = save(listed.join(own, "line", "left").drop("line"), "lines")
    asked = save(pieces.join(by_line.where("own is null").select("row", "p").distinct(), ["row", "p"]).select("row", "p", "paragraph"), "asked")
    whole = save(paragraph_families(asked.select("paragraph"), model), "families").withColumnsRenamed({"families": "whole"})
    by_line = save(by_line.join(asked.join(whole, "paragraph").select("row", "p", "whole"), ["row", "p"], "left").select("row", "n", F.coalesce("own", "whole").alias("named"), "near"), "lines")
    near = save(paragraph_families(by_line.where("named is null").select(F.col("near").alias("paragraph")), model), "families").withColumnsRenamed({"paragraph": "near"})
    told = by_line.join(near, "near", "left").select("row", "n", F.coalesce("named", "families", F.array(F.lit("unknown"))).alias("told"))
    by_row = told.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("n", "told"))).alias("found"))
    none = F.array().cast("array<struct<n:int,told:array<string>>>")
    joined = rows.drop("each").join(by_row, "row", "left").withColumn("each", F.coalesce("found", none))
    known = F.filter("each", lambda e: F.get(e["told"], F.lit(0)) != "unknown")
    return joined.select(
        "doc_id",
        F.col("n_paragraphs").cast("long").alias("n_paragraphs"),
        F.size("each").cast("long").alias("n_candidates"),
        F.size(known).cast("long").alias("n_confirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform(known, lambda e: e["told"])))), ",").alias("families"),
        F.array_join(F.transform("each", lambda e: F.concat_ws(":", e["n"].cast("string"), F.array_join(e["told"], "+"))), ",").alias("found"),
    )
