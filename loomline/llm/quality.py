"""Quality classifier: a sparse rule ensemble compiled to Spark columns.

Boosted shallow trees over text statistics give paths, each path is a conjunctive rule, a lasso logistic regression
weighs the rules, and those with a weight become one sum of CASE expressions. Statistics are built-in functions over
whole texts, for training and scoring alike. Only MAX_TRAIN labelled rows (by hash of their id) reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.trees import Path, boost, condition, holds

MAX_TRAIN = 20_000
TREES, DEPTH, CUTS, SEED = 24, 3, 32, 6

def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text by name; all are finite, and zero or one for an empty text."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    n = F.greatest(F.length(t), F.lit(1)).cast("double")

    def share(mark: str) -> Column:
        return (F.length(t) - F.length(F.replace(t, F.lit(mark), F.lit("")))) / n

    def distinct(mark: str) -> Column:
        return F.get(F.transform(F.array(F.split(t, mark)), lambda p: F.size(F.array_distinct(p)) / F.size(p)), F.lit(0))

    return {
        "log_chars": F.log1p(F.length(t).cast("double")),
        "spaces": share(" "),
        "breaks": share("\n"),
        "distinct_words": distinct(" "),
        "distinct_lines": distinct("\n"),
        "upper": F.regexp_count(t, F.lit("\\p{Lu}")) / n,
        "symbols": F.regexp_count(t, F.lit("[#$%&*@~^<>{}=_\\\\/+!|]")) / n,
        "digits": F.regexp_count(t, F.lit("[0-9]")) / n,
        "periods": share("."),
        "commas": share(","),
        "bars": share("|"),
    }


def fit_rules(x, y, names: list[str], lasso: float = 1e-3) -> tuple[float, list[tuple[float, Path]]]:
    """Intercept and weighted rules of the classifier for rows x (statistics by names) with labels y (0 or 1)."""
    import numpy as np

    prior = (y.sum() + 1.0) / (len(y) + 2.0)
    bias = float(np.log(prior / (1 - prior)))
    if len(y) < 40 or y.min() == y.max():
        return (bias if len(y) else 0.0), []
    _, grown = boost(x, y, names, TREES, DEPTH, 0.3, CUTS, SEED)
    rules = list(dict.fromkeys(path[:n] for leaves in grown for path, _ in leaves for n in range(1, len(path) + 1)))
    if not rules:
        return bias, []
    z = np.array([holds(x, names, r) for r in rules], np.float64).T
    _, first = np.unique(z, axis=1, return_index=True)
    rules, z = [rules[i] for i in sorted(first)], z[:, sorted(first)]
    mean = z.mean(0)
    z = z - mean
    rate = 4.0 / (np.linalg.norm(z, 2) ** 2 / len(y) + 1.0)
    w, b, w_at, t = np.zeros(len(rules)), bias, np.zeros(len(rules)), 1.0
    for _ in range(400):  # accelerated proximal gradient
        miss = 1 / (1 + np.exp(-(z @ w_at + b))) - y
        b -= rate * miss.mean()
        new = w_at - rate * (z.T @ miss) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * lasso, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        w_at = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return float(b - mean @ w), [(float(a), r) for a, r in zip(w, rules) if abs(a) > 1e-9]


def compiled(model: tuple[float, list[tuple[float, Path]]], of=F.col) -> Column:
    """The model's score in 0 to 1; of gives a statistic's column."""
    total = F.lit(model[0])
    for weight, rule in model[1]:
        total = total + F.when(condition(rule, of), weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN) -> tuple[float, list[tuple[float, Path]]]:
    """Fit on at most max_rows labelled rows that are not held out, taken by hash of their id."""
    import numpy as np

    known = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id")))
    known = known.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("double").alias("_y"))
    known = known.orderBy(F.xxhash64("_id"), "_id", "_y").limit(max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_t")).join(F.broadcast(known), "_id")
    stats = statistics(F.col("_t"))
    some = rows.select("_id", "_y", *[c.alias(k) for k, c in stats.items()])
    # ids may repeat in docs: the bound holds for what reaches the driver
    got = some.orderBy(F.xxhash64("_id"), "_id", "_y", *stats).limit(max_rows).toPandas().sort_values("_id", kind="stable")
    return fit_rules(got[list(stats)].to_numpy(np.float64), got["_y"].to_numpy(), list(stats))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Scores depend on texts alone; null and empty texts are scored as texts without words. Rows with a null id are
    scored and not held out; repeated rows are scored alike. With no labels, or labels of one class, every score is
    their smoothed mean (0.5 without labels). Other columns are ignored; an empty table gives an empty result.
    """
    model = fit(docs, labels, max_rows)
    stats = statistics(F.col("text"))
    rows = docs.select(F.col("doc_id"), *[c.alias(k) for k, c in stats.items()])
    scored = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), compiled(model).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = MAX_TRAIN) -> DataFrame:
    """The rows of docs that score at least threshold, with their columns."""
    model = fit(docs, labels, max_rows)
    stats = F.struct(*[c.alias(k) for k, c in statistics(F.col("text")).items()])
    # through a lambda, else the filter would hold each statistic once for every rule that uses it
    return docs.where(F.exists(F.array(stats), lambda s: compiled(model, lambda k: s[k]) >= threshold))
