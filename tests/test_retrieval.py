"""Retrieval against a loop over all pairs."""

import math
import random

import pytest

from loomline.operators.retrieval import best_matches


def brute(rows, most):
    sets = {k: {w for w in words or [] if w} for k, words in rows}
    sets = {k: s for k, s in sets.items() if s}
    count = {}
    for s in sets.values():
        for w in s:
            count[w] = count.get(w, 0) + 1
    weight = {w: math.floor(1000 * math.log(len(sets) / n) + 0.5) for w, n in count.items()}
    out = {}
    for a, x in sets.items():
        scores = sorted((-sum(weight[w] for w in x & y), b) for b, y in sets.items() if b != a)
        out[a] = [(b, -s) for s, b in scores if s < 0][:most]
    return {a: v for a, v in out.items() if v}


def told(frame, most):
    out = {}
    for r in best_matches(frame, "id", "words", most).orderBy("id", "place").collect():
        out.setdefault(r.id, []).append((r.other, r.weight))
        assert r.place == len(out[r.id])
    return out


@pytest.mark.parametrize("most", [1, 3, 15])
def test_best_matches(spark, most):
    r = random.Random(most)
    vocabulary = [f"w{int(r.paretovariate(0.7)) % 60}" for _ in range(400)]
    rows = [(i, [r.choice(vocabulary) for _ in range(r.randint(0, 6))]) for i in range(150)]
    rows += [(200 + i, ["w1", "w2", "red"]) for i in range(40)]  # a group of equal rows
    rows += [(300 + i, ["w1", "only"] if i else ["alone"]) for i in range(3)] + [(400, None), (401, ["w3", None, "w3"])]
    frame = spark.createDataFrame([(i, w, "x", 1, "e") for i, w in rows], "id long, words array<string>, other string, weight int, entry string").repartition(5)
    assert told(frame, most) == brute([(i, [w for w in ws or [] if w]) for i, ws in rows], most)


def test_no_rows(spark):
    frame = spark.createDataFrame([(1, ["a"]), (2, ["a"])], "id long, words array<string>")
    assert told(frame, 5) == {} and told(frame.limit(0), 5) == {}  # a word of every row weighs nothing


def test_tasks_by_what_they_give(spark):
    """An entry of many rows is dealt over several tasks, though all rows read are few."""
    from pyspark.sql import functions as F

    words = F.when(F.col("id") % 3 > 0, F.array(F.lit("common"))).otherwise(F.array(F.lit("rare")))
    frame = spark.range(60_000).select("id", words.alias("words"))
    got = best_matches(frame, "id", "words")
    sizes = [n for n in got.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert sum(sizes) == 900_000 and len(sizes) > 1


def test_lists_rank_as_rows_do(spark):
    from pyspark.sql import functions as F

    from loomline.operators import match

    r = random.Random(2)
    rows = [(k, c, r.choice([0, 59, 60, 79, 80, 90]), rank) for k in range(40) for rank, c in enumerate(r.sample(range(90), r.randint(1, 9)))]
    frame = spark.createDataFrame(rows, "k int, candidate int, score int, rank int")
    lists = frame.groupBy("k").agg(F.collect_list(F.struct("candidate", "score", "rank")).alias("found"))
    for free in (False, True):
        want = match.resolved(frame.withColumn("seq", F.col("candidate")), "k", "candidate", F.lit(free)).select("k", "best", "url", "candidates").collect()
        got = lists.select("k", match.resolved_list(F.col("found"), F.lit(free)).alias("r")).select("k", "r.*").collect()
        assert sorted(got, key=lambda x: x.k) == sorted(want, key=lambda x: x.k)
