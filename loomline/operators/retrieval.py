"""The best candidates of each row by shared words: a weighted inverted index with upper bounds and early stop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.operators.rounds import stored


def _first(df: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """The first rows of each key; Spark cuts each task's rows to as many before they move."""
    return df.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("n") <= most)


ROWS_A_TASK = 250_000  # of the result, about


def best_lists(rows: DataFrame, key: str, words: str, most: int = 15, own: list[str] | None = None, theirs: list[str] | None = None) -> DataFrame:
    """key, own, best for each row that has matches: the other rows with the greatest weight of shared words, most at the
    utmost and the best first, as an array of other, weight (long) and theirs; ties go to the smaller other.

    rows: key (unique, not null) and words, an array without blanks in its strings. A word weighs round(1000 ln(rows /
    rows with it)); words of weight 0 find nothing. Rows that share no weight, with no or null words, have no matches.
    own and theirs: structs of these columns (key alone, if none are named) of the row and of the other; other columns are
    ignored. An empty table gives an empty result.

    Rows with the same words are one entry of the index, of which most + 1 rows are enough. Each entry probes the
    postings of its words from the rarest on, and stops as soon as what its other words weigh together is less than the
    weight of its last kept row: no row without a probed word can then get in. So frequent words are probed by entries
    alone that have nothing better. Kept rows are bounded by most + 1 an entry. They are given to the entry's rows at
    last, in tasks of about ROWS_A_TASK matches; an entry of more rows takes several.
    """
    words_of = F.array_sort(F.array_distinct(F.filter(words, lambda w: w.isNotNull())))
    packed = lambda names, alias: F.struct(*[F.col(c) for c in names or [key]]).alias(alias)
    base = stored(rows.select(F.col(key).alias("other"), F.array_join(words_of, " ").alias("entry"), packed(own, "own"), packed(theirs, "theirs")).where("entry <> ''"))
    number = base.count()
    entries = base.groupBy("entry").agg(F.count(F.lit(1)).alias("copies"), F.min("other").alias("least"))
    each = entries.select("*", F.explode(F.split("entry", " ")).alias("word"))
    weight = F.round(1000 * F.log(F.lit(float(number)) / F.sum("copies"))).cast("long")
    weights = each.groupBy("word").agg(weight.alias("weight")).where("weight > 0")
    term = F.struct("weight", "word")
    terms = F.sort_array(F.collect_list(term), asc=False).alias("terms")
    index = stored(each.join(weights, "word").groupBy("entry").agg(F.min("least").alias("least"), terms))
    few = stored(_first(base.select("entry", "other").join(index.select("entry"), "entry"), "entry", [F.col("other")], most + 1).select("entry", "other"))
    postings = index.select(F.explode("terms.word").alias("word"), F.col("entry").alias("found"), F.col("least"), F.col("terms").alias("theirs"))

    kept = few.select(F.col("entry").alias("asker"), F.lit(0).cast("long").alias("weight"), "other").limit(0)
    active = index.select(F.col("entry").alias("asker"), "terms", F.lit(0).cast("long").alias("bound"))
    turn = 0
    while not active.isEmpty():
        probes = active.withColumn("word", F.get("terms", F.lit(turn))["word"])
        # a pair counts at the first word that its entries share
        new = probes.join(postings, "word").where(~F.arrays_overlap(F.slice("terms", 1, turn), "theirs") if turn else F.lit(True))
        shared = F.aggregate(F.array_intersect("terms", "theirs"), F.lit(0).cast("long"), lambda s, x: s + x["weight"])
        new = new.select("asker", "found", "least", "bound", shared.alias("weight")).where("weight >= bound")
        new = _first(new, "asker", [F.col("weight").desc(), F.col("least")], most + 1)
        found = new.join(few.withColumnRenamed("entry", "found"), "found").select("asker", "weight", "other")
        kept = stored(_first(kept.unionByName(found), "asker", [F.col("weight").desc(), F.col("other")], most + 1).drop("n"))
        turn += 1
        bounds = kept.groupBy("asker").agg(F.count(F.lit(1)).alias("rows"), F.min("weight").alias("last"))
        rest = F.aggregate(F.slice("terms", turn + 1, F.greatest(F.size("terms"), F.lit(1))), F.lit(0).cast("long"), lambda s, x: s + x["weight"])
        left = active.select("asker", "terms").where(F.size("terms") > turn).join(bounds, "asker", "left")
        left = left.withColumn("bound", F.when(F.col("rows") > most, F.col("last")).otherwise(0).cast("long"))
        active = stored(left.where(rest >= F.col("bound")).select("asker", "terms", "bound"))

    given = kept.join(base.select("other", "theirs"), "other")
    best = F.sort_array(F.collect_list(F.struct(-F.col("weight"), "other", "weight", "theirs"))).alias("best")
    lists = given.groupBy(F.col("asker").alias("entry")).agg(best)
    # tasks are sized by what they give: adaptive execution would size them by what they read
    a_task = max(ROWS_A_TASK // most, 1)
    large = entries.where(F.col("copies") > a_task).select("entry", F.ceil(F.col("copies") / a_task).cast("int").alias("shares"))  # one in a_task rows at most
    shares = F.coalesce("shares", F.lit(1))
    dealt = base.select(F.col("other").alias(key), "entry", "own").join(F.broadcast(large), "entry", "left").withColumn("share", F.pmod(F.xxhash64(key), shares).cast("int"))
    copied = lists.join(F.broadcast(large), "entry", "left").withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1)))
    # both sides, as a join would else deal anew by the entry alone
    dealt, copied = (x.drop("shares").repartition(-(-number // a_task) or 1, "entry", "share") for x in (dealt, copied))
    found = dealt.join(copied, ["entry", "share"]).select(key, "own", F.slice(F.filter("best", lambda x: x["other"] != F.col(key)), 1, most).alias("best"))
    return found.where(F.size("best") > 0).withColumn("best", F.transform("best", lambda x: F.struct(x["other"].alias("other"), x["weight"].alias("weight"), x["theirs"].alias("theirs"))))


def best_matches(rows: DataFrame, key: str, words: str, most: int = 15, own: list[str] | None = None, theirs: list[str] | None = None) -> DataFrame:
    """key, other, weight, place (from 1) and, where they are asked for, own and theirs: best_lists, a row for each match."""
    each = best_lists(rows, key, words, most, own, theirs).select(key, "own", F.posexplode("best").alias("place", "b"))
    each = each.select(key, "b.other", "b.weight", (F.col("place") + 1).alias("place"), "own", "b.theirs")
    return each.drop(*[c for c, names in (("own", own), ("theirs", theirs)) if not names])
