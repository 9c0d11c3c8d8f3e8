"""Conversation corpora: validation, repair, merging, filters, dedupe, split. Conversations are arrays of messages or
rows of (conv_id, turn, role, text)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.operators.rounds import stored

from loomline.functions import text as T

# Replies without substance.
FILLERS = ("hange", "okay", "ok", "k", "hmm", "hm", "loss", "daa", "ra", "bro", "maccha", "lo", "guru", "yep", "nope", "ya", "nah", "yaa", "huu", "hu")
MESSAGES = "array<struct<role:string,content:string>>"


def gathered(turns: DataFrame) -> DataFrame:
    """conv_id and messages, in turn order."""
    each = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return turns.groupBy("conv_id").agg(F.transform(each, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def invalid_reason(messages: Column) -> Column:
    """The first structural fault, null if there is none."""
    bad = F.filter(
        F.transform(messages, lambda m, i: F.struct(i.alias("i"), m["role"].isNull().alias("no_role"), (m["content"].isNull() | (F.trim(m["content"]) == "")).alias("blank"))),
        lambda m: m["no_role"] | m["blank"],
    )
    first = F.get(bad, F.lit(0))
    role = lambda r: F.exists(messages, lambda m: m["role"] == r)
    return (
        F.when(messages.isNull(), "missing_messages_field")
        .when(F.size(messages) < 2, "insufficient_messages")
        .when(F.size(bad) > 0, F.concat(F.lit("message_"), first["i"].cast("string"), F.when(first["no_role"], "_missing_fields").otherwise("_invalid_content")))
        .when(~role("user"), "no_user_message")
        .when(~role("assistant"), "no_assistant_message")
    )


def repaired(messages: Column) -> Column:
    """Without a reply that stands right after the system message."""
    broken = (F.get(messages, F.lit(0))["role"] == "system") & (F.get(messages, F.lit(1))["role"] == "assistant")
    return F.when(F.coalesce(broken, F.lit(False)), F.filter(messages, lambda m, i: i != 1)).otherwise(messages)


def merged_roles(turns: DataFrame) -> DataFrame:
    """turns with runs of one role (but system) as one row: conv_id, turn (the first), role, text joined by newlines."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    new = (F.col("role") == "system") | ~F.coalesce(F.col("role") == F.lag("role").over(order), F.lit(False))
    island = turns.withColumn("_run", F.sum(new.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    each = F.array_sort(F.collect_list(F.struct("turn", "text")))
    joined = F.array_join(F.transform(each, lambda x: x["text"]), "\n")
    return island.groupBy("conv_id", "_run", "role").agg(F.min("turn").alias("turn"), joined.alias("text")).drop("_run").select("conv_id", "turn", "role", "text")


def filler_only(messages: Column) -> Column:
    """Whether no assistant message has more than fillers, at most two of them."""

    def substance(m: Column) -> Column:
        words = F.filter(F.split(F.lower(F.trim(F.regexp_replace(m["content"], r"(?U)[^\w\s]", ""))), r"(?U)\s+"), lambda w: w != "")
        return (m["role"] == "assistant") & ((F.size(words) > 2) | F.exists(words, lambda w: ~w.isin(*FILLERS)))

    return ~F.exists(messages, substance)


def english_only(messages: Column, strip: bool = False, after_system_only: bool = False) -> Column:
    """messages if all that are not blank are English (or, with strip, the English ones), else null.

    A reply in second place goes even without a system message, unless after_system_only; two messages must be left.
    """
    blank = lambda m: F.trim(F.coalesce(m["content"], F.lit(""))) == ""
    ok = lambda m: blank(m) | T.is_english(m["content"])
    kept = F.filter(messages, ok) if strip else F.when(F.forall(messages, ok), messages)
    second = F.get(kept, F.lit(1))["role"] == "assistant"
    if after_system_only:
        second = second & (F.get(kept, F.lit(0))["role"] == "system")
    out = F.when(F.coalesce(second, F.lit(False)), F.filter(kept, lambda m, i: i != 1)).otherwise(kept)
    return F.when((F.size(kept) >= 2) & (F.size(out) >= 2), out)


def writable(messages: Column) -> Column:
    """What the JSONL sink accepts: two messages, known roles, no blank content."""
    fine = F.forall(messages, lambda m: m["role"].isin("system", "user", "assistant") & (F.trim(m["content"]) != ""))
    return F.coalesce((F.size(messages) >= 2) & fine, F.lit(False))


def first_of_equal(rows: DataFrame, same: Column, order: str) -> DataFrame:
    """The first row of each value of same."""
    w = Window.partitionBy(F.md5(same.cast("string")), same).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def split_train(rows: DataFrame, key: Column, seed: int = 42, ratio: float = 0.1) -> DataFrame:
    """rows with part: the first floor(n (1 - ratio)) by md5 of key and seed are train, the rest val.

    The order is total, so the cut is exact: hash buckets give each row's rank without sorting everything in one task.
    """
    marked = rows.withColumn("_h", F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))).withColumn("_b", F.substring("_h", 1, 3))
    sizes = marked.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(F.lit(0)).orderBy("_b")  # 4096 buckets at most
    sizes = sizes.withColumn("_before", F.sum("_c").over(before) - F.col("_c")).withColumn("_n", F.sum("_c").over(Window.partitionBy(F.lit(0))))
    ranked = marked.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))).join(F.broadcast(sizes), "_b")
    train = F.col("_r") + F.col("_before") <= F.floor(F.col("_n") * (1 - ratio))
    return ranked.withColumn("part", F.when(train, "train").otherwise("val")).drop("_h", "_b", "_r", "_c", "_before", "_n")


def overlap_deduped(rows: DataFrame, row_id: str, items: str, most: float = 0.5) -> DataFrame:
    """Rows (row_id, items: array of strings) kept by the greedy overlap rule, in order of row_id.

    A row goes if more than most of its items occur in kept rows before it; row_id is unique. Only rows that share an
    item depend on the order. They are decided in rounds: a row goes if the kept rows before it suffice, and stays if
    all kept and undecided ones before it do not. The first undecided row is always decided; a round is two grouped
    aggregates and a join by item, so no task sees a group of rows. Rows without items stay. Rounds grow with the longest
    chain of rows that each wait for the one before: three for the documents of sf0.01 and of sf0.1 (measured), as many
    as there are rows where each row shares most of its items with the one before alone.
    """
    hashed = rows.select(F.col(row_id).alias("id"), F.explode(F.transform(items, lambda x: F.md5(F.lower(F.trim(x))))).alias("item"))
    each = hashed.groupBy("id", "item").agg(F.count(F.lit(1)).alias("n"))
    sizes = each.groupBy("id").agg(F.sum("n").alias("size"))
    shared = each.groupBy("item").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("item")
    tied = stored(each.join(shared, "item").join(sizes, "id"))
    state = stored(tied.select("id").distinct().withColumn("kept", F.lit(None).cast("boolean")))
    while state.where("kept is null").limit(1).count():
        now = tied.join(state, "id")
        firsts = now.where("kept is not false").groupBy("item").agg(F.min(F.when(F.col("kept"), F.col("id"))).alias("sure"), F.min("id").alias("open"))
        seen = lambda first: F.sum(F.when(F.coalesce(F.col(first) < F.col("id"), F.lit(False)), F.col("n")).otherwise(0)) / F.first("size")
        shares = now.where("kept is null").join(firsts, "item", "left").groupBy("id").agg(seen("sure").alias("low"), seen("open").alias("high"))
        decided = shares.select("id", F.when(F.col("low") > most, False).when(F.col("high") <= most, True).alias("now"))
        state = stored(state.join(decided, "id", "left").select("id", F.coalesce("kept", "now").alias("kept")))
    gone = state.where("not kept").select(F.col("id").alias(row_id))
    return rows.join(gone, row_id, "left_anti")


def edited_dropped(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) without messages whose edited version follows at once; that one stays, without
    its mark. Versions count as such if their words, without marks, are over 0.7 alike.

    Whether a message is skipped depends on what became of the one before, so runs of marked messages are folded; the
    pairs themselves come from a window, and only conversations with a marked message reach the fold.
    """
    marked = F.max(F.contains(F.coalesce("text", F.lit("")), F.lit("(edited)")).cast("int")).over(Window.partitionBy("conv_id"))
    rows = turns.select("conv_id", "turn", "role", "text").withColumn("_m", marked)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        import re
        from difflib import SequenceMatcher

        bare = lambda t: re.sub(r"[^\w\s]", "", t.strip()).lower()
        pdf = pdf.sort_values("turn")
        turn, role, text = pdf.turn.tolist(), pdf.role.tolist(), [t or "" for t in pdf.text]
        out, skip = [], False
        for i in range(len(turn)):
            if skip:
                skip = False
                continue
            after = text[i + 1] if i + 1 < len(turn) and role[i] != "system" and role[i + 1] == role[i] else ""
            if "(edited)" in after:
                plain = after.replace("(edited)", "")
                if SequenceMatcher(None, bare(text[i]), bare(plain)).ratio() > 0.7:
                    out.append((turn[i + 1], role[i], after.replace(" (edited)", "").replace("(edited)", "").strip()))
                    skip = True
                    continue
            out.append((turn[i], role[i], text[i]))
        got = pd.DataFrame(out, columns=["turn", "role", "text"])
        got.insert(0, "conv_id", pdf.conv_id.iloc[0])
        return got

    plain = turns.select("conv_id", "turn", "role", "text")
    folded = rows.where("_m = 1").drop("_m").groupBy("conv_id").applyInPandas(fold, plain.schema)
    return rows.where("_m = 0 or _m is null").drop("_m").unionByName(folded)
