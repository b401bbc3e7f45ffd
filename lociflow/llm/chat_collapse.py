"""Chat formatting after a collapse of cumulative snapshots.

Chat systems log a conversation again after each turn, so that a log holds the prefixes of its longer conversations.
Every conversation gets a rolling hash of each of its turn prefixes. Equal conversations first fall to the one of
smallest id; the rest are kept where no longer conversation has their full hash among its proper prefixes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and its turns as an ordered array; repeated log lines count once."""
    clean = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    return clean.groupBy("conv_id").agg(F.array_sort(F.collect_set("t")).alias("turns"))


def prefix_hashes(turns: Column) -> Column:
    """The rolling hash after each turn: each entry hashes the one before with the turn's role and text."""
    step = lambda a, t: F.struct(
        F.sha2(F.concat(a["last"], F.sha2(t["role"], 256), F.sha2(t["text"], 256)), 256).alias("last"),
        F.array_append(a["all"], a["last"]).alias("all"),
    )
    start = F.struct(F.lit("").alias("last"), F.array().cast("array<string>").alias("all"))
    return F.aggregate(turns, start, step, lambda a: F.slice(F.array_append(a["all"], a["last"]), 2, F.size(turns)))


def render(turns: Column) -> Column:
    """ChatML text; a marker inside a turn is broken by a blank so that no turn can forge another."""
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    line = lambda t: F.concat(F.lit("<|im_start|>"), safe(t["role"]), F.lit("\n"), safe(t["text"]), F.lit("<|im_end|>\n"))
    return F.array_join(F.transform(turns, line), "")


def collapse(turns: DataFrame) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, n_copies, chat.

    Turns are ordered by (turn, role, text), nulls first; a turn number itself is no part of a prefix, nor are gaps
    between numbers. Rows that repeat all of (conv_id, turn, role, text) count once. Null role or text reads as empty;
    rows of null conv_id belong to no conversation and are left out. ``n_copies`` counts the conversations equal to the
    kept one, itself included. Other columns are not read; an empty table gives no row. Texts are hashed and rendered whole,
    however long; a conversation is one row, so that it must fit in a task's memory.

    Hashes, not turns, are shuffled for the collapse: equal conversations and equal prefixes combine before the
    shuffle, so that neither a common first turn nor a copied conversation gathers rows.
    """
    full = conversations(turns)
    hashed = full.select("conv_id", F.size("turns").alias("n_turns"), prefix_hashes(F.col("turns")).alias("prefixes"))
    distinct = (
        hashed.withColumn("hash", F.element_at("prefixes", -1))
        .groupBy("hash")
        .agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"), F.first("n_turns").alias("n_turns"), F.first("prefixes").alias("prefixes"))
    )
    proper = distinct.where("n_turns > 1").select(F.explode(F.slice("prefixes", 1, F.col("n_turns") - 1)).alias("hash")).distinct()
    kept = distinct.drop("prefixes").join(proper, "hash", "left_anti")
    return full.join(kept.select("conv_id", "n_turns", "n_copies"), "conv_id").select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "n_copies", render(F.col("turns")).alias("chat"))
