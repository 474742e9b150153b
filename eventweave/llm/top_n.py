"""Top N items within every group, in two salted stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventweave.functions.text import role_key, word_key
from eventweave.operators.latest import latest_rows


def best_in(df: DataFrame, groups: list[str], order: list[Column], keep: int) -> DataFrame:
    """The first `keep` rows of every group in `order`; Spark prunes each task's rows to `keep` a group before it sorts or shuffles them."""
    return df.withColumn("__rank", F.row_number().over(W.partitionBy(*groups).orderBy(*order))).filter(F.col("__rank") <= keep).drop("__rank")


def two_stages(df: DataFrame, first: list[str], groups: list[str], order: list[Column], keep: int, between: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """The first `keep` rows of every group: ranked within the subgroups `first`, then the survivors within `groups`, which each subgroup lies in once `between` is done."""
    return best_in(between(best_in(df, first, order, keep)), groups, order, keep)


def top_n(df: DataFrame, groups: list[str], score: list[Column], identifier: list[str], n: int, salts: int = 32) -> DataFrame:
    """The `n` best rows of every group by `score`, ties by `identifier` ascending.

    Stage one ranks within `salts` subgroups by the hash of the identifier, so no task sorts a whole hot group; stage two ranks at most
    salts * n survivors of a group. Null groups are groups like others; null scores come last; equal rows take a place each.
    """
    order = [*score, *[F.col(c).asc_nulls_last() for c in identifier]]
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*identifier), F.lit(salts)).cast("int"))
    return two_stages(salted, [*groups, "__salt"], groups, order, n, lambda few: few.drop("__salt"))


def strongest_events(edges: DataFrame, words: DataFrame, n: int = 10, salts: int = 32, only_over: bool = True) -> DataFrame:
    """For every slice, word form and role the `n` events with the highest pmi: (slice_id, form, role, event_id, pmi, freq, rank).

    Order: pmi, then freq (null as least), then the lowest event_id. Of the rows of one edge (event_id, word_id, role) the latest counts; edges without
    word, or with null or NaN pmi in the row that counts, are left out, as are words without a row in `words`. `only_over`: only groups with more than n edges.

    The edges are moved once, by word and salt: the repeated rows of an edge and the first ranking are local to that partition, so a word with a third
    of all edges is spread over `salts` tasks and leaves each with at most n + 1 rows a role and slice. Only then do words join and forms merge.
    """
    e = edges.filter(F.col("word_id").isNotNull()).select("event_id", "word_id", role_key(F.col("role")).alias("role"), "slice_id", "pmi", "freq", "loaded_at")
    e = e.withColumn("salt", F.pmod(F.xxhash64("event_id"), F.lit(salts)).cast("tinyint")).repartition("word_id", "salt")
    e = latest_rows(e, ["word_id", "salt", "event_id", "role"], "loaded_at", ["pmi", "freq", "slice_id"])
    e = e.filter(F.col("pmi").isNotNull() & ~F.isnan("pmi")).drop("loaded_at")
    order = [F.col("pmi").desc(), F.col("freq").desc_nulls_last(), F.col("event_id").asc_nulls_last(), F.col("word_id").asc()]
    forms = words.filter(F.col("wordid").isNotNull() & F.col("form").isNotNull()).groupBy(F.col("wordid").alias("word_id")).agg(F.max(word_key(F.col("form"))).alias("form"))
    groups = ["slice_id", "form", "role"]
    # one more than asked for tells whether a group has more than n
    e = two_stages(e, ["word_id", "salt", "slice_id", "role"], groups, order, n + 1, lambda few: few.drop("salt").join(forms, "word_id"))
    w = W.partitionBy(*groups)
    e = e.withColumn("rank", F.row_number().over(w.orderBy(*order))).withColumn("size", F.count(F.lit(1)).over(w))
    if only_over:
        e = e.filter(F.col("size") > n)
    return e.filter(F.col("rank") <= n).select("slice_id", "form", "role", "event_id", "pmi", "freq", "rank")
