"""Scores of representations against human ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventweave.functions.vectors import cosine_or_zero
from eventweave.operators.prepare import GOLD_COLUMNS


def pair_similarity(mapping: DataFrame, results: DataFrame, gold: DataFrame) -> DataFrame:
    """`gold` (row_id, score) with `sims`, the cosine of the context vectors of both items of a pair; null where one has none. Pairs that aren't mapped are left out."""
    v = results.select("item_id", "ac")
    rows = mapping.join(v.select(F.col("item_id").alias("row1"), F.col("ac").alias("__a")), "row1").join(v.select(F.col("item_id").alias("row2"), F.col("ac").alias("__b")), "row2")
    return gold.join(rows.select(F.col("orig").alias("row_id"), cosine_or_zero(F.col("__a"), F.col("__b")).alias("sims")), "row_id")


def context_similarity(pairs: DataFrame, gold: DataFrame) -> DataFrame:
    """`pair_similarity` of pairs (orig, ac1, ac2) that come with both vectors."""
    return gold.join(pairs.select(F.col("orig").alias("row_id"), cosine_or_zero(F.col("ac1"), F.col("ac2")).alias("sims")), "row_id")


def filler_similarity(results: DataFrame, gold: DataFrame, vectors: DataFrame) -> DataFrame:
    """`gold` (row_id, mean_rat, column of fillers) with `sims`, the cosine of the context vector and that of the filler in the column of the target.

    Rows whose filler has no vector are left out; where the context has none, sims is null.
    """
    rows = gold.join(results.select(F.col("item_id").alias("row_id"), "target", "ac"), "row_id")
    columns = [c for c in gold.columns if c.isupper()]
    filler = F.coalesce(*[F.when(F.col("target").isin(c, *[t for t, g in GOLD_COLUMNS.items() if g == c]), F.col(c)) for c in columns])
    rows = rows.withColumn("__form", filler).join(vectors.select(F.col("form").alias("__form"), "vec"), "__form")
    return rows.withColumn("sims", cosine_or_zero(F.col("ac"), F.col("vec"))).drop("__form", "vec", "ac", "target")
