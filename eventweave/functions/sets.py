"""Arrays as sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sorted_distinct(items: Column) -> Column:
    """Distinct items in code point order."""
    return F.array_sort(F.array_distinct(items))


def explode_subsets(df: DataFrame, items: str, out: str, least: int = 2) -> DataFrame:
    """One row per subset of at least `least` elements of the array `items`, in the array's order, as `out`.

    2^n - n - 1 rows for n elements and least = 2; arrays must be bounded before (at most 62 elements; use `most` of the caller).
    """
    masked = df.withColumn("__mask", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"shiftleft(1L, size(`{items}`))") - 1)))
    masked = masked.filter(F.bit_count("__mask") >= least)
    return masked.withColumn(out, F.filter(F.col(items), lambda x, i: F.getbit(F.col("__mask"), i) == 1)).drop("__mask")


def relations_of(elements: Column, target: Column) -> Column:
    """Relations of an item: those of its words and its target, without SENTENCE; sorted."""
    rels = F.array_union(F.transform(elements, lambda e: e["rel"]), F.array(target))
    return F.array_sort(F.array_except(rels, F.array(F.lit("SENTENCE"))))
