"""Which of several deliveries of one row counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_rows(df: DataFrame, keys: list[str], order: str, ties: list[str] | None = None) -> DataFrame:
    """Of the rows with equal `keys`, the one with the greatest `order`; null counts as the earliest.

    Ties go to the greatest values of `ties` (default: all other columns by name), so the result never depends on the order of arrival.
    Null keys are equal to each other. One shuffle, on the keys; rows already partitioned by some of them aren't moved.
    """
    ties = sorted(c for c in df.columns if c not in keys and c != order) if ties is None else ties
    w = W.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in ties])
    rank = "__rank"
    while rank in df.columns:
        rank += "_"
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) == 1).drop(rank)
