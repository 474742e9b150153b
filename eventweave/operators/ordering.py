"""Global order without a single task: running totals, row numbers and ranks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventweave.session import materialize


def running_total(df: DataFrame, order: list[Column], value: Column, out: str) -> DataFrame:
    """`out`: the sum of `value` over all rows before the row in `order` (which must be total).

    Rows are range-partitioned and written; totals are summed within partitions and shifted by those of the partitions before, of which there is one row each.
    """
    parts = materialize(df.orderBy(*order).withColumn("__part", F.spark_partition_id()).withColumn("__value", value), "ordered")
    sums = parts.groupBy("__part").agg(F.sum("__value").alias("__sum"))
    shift = sums.select("__part", F.coalesce(F.sum("__sum").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__shift"))
    within = F.sum("__value").over(W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    return parts.join(F.broadcast(shift), "__part").withColumn(out, F.coalesce(within, F.lit(0)) + F.col("__shift")).drop("__part", "__value", "__shift")


def number_rows(df: DataFrame, order: list[Column], out: str, first: int = 1) -> DataFrame:
    """Consecutive numbers from `first` in `order`, the same on every run if the order is total."""
    return running_total(df, order, F.lit(1).cast("bigint"), out).withColumn(out, (F.col(out) + first).cast("bigint"))


def number_lines(df: DataFrame, out: str = "row_id") -> DataFrame:
    """0-based numbers of the rows of files just read, in the order of the files' names and of the rows in them."""
    at = [F.col("__file"), F.col("__block"), F.col("__at")]
    placed = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at"))
    return number_rows(placed, at, out, 0).drop("__file", "__block", "__at")


def average_ranks(df: DataFrame, column: str, out: str) -> DataFrame:
    """`out`: the rank of each value from 1, equal values sharing the mean of their ranks. Null values have a null rank."""
    values = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    ranks = running_total(values, [F.col("__v")], F.col("__n"), "__before").select("__v", (F.col("__before") + (F.col("__n") + 1) / 2).alias(out))
    return df.join(ranks, df[column] == ranks["__v"], "left").drop("__v")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (n, rho): rank correlation over rows where both are there; null for fewer than two rows or a constant column."""
    both = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    both = materialize(both, "both")
    ranked = average_ranks(average_ranks(both, "x", "rx"), "y", "ry")
    n = F.count(F.lit(1))
    rho = F.try_divide(F.covar_pop("rx", "ry"), F.stddev_pop("rx") * F.stddev_pop("ry"))
    return ranked.agg(n.alias("n"), rho.alias("rho"))


def spearman_p(n: int, rho: float | None) -> float | None:
    """Two-sided probability of a rank correlation at least as far from 0 by chance, by Student's distribution with n - 2 degrees of freedom; null for fewer than three rows."""
    if rho is None or n < 3:
        return None
    if abs(rho) >= 1:
        return 0.0
    return _beta_share((n - 2) / 2, 0.5, 1 - rho * rho)


def _beta_share(a: float, b: float, x: float) -> float:
    """The regularized incomplete beta function, by its continued fraction (evaluated from the end that converges)."""
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a if x > 0 else 0.0
    tail = 1.0
    for m in range(300, 0, -1):
        k = m // 2
        term = k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)) if m % 2 == 0 else -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
        tail = 1 + term / tail
    return front / tail
