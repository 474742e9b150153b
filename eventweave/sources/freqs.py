"""Frequency tables as text: `item<TAB>freq`, plain or gzip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ITEM = T.StructType([T.StructField("item", T.StringType()), T.StructField("freq", T.StringType()), T.StructField("corrupt", T.StringType())])


def _parsed(spark: SparkSession, path: str | list[str], delimiter: str) -> DataFrame:
    rows = spark.read.csv(path, sep=delimiter, schema=ITEM, quote="", mode="PERMISSIVE", columnNameOfCorruptRecord="corrupt")
    freq = F.col("freq").try_cast("double")
    return rows.select("item", F.when(~F.isnan(freq) & (F.abs(freq) < float("inf")), freq.try_cast("bigint")).alias("freq"), F.col("freq").alias("raw"), "corrupt")


def _sound() -> Column:
    return F.col("corrupt").isNull() & F.col("item").isNotNull() & F.col("freq").isNotNull()


def read_freqs(spark: SparkSession, path: str | list[str], delimiter: str = "\t") -> DataFrame:
    """(item, freq bigint): distinct rows. Compression is told by the file's name; frequencies may be written as 12 or 12.0. Rows of other shape come out of `rejected_freqs`."""
    return _parsed(spark, path, delimiter).filter(_sound()).select("item", "freq").distinct()


def rejected_freqs(spark: SparkSession, path: str | list[str], delimiter: str = "\t") -> DataFrame:
    """(line, reason): rows that `read_freqs` leaves out; `columns` for other than two cells, `freq` for a frequency that is no number."""
    bad = _parsed(spark, path, delimiter).filter(~_sound())
    return bad.select(F.coalesce("corrupt", F.concat_ws(delimiter, "item", "raw")).alias("line"), F.when(F.col("corrupt").isNotNull() | F.col("item").isNull() | F.col("raw").isNull(), "columns").otherwise("freq").alias("reason"))


def read_lemma_freqs(spark: SparkSession, path: str | list[str], threshold: float | None = None, delimiter: str = "\t") -> DataFrame:
    """(lemma, pos, freq) of items `lemma pos`, with a frequency strictly above the threshold."""
    rows = read_freqs(spark, path, delimiter)
    if threshold is not None:
        rows = rows.filter(F.col("freq") > threshold)
    parts = F.split("item", " ")
    return rows.select(F.get(parts, F.lit(0)).alias("lemma"), F.get(parts, F.lit(1)).alias("pos"), "freq")


def read_event_freqs(spark: SparkSession, path: str | list[str], threshold: float | None = None) -> DataFrame:
    """(event, freq) of items with blanks between members."""
    rows = read_freqs(spark, path).withColumnRenamed("item", "event")
    return rows if threshold is None else rows.filter(F.col("freq") > threshold)


def write_freqs(df: DataFrame, items: list[str], path: str, compression: str = "gzip", sort: bool = True) -> None:
    """`item<TAB>freq` files, the item's columns joined by blanks, sorted by item. The range partitioning of the sort is the only shuffle."""
    rows = df.select(F.concat_ws(" ", *items).alias("item"), "freq")
    rows = rows.orderBy("item") if sort else rows
    rows.select(F.concat_ws("\t", "item", F.col("freq").cast("string"))).write.mode("overwrite").option("compression", compression).text(path)
