"""Items, gold ratings and results as tab-separated files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventweave.functions.sets import relations_of
from eventweave.functions.text import ALL_BLANKS, split_blank, strip
from eventweave.operators.ordering import number_lines
from eventweave.sources.files import head_lines

#: The columns of items under their possible names.
ITEM, TARGETS = "item", ("target-relation", "target_relation")


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """(item_id, item, target, elements, relations) of a file whose header names `item` and `target-relation`; item_id counts its rows from 0.

    Elements are the item's `form@pos@rel` in order; a row with an element of another form fails. Other columns are ignored.
    """
    header = head_lines(spark, path, 1)[0].split()
    target = next((t for t in TARGETS if t in header), None)
    if ITEM not in header or target is None:
        raise ValueError(f"{path} has no columns {ITEM} and {TARGETS[0]}: {header}")
    # a folder may hold the header once a file
    lines = spark.read.text(path)
    lines = lines.filter((strip(F.col("value"), ALL_BLANKS) != "") & (F.array_join(split_blank(F.col("value")), " ") != " ".join(header)))
    rows = number_lines(lines, "__line")
    cells = F.split(strip(F.col("value"), ALL_BLANKS), "\t", -1)
    rows = rows.select(F.col("__line").alias("item_id"), F.get(cells, F.lit(header.index(ITEM))).alias("item"), F.get(cells, F.lit(header.index(target))).alias("target"))

    def element(x):
        p = F.split(x, "@", -1)
        return F.when(F.size(p) == 3, F.struct(p[0].alias("form"), p[1].alias("pos"), p[2].alias("rel"))).otherwise(F.raise_error(F.concat(F.lit("not form@pos@rel: "), x)).cast("struct<form:string,pos:string,rel:string>"))

    rows = rows.withColumn("elements", F.transform(split_blank(F.col("item")), element))
    return rows.withColumn("relations", relations_of(F.col("elements"), F.col("target")))


def read_gold(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """`row_id` from 0 and the file's columns (c0, c1, ... without header); `score`, `mean_rat` and the deviations are numbers, all else text."""
    rows = number_lines(spark.read.csv(path, sep="\t", header=header, quote=""))
    if not header:
        rows = rows.toDF(*[f"c{i}" for i in range(len(rows.columns) - 1)], "row_id")
    numbers = [c for c in rows.columns if c in ("score", "st_dev", "mean_rat", "std_rat")]
    return rows.withColumns({c: F.col(c).try_cast("double") for c in numbers})


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(orig, row1, row2) of a file without header."""
    return spark.read.csv(path, sep="\t", schema="orig bigint, row1 bigint, row2 bigint")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(item_id, item, target, lc, ac) of a result file; `None` is null."""
    rows = number_lines(spark.read.csv(path, sep="\t", header=True, quote=""), "item_id")
    target = next(t for t in TARGETS if t in rows.columns)
    vec = lambda c: F.when(F.col(c) != "None", F.transform(split_blank(F.col(c)), lambda x: x.try_cast("double")))
    return rows.select("item_id", "item", F.col(f"`{target}`").alias("target"), vec("LC_vector").alias("lc"), vec("AC_vector").alias("ac"))


def result_rows(df: DataFrame) -> DataFrame:
    """`lc` and `ac` as text: numbers with three decimals between blanks, `None` for null."""
    text = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: F.format_string("%.3f", x)), " "), F.lit("None"))
    return df.select(F.col("item"), F.col("target").alias("target-relation"), text("lc").alias("LC_vector"), text("ac").alias("AC_vector"), "item_id")


def write_results(df: DataFrame, path: str) -> None:
    """A result file in the order of the items."""
    _write(result_rows(df).orderBy("item_id").drop("item_id"), path)


def write_trace(df: DataFrame, path: str) -> None:
    """Steps of the active contexts in order: item, relation, step and labels."""
    _write(df.orderBy("item_id", "box", "step").select("item_id", "box", "step", "labels"), path)


def write_items(df: DataFrame, path: str) -> None:
    """Prepared items in order, with header."""
    _write(df.orderBy("item_id").select("item", F.col("target").alias("target-relation")), path)


def write_mapping(df: DataFrame, path: str) -> None:
    df.orderBy("orig").select("orig", "row1", "row2").write.mode("overwrite").csv(path, sep="\t")


def write_sims(df: DataFrame, path: str) -> None:
    """Gold rows with their similarity, comma-separated with header."""
    df.orderBy("row_id").drop("row_id").write.mode("overwrite").csv(path, header=True)


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True, quote="", escapeQuotes=False)
