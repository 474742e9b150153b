"""Vector spaces: (form, vec)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventweave.functions.text import ALL_BLANKS, split_blank, strip
from eventweave.functions.vectors import cut
from eventweave.sources.files import head_lines, read_vocabulary

#: Rows of a matrix file that a task reads at once.
ROWS = 20_000


def _of(df: DataFrame, words: DataFrame | None) -> DataFrame:
    return df if words is None else df.join(words.select(words.columns[0]).withColumnRenamed(words.columns[0], "form").distinct(), "form", "left_semi")


def read_text_vectors(spark: SparkSession, path: str, words: DataFrame | None = None, length: int = -1) -> DataFrame:
    """Vectors as text: a header `number dimension`, then word and numbers. The word is all before the last `dimension` cells and may hold blanks.

    Rows with a cell that isn't a number are dropped; of rows with one word the last counts; `length` keeps the last numbers; `words` (first column) the words.
    """
    header = head_lines(spark, path, 1)[0].split()
    if len(header) != 2:
        raise ValueError(f"{path} has no header of two numbers")
    dim = int(header[1])
    rows = spark.read.text(path).withColumn("at", F.monotonically_increasing_id()).filter(F.col("at") > 0)
    cells = rows.select("at", split_blank(strip(F.col("value"), ALL_BLANKS)).alias("c")).filter(F.size("c") >= dim)
    n = F.size("c") - dim
    out = cells.select("at", F.array_join(F.slice("c", F.lit(1), n), " ").alias("form"), F.transform(F.slice("c", n + 1, F.lit(dim)), lambda x: x.try_cast("double")).alias("vec"))
    out = out.withColumn("vec", cut(F.col("vec"), length, True)).filter(~F.exists("vec", lambda x: x.isNull()))
    return _of(out.groupBy("form").agg(F.max_by("vec", "at").alias("vec")), words)


def _open(path: str):
    """A file of any file system that all machines reach, for reading at any place."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:/", path) else (fs.LocalFileSystem(), path)
    return system.open_input_file(name)


def _matrix_header(path: str) -> tuple[tuple[int, ...], np.dtype, int]:
    """(shape, type, where the numbers begin) of a matrix file in row order."""
    with _open(path) as f:
        version = np.lib.format.read_magic(f)
        shape, by_column, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
        if by_column or len(shape) != 2 or kind.hasobject:
            raise ValueError(f"{path} is no matrix of numbers in row order")
        return shape, kind, f.tell()


def read_matrix_vectors(spark: SparkSession, path: str, words: DataFrame | None = None, length: int = -1) -> DataFrame:
    """A matrix file (.npy) and its vocabulary beside it (.vocab): row i belongs to word i; `length` keeps the first numbers. Of rows with one word the last counts.

    The driver reads the header only; tasks read ROWS rows each by their place in the file, which must be on a file system that all machines reach.
    """
    (n, dim), kind, begin = _matrix_header(path)
    keep = dim if length < 0 else min(length, dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _open(path) as f:
            for b in batches:
                for block in b.column(0).to_pylist():
                    lo, hi = block * ROWS, min((block + 1) * ROWS, n)
                    rows = np.frombuffer(f.read_at((hi - lo) * dim * kind.itemsize, begin + lo * dim * kind.itemsize), kind).reshape(hi - lo, dim)[:, :keep].astype(np.float64)
                    offsets = np.arange(hi - lo + 1, dtype=np.int32) * keep
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, hi)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows).ravel()))], names=["at", "vec"])

    blocks = -(-n // ROWS)
    matrix = spark.range(0, blocks, 1, max(1, min(blocks, 10_000))).mapInArrow(run, "at bigint, vec array<double>")
    out = matrix.join(read_vocabulary(spark, path[:-4] + ".vocab").withColumnRenamed("word", "form"), "at")
    return _of(out.groupBy("form").agg(F.max_by("vec", "at").alias("vec")), words)


def read_vectors(spark: SparkSession, path: str, words: DataFrame | None = None, length: int = -1) -> DataFrame:
    """By the file's name: `.npy` is a matrix, all else text."""
    return (read_matrix_vectors if path.endswith(".npy") else read_text_vectors)(spark, path, words, length)
