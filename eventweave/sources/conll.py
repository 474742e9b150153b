"""Parsed corpora as text files: lines `id text lemma upos ne deprels`, blank lines between sentences."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventweave.functions.text import ALL_BLANKS, strip
from eventweave.operators.sentences import is_blank, sentence_numbers, text_sentences
from eventweave.sources.files import list_files

TOKEN = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "text", "lemma", "upos", "head", "deprel")])
PARSED = T.StructType([T.StructField("tokens", T.ArrayType(TOKEN))])


#: A line end with blank lines after it.
SEPARATOR = r"\r?\n(?:[ \t\r\f\x0B]*\n)+"


def split_blocks(texts: DataFrame) -> DataFrame:
    """One row a sentence of rows (value) that hold whole sentences: divided at blank lines, with blanks and carriage returns or without. Row-local."""
    rows = texts.withColumn("value", F.explode(F.split("value", SEPARATOR)))
    return rows.filter(~is_blank(F.col("value")))


def sentence_texts(spark: SparkSession, paths: list[str], compact: bool = False) -> DataFrame:
    """(file, value): the text of each sentence, the lines between blank ones; a line of nothing but white space is blank, whatever ends lines.

    Files are read by lines, so any is divided among tasks, and sentences are numbered by file and block: two shuffles of the lines. `compact` promises that some empty lines are
    exactly that, two line feeds: then files are divided there and all is one narrow stage, but a file without any (with carriage returns) is one row.
    """
    names = list_files(spark, paths)
    if not names:
        return spark.createDataFrame([], "file string, value string")
    if compact:
        return split_blocks(spark.read.option("lineSep", "\n\n").text(names).select(F.input_file_name().alias("file"), "value"))
    # ids go up within a block of a file, and blocks in the order of their starts
    lines = spark.read.text(names).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    rows = sentence_numbers(lines, "file", "at", F.col("block"), "value").filter(~is_blank(F.col("value")))
    whole = rows.groupBy("file", "sentence").agg(F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("lines"))
    return whole.select("file", F.array_join(F.transform("lines", lambda x: x["value"]), "\n").alias("value"))


def read_conll(spark: SparkSession, paths: list[str], delimiter: str = " ", strict: bool = True, compact: bool = False) -> DataFrame:
    """(file, tokens): accepted tokens of each sentence. Sentences with a relation without `=` are dropped; a line that isn't six fields fails, or with
    `strict=False` drops its sentence. `compact`: see `sentence_texts`."""
    return text_sentences(sentence_texts(spark, paths, compact), "value", delimiter, strict)


def read_raw_sentences(spark: SparkSession, paths: list[str], compact: bool = False) -> DataFrame:
    """(file, lines): sentences as arrays of their raw lines, for corpora in other formats."""
    texts = sentence_texts(spark, paths, compact)
    return texts.select("file", F.filter(F.transform(F.split("value", "\n"), lambda x: strip(x, ALL_BLANKS)), lambda x: x != "").alias("lines"))


def parse_texts(texts: DataFrame, parser: Callable[[], Callable[[str], list[list[dict]]]], text: str = "text", preprocess: Callable[[str], str] | None = None) -> DataFrame:
    """(tokens) of raw texts by a parser of the user's: `parser()` is called once a task and gives a function from text to sentences of token dicts.

    For parsers that run in Python; texts go to them in Arrow batches. Null texts have no sentences.
    """

    kind = pa.list_(pa.struct([(c, pa.string()) for c in TOKEN.names]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parse = parser()
        for b in batches:
            out = []
            for t in b.column(0).to_pylist():
                if t is not None:
                    out += [[{c: str(tok.get(c, "")) for c in TOKEN.names} for tok in s] for s in parse(preprocess(t) if preprocess else t)]
            yield pa.RecordBatch.from_arrays([pa.array(out, kind)], names=["tokens"])

    return texts.select(F.col(text).alias("text")).mapInArrow(run, PARSED)
