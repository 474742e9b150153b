"""Queries on the raw lines of the corpus: what parses and what doesn't."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventweave.operators import malformed
from eventweave.session import scratch_dir, table
from eventweave.sources.files import is_file
from eventweave.streaming.counts import run_to_folder


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return malformed.rejected(table(spark, sf, "corpus_lines"), table(spark, sf, "corpus_files")).select("line_id", "reason")


def p1_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """The valid token lines with their values."""
    return malformed.tokens(table(spark, sf, "corpus_lines"), table(spark, sf, "corpus_files")).select("line_id", "token_id", "text", "lemma", "upos", "ne", "deprels")


def p1_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Lines by outcome and file."""
    out = malformed.parse_lines(table(spark, sf, "corpus_lines"), table(spark, sf, "corpus_files")).filter(F.col("id").isNotNull() | F.col("reason").isNotNull())
    return out.groupBy("file_name", F.coalesce("reason", F.lit("valid")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def stream_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Token counts by lemma and tag, over the lines as a stream of files joined with the static table of files."""
    schema = table(spark, sf, "corpus_lines").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8)
    name = "corpus_lines.parquet"  # a folder of files, or one file beside the other tables
    lines = reader.option("pathGlobFilter", name).parquet(sf) if is_file(spark, f"{sf}/{name}") else reader.parquet(f"{sf}/{name}")
    valid = malformed.tokens(lines, table(spark, sf, "corpus_files"))
    counts = valid.groupBy(F.lower("lemma").alias("lemma"), "upos").agg(F.count(F.lit(1)).alias("freq"))
    folder = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    run_to_folder(counts, f"{folder}/counts", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/counts")


QUERIES = [p1_found, p1_tokens, p1_reasons, stream_token_counts]

#: The rules of the line format in SQL; `pieces` are what lies between the double quotes, those at odd (1-based) places outside.
LINES_SQL = r"""source AS (SELECT * FROM corpus_lines),
  raw AS (SELECT line_id, file_name, line_no, trim(line, ' ' || chr(9) || chr(10) || chr(13)) AS raw, CASE WHEN delim = 'tab' THEN chr(9) ELSE ' ' END AS d
    FROM source LEFT JOIN (SELECT file_name, max(delim) AS delim FROM corpus_files GROUP BY 1) USING (file_name)),
  cut AS (SELECT *, string_split(raw, '"') AS pieces FROM raw WHERE raw <> ''),
  quotes AS (SELECT *, len(pieces) AS n, list_transform(pieces, lambda x, i: i % 2 = 0 OR (x = '' ) OR ((i = 1 OR starts_with(x, d)) AND (i = len(pieces) OR ends_with(x, d)))) AS ok,
      list_sum(list_transform(pieces, lambda x, i: CASE WHEN i % 2 = 1 THEN length(x) - length(replace(x, d, '')) ELSE 0 END)) + 1 AS n_fields FROM cut),
  marked AS (SELECT *, n % 2 = 1 AND NOT list_contains(ok, false) AS sound,
      string_split(array_to_string(list_transform(pieces, lambda x, i: CASE WHEN i % 2 = 1 AND x = '' AND i > 1 AND i < n THEN chr(1114109) WHEN i % 2 = 1 THEN replace(x, d, chr(1114108)) ELSE x END), ''), chr(1114108)) AS raw_fields FROM quotes),
  fields AS (SELECT *, list_transform(raw_fields, lambda x: replace(x, chr(1114109), '"')) AS f FROM marked),
  rels AS (SELECT *, f[1] AS id, string_split(f[6], ',') AS r FROM fields),
  judged AS (SELECT *, CASE
      WHEN NOT sound THEN 'quoting'
      WHEN n_fields <> 6 THEN 'columns'
      WHEN NOT (regexp_full_match(id, '[0-9]+') AND regexp_matches(id, '[1-9]')) THEN 'token_id'
      WHEN f[3] = '' OR regexp_matches(f[3], '[\x00-\x20@\x{FFFD}\x7F]') THEN 'lemma'
      WHEN len(list_filter(r, lambda x: NOT contains(x, '=') OR NOT regexp_full_match(x, '(?s)[A-Za-z][A-Za-z0-9:_-]*=[^=]*'))) > 0 THEN 'deprel'
      WHEN len(list_filter(r, lambda x: NOT regexp_matches(x, '(?s)=[0-9]+\z') OR ltrim(string_split(x, '=')[-1], '0') = ltrim(id, '0'))) > 0 THEN 'head' END AS reason FROM rels)"""

ORACLE = {
    "p1_found": f"WITH {LINES_SQL} SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
    "p1_tokens": f"WITH {LINES_SQL} SELECT line_id, TRY_CAST(id AS BIGINT) AS token_id, f[2] AS text, f[3] AS lemma, f[4] AS upos, f[5] AS ne, f[6] AS deprels FROM judged WHERE reason IS NULL",
    "stream_token_counts": f"WITH {LINES_SQL} SELECT lower(f[3]) AS lemma, f[4] AS upos, CAST(count(*) AS BIGINT) AS freq FROM judged WHERE reason IS NULL GROUP BY ALL",
    "p1_reasons": f"WITH {LINES_SQL} SELECT file_name, coalesce(reason, 'valid') AS outcome, CAST(count(*) AS BIGINT) AS n FROM judged GROUP BY ALL",
}
