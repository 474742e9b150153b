"""How often and in how many records every term occurs: last-seen counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventweave.functions.text import ALL_BLANKS, strip, word_key
from eventweave.operators.latest import latest_rows


def last_seen(tokens: DataFrame, term: list[str], record: str) -> DataFrame:
    """`tokens` with `__new`: 1 where the record differs from the last one seen of its term, else 0. Tokens are hash-partitioned by term and sorted by record; null records are one."""
    seen = W.partitionBy(*term).orderBy(F.col(record).asc_nulls_first())
    changed = (F.row_number().over(seen) == 1) | ~F.col(record).eqNullSafe(F.lag(record).over(seen))
    return tokens.withColumn("__new", changed.cast("bigint"))


def term_counts(df: DataFrame, term: list[str], record: str, weight: Column, salts: int = 16) -> DataFrame:
    """Occurrences and records of every term: (*term, occurrences, records).

    Tokens are hash-partitioned by term and a salt of the record, sorted by record, and each term keeps three numbers: occurrences, records and the record
    last seen; the second goes up when the third changes. No set of records is held and no (term, record) pairs are grouped. Salts divide the records, so
    their counters add up; a term with a third of all tokens is spread over `salts` tasks. The tokens are moved once, then one row of counters a term and salt.
    Null terms are a term, null records one record; null weights add nothing to the occurrences.
    """
    salt = F.pmod(F.xxhash64(record), F.lit(salts)).cast("int")
    tokens = df.select(*term, F.col(record).alias("__record"), salt.alias("__salt"), F.coalesce(weight.cast("bigint"), F.lit(0)).alias("__weight"))
    counted = last_seen(tokens, [*term, "__salt"], "__record").groupBy(*term, "__salt").agg(F.sum("__weight").alias("__o"), F.sum("__new").alias("__r"))
    return counted.groupBy(*term).agg(F.sum("__o").alias("occurrences"), F.sum("__r").alias("records"))


def word_marks(words: DataFrame, rare: int = 2, common: tuple[int, int] = (9, 10)) -> DataFrame:
    """Every word (form in lower case, first letter of its tag): (form, pos, freq, slices, mark).

    mark: `rare` for a total of at most `rare`, else `common` for words in at least common[0]/common[1] of the slices of the table, else null. Of the rows
    of one word id and slice the latest counts. A word without form keeps a null form.
    """
    n = words.select("slice_id").distinct().agg(F.count("slice_id")).first()[0]
    rows = latest_rows(words.select("wordid", "slice_id", "form", "pos", "freq", "loaded_at"), ["wordid", "slice_id"], "loaded_at")
    rows = rows.select(word_key(F.col("form")).alias("form"), F.left(strip(F.col("pos"), ALL_BLANKS), F.lit(1)).alias("pos"), "slice_id", "freq")
    out = term_counts(rows, ["form", "pos"], "slice_id", F.col("freq"))
    is_common = F.col("records") * common[1] >= F.lit(n * common[0])
    mark = F.when(F.col("occurrences") <= rare, "rare").when(is_common, "common")
    return out.select("form", "pos", F.col("occurrences").alias("freq"), F.col("records").alias("slices"), mark.alias("mark"))
