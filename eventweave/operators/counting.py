"""Frequency tables of lemmas and event patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventweave.functions.sets import explode_subsets

#: Groups of this many members or more are dropped before subsets are made.
GROUP_LIMIT = 16


def above(df: DataFrame, threshold: float | None, freq: str = "freq") -> DataFrame:
    """Rows with a frequency strictly above the threshold; all without one."""
    return df if threshold is None else df.filter(F.col(freq) > threshold)


def lemma_freqs(built: DataFrame, threshold: float | None = None) -> DataFrame:
    """(lemma, pos, freq) over all words of all sentences, each token id once a sentence."""
    rows = built.select(F.explode("words").alias("w")).select(F.col("w.lemma").alias("lemma"), F.col("w.upos").alias("pos"))
    return above(rows.groupBy("lemma", "pos").agg(F.count(F.lit(1)).alias("freq")), threshold)


def event_patterns(groups: DataFrame, limit: int = GROUP_LIMIT) -> DataFrame:
    """One row per subset of two or more members of each group with fewer than `limit` members: `event` (array).

    Equal groups are counted first (`weight`), so a frequent one is expanded once.
    """
    small = groups.filter(F.size("members") < limit).groupBy("members").agg(F.count(F.lit(1)).alias("weight"))
    return explode_subsets(small, "members", "event").select("event", "weight")


def event_freqs(groups: DataFrame, threshold: float | None = None, limit: int = GROUP_LIMIT) -> DataFrame:
    """(event, freq): event is the members joined by blanks."""
    counted = event_patterns(groups, limit).groupBy(F.array_join("event", " ").alias("event")).agg(F.sum("weight").alias("freq"))
    return above(counted, threshold)


def merge_freqs(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Partial frequency tables added up."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*keys).agg(F.sum("freq").cast("bigint").alias("freq"))


def total_freq(df: DataFrame) -> DataFrame:
    """One row (total): the sum of all frequencies, 0 for none."""
    return df.agg(F.coalesce(F.sum("freq"), F.lit(0)).cast("bigint").alias("total"))


def arity(event: Column) -> Column:
    """Number of members of an event in blanks or commas."""
    return F.size(F.split(event, "[ ,]"))


def arity_freqs(events: DataFrame) -> DataFrame:
    """(deg, total): frequency of all events of each number of members."""
    return events.groupBy(arity(F.col("event")).alias("deg")).agg(F.sum("freq").cast("bigint").alias("total"))


def token_cube(sentences: DataFrame) -> DataFrame:
    """Token counts by (lemma, pos, rel, ne), (lemma, pos), (pos, rel), (ne), (rel) and (pos) in one pass; `grouping` tells which. ne: the entity tag a token stands for, else O.

    Columns outside a grouping are null.
    """
    from eventweave.functions.labels import STOP_NODES, standard_pos, standard_role

    t = sentences.select(F.explode("tokens").alias("t"))
    t = t.select(F.col("t.lemma").alias("lemma"), standard_pos(F.col("t.upos")).alias("pos"), standard_role(F.col("t.deprel")).alias("rel"), F.when(F.col("t.lemma").isin(*STOP_NODES), F.col("t.lemma")).otherwise("O").alias("ne"))
    c = {x: F.col(x) for x in ("lemma", "pos", "rel", "ne")}
    sets = [[c["lemma"], c["pos"], c["rel"], c["ne"]], [c["lemma"], c["pos"]], [c["pos"], c["rel"]], [c["ne"]], [c["rel"]], [c["pos"]]]
    return t.groupingSets(sets, *c.values()).agg(F.grouping_id().cast("int").alias("grouping"), F.count(F.lit(1)).alias("freq"))
