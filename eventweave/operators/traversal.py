"""Paths in the event graph. `args` edges lead from events to words; a path never uses an edge twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventweave.operators.graph import Graph


def edges(graph: Graph) -> DataFrame:
    """Every edge with both ends: (event_id, event, word_id, form, pos, role, pmi, freq)."""
    a = graph.args.select("event_id", "word_id", "role", "pmi", "freq")
    return a.join(graph.events.select("event_id", F.col("form").alias("event")), "event_id").join(graph.words.select("word_id", "form", "pos"), "word_id")


def words_with(graph: Graph, form: str | None = None, pos: str | None = None) -> DataFrame:
    """Word nodes by form and tag."""
    out = graph.words
    if form is not None:
        out = out.filter(F.col("form") == form)
    if pos is not None:
        out = out.filter(F.col("pos") == pos)
    return out


def events_of(graph: Graph, words: DataFrame) -> DataFrame:
    """(word_id, role, event_id, form): the events of the given words, one hop."""
    a = graph.args.select("event_id", "word_id", "role").join(words.select("word_id"), "word_id", "left_semi")
    return a.join(graph.events.select("event_id", "form"), "event_id").select("word_id", "role", "event_id", "form")


def two_hops(start: DataFrame, args: DataFrame, keep: list[str], where: Column | None = None) -> DataFrame:
    """(*keep, event_id, role, pmi, word_id, role2, pmi2, freq2): from edges `start` (event_id, word_id, role, pmi and `keep`) to the other edges of their events.

    Both sides are joined on the event, which has few edges, so hub words make as many rows as they have paths and no more.
    """
    far = args.select(F.col("event_id").alias("__event"), F.col("word_id").alias("word_id2"), F.col("role").alias("role2"), F.col("pmi").alias("pmi2"), F.col("freq").alias("freq2"))
    same = (F.col("word_id") == F.col("word_id2")) & F.col("role").eqNullSafe(F.col("role2"))
    out = start.join(far, (F.col("event_id") == F.col("__event")) & ~same)
    if where is not None:
        out = out.filter(where)
    return out.select(*keep, "event_id", "role", "pmi", F.col("word_id2").alias("word_id"), "role2", "pmi2", "freq2")


def participants(graph: Graph, words: DataFrame, role: str | None = None) -> DataFrame:
    """(word, event, role, pmi, role2, form): who else takes part in the events of the given words; with `role`, only events in which they have that role."""
    a = graph.args.join(words.select("word_id", F.col("form").alias("word")), "word_id")
    if role is not None:
        a = a.filter(F.col("role") == role)
    far = two_hops(a.select("event_id", "word_id", "role", "pmi", "word"), graph.args, ["word"])
    far = far.join(graph.words.select("word_id", "form"), "word_id").join(graph.events.select("event_id", F.col("form").alias("event")), "event_id")
    return far.select("word", "event_id", "event", "role", "pmi", "role2", "form")
