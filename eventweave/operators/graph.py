"""The event graph: word nodes, event nodes and `args` edges as plain tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventweave.functions.text import ALL_BLANKS, event_key, role_key, strip, word_key
from eventweave.operators.counting import arity
from eventweave.operators.latest import latest_rows
from eventweave.operators.ordering import number_rows


@dataclass(frozen=True)
class Graph:
    """words (word_id, form, pos, freq, prob); events (event_id, form, freq, prob, deg); args (event_id, word_id, role, freq, prob, pmi, degree): an edge from
    event to word, `role` null for the head; asso (word_id, word_id2, weight) may be missing."""

    words: DataFrame
    events: DataFrame
    args: DataFrame
    asso: DataFrame | None = None


def word_nodes(lemmas: DataFrame) -> DataFrame:
    """(word_id, form, pos, freq, prob): ids from 1 by form and pos; prob is the share of all frequencies."""
    total = lemmas.agg(F.sum("freq").alias("__total"))
    rows = lemmas.groupBy("lemma", "pos").agg(F.sum("freq").cast("bigint").alias("freq"))
    rows = number_rows(rows, [F.col("lemma").asc(), F.col("pos").asc()], "word_id").crossJoin(F.broadcast(total))  # one row
    return rows.select("word_id", F.col("lemma").alias("form"), "pos", "freq", F.try_divide(F.col("freq").cast("double"), F.col("__total").cast("double")).alias("prob"))


def event_probs(events: DataFrame, event: str = "event") -> DataFrame:
    """`events` with `deg`, the number of members, and `prob`, the share of the frequency of all events with as many.

    There are few numbers of members, so their totals are summed and joined instead of moving all events of one number to one task.
    """
    rows = events.withColumn("deg", arity(F.col(event)))
    totals = rows.groupBy("deg").agg(F.sum("freq").alias("__total"))
    return rows.join(F.broadcast(totals), "deg").withColumn("prob", F.try_divide(F.col("freq").cast("double"), F.col("__total").cast("double"))).drop("__total")  # at most GROUP_LIMIT rows


def event_nodes(events: DataFrame) -> DataFrame:
    """(event_id, form, freq, prob, deg): ids from 1 by form; members joined by commas."""
    rows = events.select(F.replace("event", F.lit(" "), F.lit(",")).alias("form"), "freq").groupBy("form").agg(F.sum("freq").cast("bigint").alias("freq"))
    return event_probs(number_rows(rows, [F.col("form").asc()], "event_id"), "form").select("event_id", "form", "freq", "prob", "deg")


def member_edges(events: DataFrame) -> DataFrame:
    """(event_id, freq, degree, form, pos, role) of every member of every event node, made from the node's own row; role null for HEAD."""
    rows = events.select("event_id", "freq", F.col("deg").alias("degree"), F.explode(F.split("form", ",")).alias("member"))
    parts = F.split("member", "@")
    at = lambda i: F.get(parts, F.lit(i))
    return rows.select("event_id", "freq", "degree", at(0).alias("form"), at(1).alias("pos"), F.when(at(2) != "HEAD", at(2)).alias("role"))


def build_graph(lemmas: DataFrame, events: DataFrame, weights: str = "zero", null_head: bool = True) -> Graph:
    """The graph of two frequency tables (lemma, pos, freq) and (event, freq).

    Edges to words that aren't in the lemma table are left out; see `orphans`. weights: `zero` leaves edge prob and pmi at 0; `pmi` fills them, see
    `weigh`. null_head: the head's role is null, else `HEAD`.
    """
    words, nodes = word_nodes(lemmas), event_nodes(events)
    args = member_edges(nodes).join(words.select("word_id", "form", "pos"), ["form", "pos"])
    args = args.select("event_id", "word_id", "role", "freq", F.lit(0.0).alias("prob"), F.lit(0.0).alias("pmi"), "degree")
    if not null_head:
        args = args.withColumn("role", F.coalesce("role", F.lit("HEAD")))
    graph = Graph(words, nodes, args)
    return weigh(graph) if weights == "pmi" else graph


def orphans(lemmas: DataFrame, events: DataFrame) -> DataFrame:
    """(form, pos, edges): members of events without a row in the lemma table."""
    missing = member_edges(event_nodes(events)).join(lemmas.select(F.col("lemma").alias("form"), "pos"), ["form", "pos"], "left_anti")
    return missing.groupBy("form", "pos").agg(F.count(F.lit(1)).alias("edges"))


def weigh(graph: Graph) -> Graph:
    """Edge weights: prob is the event's; pmi = log2(P(event) / product of P(word) over its members), equal for all edges of an event.

    P(event) is its share among events with as many members. Use sum(pmi * freq) for local mutual information.
    """
    args = graph.args.drop("prob", "pmi").join(graph.words.select("word_id", F.col("prob").alias("__word")), "word_id")
    args = args.join(graph.events.select("event_id", "prob"), "event_id")
    log = F.sum(F.log2("__word")).over(W.partitionBy("event_id"))
    args = args.withColumn("pmi", F.log2("prob") - log)
    return Graph(graph.words, graph.events, args.select("event_id", "word_id", "role", "freq", "prob", "pmi", "degree"), graph.asso)


def import_graph(words: DataFrame, events: DataFrame, args: DataFrame, asso: DataFrame | None = None) -> Graph:
    """The graph of imported tables: one row per node id, only edges with both ends. Of nodes with one id the least row counts."""
    one = lambda df, key: df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*[c for c in df.columns if c != key])).alias("r")).select(key, "r.*")
    words, events = one(words, "word_id"), one(events, "event_id")
    args = args.join(words.select("word_id"), "word_id", "left_semi").join(events.select("event_id"), "event_id", "left_semi")
    if asso is not None:
        asso = asso.join(words.select("word_id"), "word_id", "left_semi").join(words.select(F.col("word_id").alias("word_id2")), "word_id2", "left_semi")
    return Graph(words, events, args, asso)


def delivered_graph(words: DataFrame, events: DataFrame, edges: DataFrame) -> Graph:
    """The graph of delivered node and edge rows with repeats and corrections.

    Words: form in lower case, tag by its first letter, `freq` summed over slices, of each of which the latest row counts. Events: the sorted members; of
    one id the greatest frequency. Edges: the latest row of each (event_id, word_id, role); role null for the head; pmi null where it isn't finite.
    """
    w = latest_rows(words.filter(F.col("wordid").isNotNull()).select("wordid", "slice_id", "form", "pos", "freq", "loaded_at"), ["wordid", "slice_id"], "loaded_at")
    w = w.groupBy(F.col("wordid").alias("word_id")).agg(F.max(word_key(F.col("form"))).alias("form"), F.max(F.left(strip(F.col("pos"), ALL_BLANKS), F.lit(1))).alias("pos"), F.sum(F.coalesce("freq", F.lit(0))).cast("bigint").alias("freq"))
    e = events.filter(F.col("eventid").isNotNull()).select(F.col("eventid").alias("event_id"), event_key(F.col("form")).alias("form"), "freq", "slice_id").filter(F.col("form").isNotNull())
    e = e.groupBy("event_id").agg(F.max("form").alias("form"), F.max(F.coalesce("freq", F.lit(0))).cast("bigint").alias("freq"))
    e = e.withColumn("deg", arity(F.col("form")))
    a = edges.filter(F.col("word_id").isNotNull() & F.col("event_id").isNotNull()).withColumn("role", role_key(F.col("role")))
    a = latest_rows(a.select("event_id", "word_id", "role", "slice_id", "pmi", "freq", "loaded_at"), ["event_id", "word_id", "role"], "loaded_at", ["pmi", "freq", "slice_id"])
    finite = ~F.isnan("pmi") & (F.abs("pmi") < float("inf"))
    a = a.select("event_id", "word_id", F.when(F.col("role") != "head", F.col("role")).alias("role"), F.coalesce(F.col("freq"), F.lit(0)).cast("bigint").alias("freq"), F.when(finite, F.col("pmi")).alias("pmi"))
    return Graph(w, e, a)


def rows_named(words: DataFrame, form: str) -> DataFrame:
    """The delivered rows of all words that have this form in any of their rows: all that can come out with it."""
    return words.join(words.filter(word_key(F.col("form")) == form).select("wordid").distinct(), "wordid", "left_semi")


def delivered_neighbourhood(words: DataFrame, events: DataFrame, edges: DataFrame, form: str, pos: str | None = None) -> Graph:
    """The part of the delivered graph that paths of two hops from a word can reach: its edges, all edges of its events, and their words and events.

    The word's ids are found first; edges and nodes are filtered by ids that are part of the keys of their repeats, so only rows that come out are sorted.
    """
    nothing = events.limit(0), edges.limit(0)
    own = delivered_graph(rows_named(words, form), *nothing).words.filter(F.col("form") == form)
    own = own if pos is None else own.filter(F.col("pos") == pos)
    near = edges.join(own.select("word_id"), "word_id", "left_semi").filter(F.col("event_id").isNotNull()).select("event_id").distinct()
    around = edges.join(near, "event_id", "left_semi")
    far = around.select(F.col("word_id").alias("wordid")).distinct()
    return delivered_graph(words.join(far, "wordid", "left_semi"), events.join(near.withColumnRenamed("event_id", "eventid"), "eventid", "left_semi"), around)


def relation_list(args: DataFrame) -> DataFrame:
    """(role): the distinct roles of edges, without null."""
    return args.filter(F.col("role").isNotNull()).select("role").distinct()
