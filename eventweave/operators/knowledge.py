"""Generalized event knowledge: for a word in a relation, the words that fill another relation of its events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventweave.functions.labels import STOP_NODES
from eventweave.operators.graph import Graph
from eventweave.operators.traversal import two_hops




def weight_to_extract(name: str) -> Column:
    """`pmi`: sum of the far edges' pmi; `lmi`: of pmi times frequency."""
    options = {"pmi": lambda: F.sum("pmi2"), "lmi": lambda: F.sum(F.col("pmi2") * F.col("freq2"))}
    return F.coalesce(options[name](), F.lit(0.0))


def relation_roles(relations: dict[str, list[str]], df: DataFrame) -> DataFrame:
    """(rel, role): the graph roles of each relation; `None` is the null role."""
    rows = [(rel, None if r == "None" else r) for rel, roles in sorted(relations.items()) for r in dict.fromkeys(roles)]
    return df.sparkSession.createDataFrame(rows, "rel string, role string")


def check_relations(wanted: DataFrame, relations: dict[str, list[str]]) -> None:
    """Fails with the list of relations that the map doesn't have."""
    missing = sorted(r[0] for r in wanted.select("rel").distinct().collect() if r[0] not in relations)  # relations are few
    if missing:
        raise ValueError(f"relations without graph roles: {', '.join(missing)}")


def requests_of(items: DataFrame) -> DataFrame:
    """(form, pos, rel, box): distinct lookups of items (elements, relations): each word in its relation, for every other relation of the item."""
    e = items.select(F.explode("elements").alias("e"), "relations").select("e.form", "e.pos", "e.rel", F.explode("relations").alias("box"))
    return e.filter(F.col("rel") != F.col("box")).distinct()


def lookups(graph: Graph, requests: DataFrame, relations: dict[str, list[str]], n: int = 50, weight: str = "pmi", stop: tuple[str, ...] = STOP_NODES) -> tuple[DataFrame, DataFrame]:
    """`knowledge` with a number for the word of a request: ((node, form, pos), (node, rel, box, rank, label, label_pos, role, role2, w)).

    The number is the least id of the words with that form and tag. What is moved is ids, roles and weights; labels join when paths are summed by the id of
    the far word. Edges of other roles are left out before repeats are resolved, in partitions by event, where the far edges stay for the hop.
    """
    roles = F.broadcast(relation_roles(relations, requests))  # the relation map, one row per relation and role
    key = lambda c: F.coalesce(c, F.lit("\x00"))  # noqa: E731 — null roles join as a value
    wanted = requests.filter(F.col("rel") != F.col("box")).groupBy("form", "pos", "rel").agg(F.collect_set("box").alias("boxes"))  # relations are few
    asked = graph.words.select("word_id", "form", "pos").withColumn("node", F.min("word_id").over(W.partitionBy("form", "pos"))).join(wanted, ["form", "pos"])
    known = sorted({"\x00" if r == "None" else r for of in relations.values() for r in of})
    args = graph.args.filter(key(F.col("role")).isin(*known))
    near = args.select("event_id", "word_id", "role", F.lit(None).cast("double").alias("pmi"))
    near = near.withColumn("__in", key(F.col("role"))).join(roles.select("rel", key(F.col("role")).alias("__in")), "__in").drop("__in")
    near = near.join(asked.select("word_id", "rel", "node", "boxes"), ["word_id", "rel"])
    far = two_hops(near, args, ["node", "rel", "boxes"])
    far = far.withColumn("__out", key(F.col("role2"))).join(roles.select(F.col("rel").alias("box"), key(F.col("role")).alias("__out")), "__out").filter(F.array_contains("boxes", F.col("box")))
    m = graph.words.filter(~F.col("form").isin(*stop)).select("word_id", F.col("form").alias("label"), F.col("pos").alias("label_pos"))
    request = ["node", "rel", "box"]
    sums = far.groupBy(*request, "role", "role2", "word_id").agg(weight_to_extract(weight).alias("w"))
    sums = sums.join(m, "word_id").groupBy(*request, "role", "role2", "label", "label_pos").agg(F.sum("w").alias("w"))
    order = [F.col("w").desc(), F.col("label").asc(), F.col("label_pos").asc(), F.col("role").asc_nulls_first(), F.col("role2").asc_nulls_first()]
    ranked = sums.withColumn("rank", F.row_number().over(W.partitionBy(*request).orderBy(*order))).filter(F.col("rank") <= n)
    return asked.select("node", "form", "pos").distinct(), ranked.select(*request, "rank", "label", "label_pos", "role", "role2", "w")


def knowledge(graph: Graph, requests: DataFrame, relations: dict[str, list[str]], n: int = 50, weight: str = "pmi", stop: tuple[str, ...] = STOP_NODES) -> DataFrame:
    """(form, pos, rel, box, rank, label, label_pos, role, role2, w): the `n` best rows of every request (form, pos, rel, box), all answered at once.

    Paths word - event - other word whose near edge has a role of `rel` and far edge one of `box`, without the stop nodes; weights summed by word and pair of
    roles, so a word may come several times. Order: weight, then label, tag and roles (null first). Relations that aren't in the map fail.

    Edges are filtered by the requested words and roles before the hop; the map is one row per relation and role.
    """
    names, ranked = lookups(graph, requests, relations, n, weight, stop)
    return ranked.join(names, "node").select("form", "pos", "rel", "box", "rank", "label", "label_pos", "role", "role2", "w")


def in_vocabulary(found: DataFrame, vectors: DataFrame, with_pos: bool = False) -> DataFrame:
    """Rows whose label has a vector, with it: applied after the cut to n rows, so requests may keep fewer. `with_pos`: vectors are keyed `form/pos`."""
    label = F.concat_ws("/", "label", "label_pos") if with_pos else F.col("label")
    v = vectors.select(F.col("form").alias("__form"), "vec")
    return found.withColumn("__form", label).join(v, "__form").drop("__form")


def with_same_relations(found: DataFrame, words: DataFrame) -> DataFrame:
    """`found` and for each asked word (form, pos, rel) the word itself as the only one of its own relation, with weight 1."""
    own = words.select("form", "pos", "rel").distinct().select("form", "pos", "rel", F.col("rel").alias("box"), F.lit(1).alias("rank"), F.col("form").alias("label"), F.col("pos").alias("label_pos"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("role2"), F.lit(1.0).alias("w"))
    return found.unionByName(own)
