"""Sentence representations: linguistic conditions (LC) and active context (AC) of items."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventweave.functions.labels import STOP_NODES
from eventweave.functions.vectors import REPRESENTATIONS, WEIGHTS, let, mean
from eventweave.operators.folding import Fold, vectors_of
from eventweave.operators.graph import Graph
from eventweave.operators.knowledge import check_relations, in_vocabulary, knowledge, lookups, requests_of
from eventweave.session import materialize

ELEMENT = "struct<label:string,vec:array<double>,w:double>"
SENTENCE = "SENTENCE"
#: Bytes of vectors that every task may hold.
HELD = 64 << 20


@dataclass(frozen=True)
class Settings:
    """n rows of a lookup, heads of m for centroids, which of the two rankings run, and the functions by name."""

    n: int = 50
    m: int = 20
    rank_forward: bool = True
    rank_backward: bool = True
    include_same: bool = False
    weight: str = "pmi"
    ranking: str = "cosine"
    representation: str = "centroid"
    with_pos: bool = False
    stop: tuple[str, ...] = STOP_NODES


@dataclass(frozen=True)
class Space:
    """Vectors that forms share: forms (form, vec_id), one row a form, and vectors (vec_id, vec). With `with_pos` forms are keyed `form/pos`."""

    forms: DataFrame
    vectors: DataFrame

    def joined(self) -> DataFrame:
        return self.forms.join(self.vectors, "vec_id").select("form", "vec")


def _step(s: Settings) -> Callable[[Column, Column], Column]:
    """One step of the context: the new list is ranked by the centroid of the context (forward), the lists of the context by that of the new list (backward), and the
    new list is appended unless it is empty. A centroid that isn't there ranks nothing."""
    rank, center = WEIGHTS[s.ranking], REPRESENTATIONS[s.representation]

    def step(acc: Column, g: Column) -> Column:
        forward = let(center(acc, s.m), lambda hc: F.when(hc.isNotNull(), rank(g, hc)).otherwise(g)) if s.rank_forward else g

        def backward(new: Column) -> Column:
            if not s.rank_backward:
                return F.when(F.size(new) > 0, F.concat(acc, F.array(new))).otherwise(acc)
            old = let(center(F.array(new), s.m), lambda hg: F.when(hg.isNotNull(), F.transform(acc, lambda old: rank(old, hg))).otherwise(acc))
            return F.when(F.size(new) > 0, F.concat(old, F.array(new))).otherwise(old)

        return let(forward, backward).cast(f"array<array<{ELEMENT}>>")

    return step


def fold_context(steps: Column, s: Settings = Settings()) -> Column:
    """The active context after all steps: an array of lists, from an array of lists (one a step, in word order) of structs (label, vec, w)."""
    return F.aggregate(steps, F.array().cast(f"array<array<{ELEMENT}>>"), _step(s))


def _vocabulary(df: DataFrame, vectors: DataFrame, with_pos: bool) -> DataFrame:
    key = F.concat_ws("/", "form", "pos") if with_pos else F.col("form")
    return df.withColumn("__key", key).join(vectors.select(F.col("form").alias("__key"), "vec"), "__key").drop("__key")


def known_words(items: DataFrame, vectors: DataFrame, with_pos: bool = False) -> DataFrame:
    """(item_id, step, form, pos, rel, vec) of the words of items that have a vector; others take no step."""
    e = items.select("item_id", F.posexplode("elements").alias("step", "e")).select("item_id", "step", "e.form", "e.pos", "e.rel")
    return _vocabulary(e, vectors, with_pos)


def linguistic_conditions(words: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, lc): the vector of the first word in the target relation, or for SENTENCE the mean of the first of each relation; null without any."""
    first = words.groupBy("item_id", "rel").agg(F.min_by("vec", "step").alias("vec"))
    whole = first.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("rel", "vec"))).alias("lc_all"))  # one entry a relation
    out = items.select("item_id", "target").join(whole, "item_id", "left")
    of_target = F.get(F.filter("lc_all", lambda x: x["rel"] == F.col("target")), F.lit(0))["vec"]
    return out.select("item_id", F.when(F.col("target") == SENTENCE, mean(F.transform("lc_all", lambda x: x["vec"]))).otherwise(of_target).alias("lc"))


def context_steps(items: DataFrame, words: DataFrame, found: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(item_id, box, steps): for every relation of an item the lists of its known words in order; a word without knowledge gives an empty list."""
    request = ["form", "pos", "rel", "box"]
    element = F.struct("rank", F.struct(F.col("label"), F.col("vec"), F.col("w").cast("double").alias("w")).alias("e"))
    lists = found.groupBy(*request).agg(F.transform(F.array_sort(F.collect_list(element)), lambda x: x["e"]).alias("list"))  # at most n a request
    rows = words.join(items.select("item_id", F.explode("relations").alias("box")), "item_id").join(lists, request, "left")
    empty = F.array().cast(f"array<{ELEMENT}>")
    own = F.array(F.struct(F.col("form").alias("label"), "vec", F.lit(1.0).alias("w"))).cast(f"array<{ELEMENT}>") if s.include_same else empty
    rows = rows.withColumn("list", F.when(F.col("rel") == F.col("box"), own).otherwise(F.coalesce(F.col("list").cast(f"array<{ELEMENT}>"), empty)))
    return rows.groupBy("item_id", "box").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "list"))), lambda x: x["list"]).alias("steps"))


def active_context(items: DataFrame, steps: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(item_id, ac): the representation of the target relation's context, or for SENTENCE the mean over relations that have one; null without any.

    The relations of an item don't depend on each other: each is folded by itself, in parallel.
    """
    center = REPRESENTATIONS[s.representation]
    folded = steps.select("item_id", "box", center(fold_context(F.col("steps"), s), s.m).alias("vec"))
    whole = folded.filter(F.col("vec").isNotNull()).groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("box", "vec"))).alias("all"))
    out = items.select("item_id", "target").join(whole, "item_id", "left")
    of_target = F.get(F.filter("all", lambda x: x["box"] == F.col("target")), F.lit(0))["vec"]
    return out.select("item_id", F.when(F.col("target") == SENTENCE, mean(F.transform("all", lambda x: x["vec"]))).otherwise(of_target).alias("ac"))


def trace(steps: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(item_id, box, step, labels): the labels of the active context after each step, lists joined by ` || `. The context is folded once."""
    kind = f"struct<acc:array<array<{ELEMENT}>>,seen:array<string>>"
    labels = lambda acc: F.array_join(F.transform(acc, lambda g: F.array_join(F.transform(g, lambda e: e["label"]), ", ")), " || ")
    one = _step(s)
    add = lambda state, g: let(one(state["acc"], g), lambda acc: F.struct(acc.alias("acc"), F.concat(state["seen"], F.array(labels(acc))).alias("seen"))).cast(kind)
    seen = F.aggregate("steps", F.struct(F.array().alias("acc"), F.array().alias("seen")).cast(kind), add, lambda state: state["seen"])
    return steps.select("item_id", "box", F.posexplode(seen).alias("step", "labels")).withColumn("step", F.col("step") + 1)


def steps_of(items: DataFrame, graph: Graph, vectors: DataFrame, relations: dict[str, list[str]], s: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(known words, context steps) of items (item_id, item, target, elements, relations). All lookups of all items are one join."""
    check_relations(items.select(F.explode("relations").alias("rel")), relations)
    words = known_words(items, vectors, s.with_pos)
    asked = requests_of(items).join(words.select("form", "pos").distinct(), ["form", "pos"], "left_semi")
    found = in_vocabulary(knowledge(graph, asked, relations, s.n, s.weight, s.stop), vectors, s.with_pos)
    return words, context_steps(items, words, found, s)


def _shared(space: Space, s: Settings) -> tuple[Fold, DataFrame] | None:
    """What tasks hold to fold with a table of vectors, and (form, id) with its row numbers. None if the vectors are too large to be held or of several lengths,
    or for functions other than the ones that `folding` has."""
    n, distinct, there, least, most = space.vectors.agg(F.count(F.lit(1)), F.count_distinct("vec_id"), F.count("vec"), F.min(F.size("vec")), F.max(F.size("vec"))).first()
    if not n or not n == distinct == there or not 0 < least == most or n * most * 8 > HELD or (s.ranking, s.representation) != ("cosine", "centroid") or s.m < 1:
        return None
    got = space.vectors.select("vec_id", "vec").toArrow().combine_chunks().sort_by("vec_id")
    flat = got.column("vec").combine_chunks().flatten()
    if flat.null_count:
        return None
    ids = space.vectors.sparkSession.createDataFrame([(x, i) for i, x in enumerate(got.column("vec_id").to_pylist())], "vec_id long, id int")
    return Fold(flat.to_numpy().reshape(n, most), s.m, s.rank_forward, s.rank_backward), space.forms.join(F.broadcast(ids), "vec_id").select("form", "id")  # as many as vectors


def known_rows(items: DataFrame, graph: Graph, forms: DataFrame, relations: dict[str, list[str]], s: Settings, keep: list[str]) -> DataFrame:
    """(*keep, word), a row for every word of items (*keep, target, elements, relations), also of items without any: null for words that aren't among `forms`
    (form, id), else a struct (step, rel, id, counts, lists): whether the word counts for the target, and for each relation that does the ids of what is known.

    Lookups are answered once for all items that have them, written as ids, and joined with the words.
    """
    check_relations(items.select(F.explode("relations").alias("rel")), relations)
    key = lambda form, pos: F.concat_ws("/", form, pos) if s.with_pos else F.col(form)
    forms = forms.select(F.col("form").alias("__key"), "id")
    words = items.select(F.explode("elements").alias("e")).select("e.form", "e.pos", "e.rel").distinct()
    words = words.withColumn("__key", key("form", "pos")).join(forms, "__key").drop("__key")
    asked = requests_of(items).join(words.select("form", "pos").distinct(), ["form", "pos"], "left_semi")
    names, ranked = lookups(graph, asked, relations, s.n, s.weight, s.stop)
    found = ranked.select("node", "rel", "box", "rank", key("label", "label_pos").alias("__key")).join(forms, "__key")
    lists = found.groupBy("node", "rel", "box").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("ids"))  # at most n
    lists = lists.groupBy("node", "rel").agg(F.collect_list(F.struct("box", "ids")).alias("lists"))  # one entry a relation
    words = materialize(words.join(lists.join(names, "node").select("form", "pos", "rel", "lists"), ["form", "pos", "rel"], "left"), "lists")

    rows = items.select(*keep, F.col("target").alias("__target"), F.col("relations").alias("__relations"), F.posexplode_outer("elements").alias("step", "e"))
    rows = rows.select(*keep, "__target", "__relations", "step", "e.form", "e.pos", "e.rel").join(words, ["form", "pos", "rel"], "left")
    counts = lambda rel: F.coalesce((F.col("__target") == SENTENCE) | (F.col("__target") == rel), F.lit(False))
    none = F.array().cast("array<struct<box:string,ids:array<int>>>")
    own = F.array(F.struct(F.col("rel").alias("box"), F.array("id").alias("ids"))) if s.include_same else none
    lists = F.filter(F.concat(F.coalesce("lists", none), own), lambda x: counts(x["box"]) & F.array_contains("__relations", x["box"]))
    return rows.select(*keep, F.when(F.col("id").isNotNull(), F.struct("step", "rel", "id", counts(F.col("rel")).alias("counts"), lists.alias("lists"))).alias("word"))


def represent(items: DataFrame, graph: Graph, vectors: DataFrame | Space, relations: dict[str, list[str]], s: Settings = Settings()) -> DataFrame:
    """(item_id, item, target, lc, ac) of items (item_id, item, target, elements, relations); `item` may be missing.

    With a `Space` whose vectors tasks can hold, items are moved with the numbers of vectors only, and no vector is moved at all.
    """
    out = [c for c in ("item", "target") if c in items.columns]
    if isinstance(vectors, Space):
        if shared := _shared(vectors, s):
            rows = known_rows(items, graph, shared[1], relations, s, ["item_id", *out]).repartition("item_id")
            rows = rows.groupBy("item_id").agg(*[F.first(c).alias(c) for c in out], F.array_sort(F.collect_list("word")).alias("words"))
            kinds = ", ".join(f"{c} {k}" for c, k in rows.dtypes if c != "words")
            return rows.mapInArrow(vectors_of(shared[0], {"words": ("lc", "ac")}), f"{kinds}, lc array<double>, ac array<double>")
        vectors = vectors.joined()
    words, steps = steps_of(items, graph, vectors, relations, s)
    lc = linguistic_conditions(words, items)
    return items.select("item_id", *out).join(lc, "item_id", "left").join(active_context(items, steps, s), "item_id", "left")


def represent_pairs(mapping: DataFrame, items: DataFrame, graph: Graph, vectors: DataFrame | Space, relations: dict[str, list[str]], s: Settings = Settings()) -> DataFrame:
    """(orig, ac1, ac2): the context vectors of both items of every pair (orig, row1, row2), where `orig` is distinct. Pairs with an item that isn't there are left out."""
    if isinstance(vectors, Space) and (shared := _shared(vectors, s)):
        sides = F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(f"row{i}").alias("item_id")) for i in (1, 2)]))
        both = materialize(mapping.select("orig", sides.alias("x")).select("orig", "x.*").join(items.select("item_id", "target", "elements", "relations"), "item_id"), "pairs")
        rows = known_rows(both, graph, shared[1], relations, s, ["orig", "side"]).repartition("orig")
        words = [F.array_sort(F.collect_list(F.when(F.col("side") == i, F.col("word")))).alias(f"words{i}") for i in (1, 2)]
        rows = rows.groupBy("orig").agg(F.min("side").alias("a"), F.max("side").alias("b"), *words).filter("a < b").drop("a", "b")
        return rows.mapInArrow(vectors_of(shared[0], {"words1": (None, "ac1"), "words2": (None, "ac2")}), f"orig {dict(rows.dtypes)['orig']}, ac1 array<double>, ac2 array<double>")
    v = represent(items, graph, vectors, relations, s).select("item_id", "ac")
    one, two = (v.select(F.col("item_id").alias(f"row{i}"), F.col("ac").alias(f"ac{i}")) for i in (1, 2))
    return mapping.join(one, "row1").join(two, "row2").select("orig", "ac1", "ac2")


def group_centroids(df: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    """(key, vec): the mean vector of each group, for groups of any size: dimensions are averaged one by one with partial sums."""
    per = df.select(key, F.posexplode(vec).alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("x"))
    return per.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("vec"))  # one entry a dimension
