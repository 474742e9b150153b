import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventweave.functions import vectors as v
from eventweave.functions.sets import explode_subsets, relations_of
from eventweave.operators import representation as r
from eventweave.operators.evaluate import filler_similarity, pair_similarity
from eventweave.operators.graph import Graph, import_graph
from eventweave.operators.knowledge import check_relations, in_vocabulary, knowledge, requests_of, with_same_relations
from eventweave.operators.ordering import average_ranks, number_rows, spearman, spearman_p
from eventweave.operators.prepare import pair_mapping, prepare_analogies, prepare_fit, prepare_pairs
from eventweave.plans import models

RELATIONS = {"SBJ": ["nsubj"], "OBJ": ["dobj"], "ROOT": ["None"]}


def fold(steps, m, forward, backward):
    """The context fold in numpy."""

    def center(lists):
        means = [np.mean([x[1] for x in g[:m]], axis=0) for g in lists if g]
        return np.mean(means, axis=0) if means else None

    def rank(g, head):
        score = [float(x[1] @ head / (np.linalg.norm(x[1]) * np.linalg.norm(head))) if np.linalg.norm(x[1]) * np.linalg.norm(head) else None for x in g]
        return [g[i] for i in sorted(range(len(g)), key=lambda i: (score[i] is None, -(score[i] or 0.0)))]

    acc = []
    for g in steps:
        hc = center(acc)
        if forward and hc is not None:
            g = rank(g, hc)
        hg = center([g])
        if backward and hg is not None:
            acc = [rank(x, hg) for x in acc]
        if g:
            acc = [*acc, g]
    return acc, center(acc)


@pytest.mark.parametrize("forward,backward", [(True, True), (False, False), (True, False), (False, True)])
def test_fold_against_numpy(spark, forward, backward):
    rnd = random.Random(3)
    items = []
    for i in range(25):
        steps = [[(f"w{rnd.randint(0, 9)}", [float(rnd.randint(-3, 3)) for _ in range(4)], 1.0) for _ in range(rnd.choice([0, 2, 5]))] for _ in range(rnd.randint(0, 3))]
        items.append((i, steps))
    df = spark.createDataFrame(items, f"i int, steps array<array<{r.ELEMENT}>>")
    s = r.Settings(m=3, rank_forward=forward, rank_backward=backward)
    out = df.withColumn("acc", r.fold_context(F.col("steps"), s)).withColumn("vec", v.centroid(F.col("acc"), 3)).collect()
    for row in out:
        acc, vec = fold([[(x[0], np.array(x[1])) for x in g] for g in items[row.i][1]], 3, forward, backward)
        assert [[e.label for e in g] for g in row.acc] == [[x[0] for x in g] for g in acc]
        assert (vec is None and row.vec is None) or np.allclose(vec, row.vec)


def test_hand_derived_fold(spark):
    x, y, z = ("x", [1.0, 0.0], 1.0), ("y", [0.0, 1.0], 1.0), ("z", [0.0, 2.0], 1.0)
    steps = spark.createDataFrame([(1, "OBJ", [[x, y], [z, x]])], f"item_id int, box string, steps array<array<{r.ELEMENT}>>")
    for on, state, vec in ((True, "x, y || x, z", [1.0, 0.0]), (False, "x, y || z, x", [0.5, 1.0])):
        s = r.Settings(m=1, rank_forward=on, rank_backward=on)
        assert r.trace(steps, s).filter("step = 2").first().labels == state
        items = spark.createDataFrame([(1, "OBJ"), (2, "OBJ")], "item_id int, target string")
        assert {k.item_id: k.ac for k in r.active_context(items, steps, s).collect()} == {1: vec, 2: None}


@pytest.fixture(scope="module")
def graph(spark):
    words = spark.createDataFrame([(1, "dog", "N", 1, 0.1), (2, "chase", "V", 1, 0.1), (3, "cat", "N", 1, 0.1), (4, "PERSON", "N", 1, 0.1), (5, "ball", "N", 1, 0.1)], "word_id long, form string, pos string, freq long, prob double")
    events = spark.createDataFrame([(1, "a", 1, 0.1, 3), (2, "b", 1, 0.1, 3), (3, "c", 1, 0.1, 2)], "event_id long, form string, freq long, prob double, deg int")
    args = spark.createDataFrame([(1, 1, "nsubj", 2, 1.0), (1, 2, None, 2, 0.5), (1, 3, "dobj", 2, 2.0), (2, 4, "nsubj", 1, 9.0), (2, 2, None, 1, None), (2, 5, "dobj", 1, 3.0), (3, 1, "nsubj", 1, 1.0), (3, 2, None, 1, 1.0)], "event_id long, word_id long, role string, freq long, pmi double")
    return Graph(words, events, args)


def items_of(spark, rows):
    df = spark.createDataFrame(rows, "item_id int, item string, target string, elements array<struct<form:string,pos:string,rel:string>>")
    return df.withColumn("relations", relations_of(F.col("elements"), F.col("target")))


def test_knowledge(spark, graph):
    asked = spark.createDataFrame([("chase", "V", "ROOT", "OBJ"), ("chase", "V", "ROOT", "SBJ"), ("dog", "N", "SBJ", "ROOT"), ("none", "N", "SBJ", "OBJ")], "form string, pos string, rel string, box string")
    got = {(x.form, x.box): [] for x in asked.collect()}
    for x in knowledge(graph, asked, RELATIONS, 10).orderBy("rank").collect():
        got[(x.form, x.box)].append((x.label, x.w))
    assert got == {("chase", "OBJ"): [("ball", 3.0), ("cat", 2.0)], ("chase", "SBJ"): [("dog", 2.0)], ("dog", "ROOT"): [("chase", 1.5)], ("none", "OBJ"): []}
    assert [x.label for x in knowledge(graph, asked, RELATIONS, 1).filter("box = 'OBJ'").collect()] == ["ball"]
    assert knowledge(graph, asked, RELATIONS, 1, "lmi").filter("box = 'OBJ'").first().label == "cat"
    with pytest.raises(ValueError, match="TIME"):
        check_relations(spark.createDataFrame([("TIME",)], "rel string"), RELATIONS)
    vecs = spark.createDataFrame([("cat", [1.0]), ("ball/N", [2.0])], "form string, vec array<double>")
    found = knowledge(graph, asked, RELATIONS, 1)
    assert in_vocabulary(found, vecs).filter("box = 'OBJ'").count() == 0  # the cut to n rows comes first
    assert in_vocabulary(found, vecs, with_pos=True).first().label == "ball"
    assert with_same_relations(found, asked).filter("rel = box").count() == 3


def test_represent(spark, graph):
    space = spark.createDataFrame([("dog", [1.0, 0.0]), ("chase", [0.0, 1.0]), ("cat", [1.0, 1.0]), ("ball", [3.0, 1.0])], "form string, vec array<double>")
    word = lambda f, p, rel: (f, p, rel)
    items = items_of(spark, [(0, "i", "OBJ", [word("dog", "N", "SBJ"), word("chase", "V", "ROOT")]), (1, "i", "SENTENCE", [word("dog", "N", "SBJ"), word("oov", "V", "ROOT")]), (2, "i", "SENTENCE", [word("oov", "V", "ROOT")]), (3, "i", "OBJ", [])])
    assert requests_of(items).filter("form = 'dog'").count() == 2
    got = {x.item_id: (x.lc, x.ac) for x in r.represent(items, graph, space, RELATIONS, r.Settings(m=1, rank_forward=False, rank_backward=False)).collect()}
    assert got[0] == (None, [2.0, 1.0])  # dog's objects: cat; chase's: ball
    assert got[1] == ([1.0, 0.0], [0.0, 1.0]) and got[2] == (None, None) and got[3] == (None, None)
    same = {x.item_id: x.ac for x in r.represent(items, graph, space, RELATIONS, r.Settings(m=1, rank_forward=False, rank_backward=False, include_same=True)).collect()}
    assert same[1] == [0.5, 0.5]


def moved(df, capsys):
    """Names of the columns that any exchange of the plan moves."""
    df.explain("formatted")
    return {c.split("#")[0].strip() for x in re.findall(r"Exchange[^\n]*\nInput \[\d+\]: \[(.*)\]", capsys.readouterr().out) for c in x.split(",")}


def shared_case(spark, graph, seed=5):
    """Items over a graph of random edges; vectors of which several forms share one, and one is zero; forms without a vector."""
    rnd = random.Random(seed)
    words = spark.createDataFrame([(i, f"w{i}", "NV"[i % 2], 1, 0.1) for i in range(30)], graph.words.schema)
    edges = {(e, rnd.randrange(30), role): None for e in range(150) for role in ("nsubj", None, "dobj")}
    args = spark.createDataFrame([(*k, 1, float(rnd.randint(-5, 9))) for k in edges], graph.args.schema)
    vectors = [(i, [0.0] * 3 if i == 4 else [rnd.uniform(-1, 1) for _ in range(3)]) for i in range(9)]
    space = r.Space(spark.createDataFrame([(f"w{i}", i % 11) for i in range(28)], "form string, vec_id long"), spark.createDataFrame(vectors, "vec_id long, vec array<double>"))
    word = lambda rel: (f"w{rnd.randrange(32)}", rnd.choice("NV"), rel)
    rels = ("SBJ", "ROOT", "OBJ", "SBJ", "OBJ")
    items = items_of(spark, [(i, f"i{i}", rnd.choice(("SENTENCE", "OBJ", "SBJ")), [word(rel) for rel in rels[: rnd.randrange(6)]]) for i in range(120)])
    return items, Graph(words, graph.events, args), space


@pytest.mark.parametrize("forward,backward,same", [(True, True, False), (True, False, True), (False, True, False), (False, False, True)])
def test_shared_vectors(spark, graph, forward, backward, same):
    items, d, space = shared_case(spark, graph)
    s = r.Settings(n=8, m=2, rank_forward=forward, rank_backward=backward, include_same=same)
    want, got = ({x.item_id: x for x in r.represent(items, d, v, RELATIONS, s).collect()} for v in (space.joined(), space))
    assert want == got and sum(x.ac is None for x in got.values()) > 5 and sum(x.ac is not None for x in got.values()) > 50


@pytest.mark.parametrize("held,short", [(0, False), (1 << 20, True)])
def test_vectors_that_tasks_cannot_hold(spark, graph, monkeypatch, held, short):
    items, d, space = shared_case(spark, graph)
    monkeypatch.setattr(r, "HELD", held)
    vectors = space.vectors.withColumn("vec", F.when(F.col("vec_id") > (99 if not short else 6), F.slice("vec", 1, 2)).otherwise(F.col("vec")))
    assert r._shared(r.Space(space.forms, vectors), r.Settings()) is None
    if not short:
        assert r.represent(items, d, space, RELATIONS).count() == 120


def test_ac_vector_moves_no_vectors(spark, capsys):
    names = moved(models.ac_vector(spark, "/root/testdata/sf0.001"), capsys)
    assert "word_id" not in names and "item_id" in names and not names & {"vec", "lc", "ac", "list", "steps", "all", "lc_all"}


def test_represent_pairs(spark, graph):
    items, d, space = shared_case(spark, graph)
    mapping = spark.createDataFrame([(i, 2 * i, 2 * i + 1) for i in range(62)], "orig long, row1 int, row2 int")
    want, got = ({x.orig: x for x in r.represent_pairs(mapping, items, d, v, RELATIONS, r.Settings(n=8, m=2)).collect()} for v in (space.joined(), space))
    assert want == got and len(got) == 60


def test_ks_scores_moves_no_vectors(spark, capsys, monkeypatch):
    monkeypatch.setattr(models, "spearman", lambda df, x, y: df.withColumn("rho", F.lit(0.0)))
    names = moved(models.ks_scores(spark, "/root/testdata/sf0.001"), capsys)
    assert names and not names & {"vec", "lc", "ac", "list", "steps", "all", "lc_all", "__a", "ac1"}


def test_import(spark, graph):
    twice = graph.words.union(graph.words)
    args = graph.args.union(spark.createDataFrame([(9, 1, "x", 1, 1.0), (1, 99, "x", 1, 1.0)], graph.args.schema))
    asso = spark.createDataFrame([(1, 3, 0.5), (1, 99, 0.5)], "word_id long, word_id2 long, weight double")
    g = import_graph(twice, graph.events, args, asso)
    assert (g.words.count(), g.args.count(), g.asso.count()) == (5, 8, 1)


def test_vectors(spark):
    rows = [([1.0, 0.0], [0.0, 0.0]), ([float("nan"), 1.0], [5.0, 2.0]), (None, [1.0, 1.0]), ([], [])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    got = df.select(v.cosine(F.col("a"), F.col("b")).alias("c"), v.cosine_or_zero(F.col("a"), F.col("b")).alias("z")).collect()
    assert [x.z for x in got] == [0.0, pytest.approx(2 / 29**0.5), None, 0.0] and got[0].c is None and got[3].c is None
    cut = spark.createDataFrame([([1.0, 2.0, 3.0],)], "a array<double>").select(v.cut(F.col("a"), 2, True), v.cut(F.col("a"), 2, False), v.cut(F.col("a"), 9, True), v.cut(F.col("a"), -1, True)).first()
    assert [list(x) for x in cut] == [[2.0, 3.0], [1.0, 2.0], [1.0, 2.0, 3.0], [1.0, 2.0, 3.0]]


def test_rerank_all_of_a_label(spark, tmp_path):
    rnd = random.Random(8)
    rows = [(i, ["a", "b", "b", "b", None][i % 5], [float(rnd.randint(-2, 2)) for _ in range(2)]) for i in range(200)]
    spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    lists = spark.createDataFrame([(x, [(str(i), vec, 0.0) for i, label, vec in rows if label == x]) for x in ("a", "b", None)], "label string, g array<struct<label:string,vec:array<double>,w:double>>")
    want = {(r.label, k, int(e.label)) for r in lists.select("label", v.rerank(F.col("g"), F.get("g", F.lit(0))["vec"]).alias("g")).collect() for k, e in enumerate(r.g)}
    assert {tuple(r) for r in models.rerank_stable(spark, str(tmp_path)).collect()} == want and len(want) == 200


def test_subsets_and_order(spark):
    df = spark.createDataFrame([(list("abcde"),), ([],), (["a"],)], "g array<string>")
    out = [tuple(x.s) for x in explode_subsets(df, "g", "s").collect()]
    assert len(out) == len(set(out)) == 2**5 - 5 - 1 and all(list(s) == sorted(s) for s in out)
    nums = number_rows(spark.range(1000).withColumn("k", (F.col("id") * 7919) % 1000), [F.col("k")], "n")
    assert nums.filter("n <> k + 1").count() == 0


def test_spearman(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, 5.0), (3, 1.0), (None, 3.0), (4, None)], "x int, y double")
    assert sorted(x.rk for x in average_ranks(df, "x", "rk").collect() if x.rk is not None) == [1.0, 2.0, 3.5, 3.5, 5.0]
    n, rho = spearman(df, "x", "y").first()
    assert n == 4 and rho == pytest.approx(np.corrcoef([1, 2, 3.5, 3.5], [2.5, 2.5, 4, 1])[0, 1])
    assert spearman(df.limit(0), "x", "y").first().rho is None


def test_prepare_and_scores(spark):
    pairs = spark.createDataFrame([(0, "a", "b", "c", "d", "e", "f", 1.0), (1, "a", "b", "c", "a", "b", "c", 2.0)], "row_id long, subject1 string, verb1 string, object1 string, subject2 string, verb2 string, object2 string, score double")
    assert [x.item for x in prepare_pairs(pairs).orderBy("item_id").collect()][:2] == ["a@N@SBJ b@V@ROOT c@N@OBJ", "d@N@SBJ e@V@ROOT f@N@OBJ"]
    assert prepare_pairs(pairs, "verbs_args").filter("item_id = 0").first().item == "b@V@ROOT a@N@SBJ c@N@OBJ"
    fit = spark.createDataFrame([(0, "s", "v", "o")], "row_id long, SUBJECT string, VERB string, OBJECT string")
    assert prepare_fit(fit, "Recipient").first()[1:] == ("s@N@SBJ v@V@ROOT  o@N@OBJ", "RECIPIENT")
    assert prepare_fit(fit, "Triples").first()[1:] == ("s@N@SBJ v@V@ROOT", "OBJ")
    for bad in (lambda: prepare_fit(fit, "Pairs"), lambda: prepare_pairs(pairs, "nope")):
        with pytest.raises(ValueError):
            bad()
    a = spark.createDataFrame([(0, "cop-n_obj"), (1, "arrest-v_sbj"), (2, "odd"), (3, None)], "row_id long, c0 string")
    assert [x[1:] for x in prepare_analogies(a).orderBy("item_id").collect()] == [("cop@N@SBJ", "OBJ"), ("arrest@V@ROOT", "SBJ"), (None, None), (None, None)]
    res = spark.createDataFrame([(0, "OBJ", [1.0, 0.0]), (1, "OBJ", [1.0, 0.0]), (2, "OBJ", None), (3, "OBJ", [0.0, 1.0])], "item_id long, target string, ac array<double>")
    assert {x.row_id: x.sims for x in pair_similarity(pair_mapping(pairs), res, pairs).collect()} == {0: 1.0, 1: None}
    gold = spark.createDataFrame([(0, "ball", 3.0), (1, "oov", 3.0), (2, "ball", 1.0), (3, "ball", 1.0)], "row_id long, OBJECT string, mean_rat double")
    space = spark.createDataFrame([("ball", [1.0, 0.0])], "form string, vec array<double>")
    assert {x.row_id: x.sims for x in filler_similarity(res, gold, space).collect()} == {0: 1.0, 2: None, 3: 0.0}


@pytest.mark.parametrize("n,rho,p", [(5, 0.8207826816681233, 0.08858700531354381), (3, 0.5, 2 / 3), (4, 0.0, 1.0), (10, 1.0, 0.0), (2, 0.5, None), (7, None, None)])
def test_chance_of_a_rank_correlation(n, rho, p):
    assert spearman_p(n, rho) == (p if p is None else pytest.approx(p, abs=1e-9))


def test_chance_of_large_samples():
    # for many rows the distribution is near the normal one: two standard deviations leave 4.55 percent
    assert spearman_p(1_000_001, 0.002) == pytest.approx(0.0455, abs=1e-4)
    assert spearman_p(1_000_001, -0.002) == spearman_p(1_000_001, 0.002)
