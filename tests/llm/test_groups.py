import itertools
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from eventweave.llm import queries, terms, together, top_n

T0 = datetime(2022, 1, 1)


def test_top_n_generic(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["hot", "hot", "hot", "a", None]), rnd.choice([1.0, 2.0, 3.0, None]), i % 400) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, score double, id int").withColumn("__x", F.lit(1))
    got = defaultdict(list)
    for r in top_n.top_n(df, ["g"], [F.col("score").desc_nulls_last()], ["id"], 5, 4).collect():
        got[r.g].append((r.score, r.id))
    for g in ("hot", "a", None):
        want = sorted(((s, i) for x, s, i in rows if x == g), key=lambda t: (t[0] is None, -(t[0] or 0), t[1]))[:5]
        assert sorted(map(str, got[g])) == sorted(map(str, want))


def test_strongest_events(spark):
    rnd = random.Random(2)
    edges, words = [], []
    for w in range(6):
        for s in range(2):
            words.append((w, f" W{w % 4}" if s else f"w{w % 4} ", "N", s))
    words += [(None, "none", "N", 0), (7, None, "N", 0)]
    for e in range(120):
        for _ in range(rnd.choice([1, 1, 2])):
            edges.append((e, rnd.choice([0, 0, 0, 1, 4, 5, 7, 99, None]), rnd.choice(["nsubj", " NSUBJ", None, "", "None", "head "]), rnd.randint(0, 1), rnd.choice([1.0, 1.5, 2.0, float("inf"), float("nan"), None]), rnd.choice([1, 2, None]), T0 + timedelta(seconds=rnd.randint(0, 3)) if rnd.random() < 0.9 else None))
    edges += edges[:20]
    e = spark.createDataFrame(edges, "event_id long, word_id long, role string, slice_id int, pmi double, freq int, loaded_at timestamp").withColumn("salt", F.lit(1)).withColumn("form", F.lit("clash"))
    w = spark.createDataFrame(words, "wordid long, form string, pos string, slice_id int")
    latest = {}
    for ev, wd, role, sl, pmi, fr, at in edges:
        if wd is None:
            continue
        role = (role or "").strip().lower()
        role = "head" if role in ("", "none", "head") else role
        rank = lambda x: (x is not None, x if x is not None else 0)
        value = (rank(at and at.timestamp()), (pmi is not None, pmi != pmi, pmi if pmi is not None and pmi == pmi else 0), rank(fr), sl)
        if (ev, wd, role) not in latest or value > latest[ev, wd, role][0]:
            latest[ev, wd, role] = (value, sl, pmi, fr)
    groups = defaultdict(list)
    for (ev, wd, role), (_, sl, pmi, fr) in latest.items():
        if pmi is not None and pmi == pmi and wd < 6:
            groups[sl, f"w{wd % 4}", role].append((-pmi, -(fr if fr is not None else -1), ev))
    want = Counter((*g, x[2]) for g, rows in groups.items() if len(rows) > 10 for x in sorted(rows)[:10])
    got = Counter((r.slice_id, r.form, r.role, r.event_id) for r in top_n.strongest_events(e, w, salts=3).collect())
    assert want and got == want
    assert top_n.strongest_events(e.limit(0), w).count() == 0 and top_n.strongest_events(e, w.limit(0)).count() == 0


def test_pairs(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(300):
        items = rnd.sample([f"w{k}@N@x" for k in range(8)], rnd.randint(1, 4))
        rows.append((i, rnd.choice([",", ", "]).join(items * rnd.randint(1, 2))))
    rows += rows[:30] + [(900, None), (901, ""), (902, "a@b,c@d@e"), (None, "w0@N@x,w1@N@x"), (None, "w0@N@x,w1@N@x")]
    df = spark.createDataFrame(rows, "eventid long, form string").withColumn("weight", F.lit(9)).withColumn("items", F.lit(0))
    records = {(i, tuple(sorted({x.strip() for x in f.split(",")}))) for i, f in rows if f and not f.startswith("a@b")}
    single, both = Counter(x for _, r in records for x in r), Counter(p for _, r in records for p in itertools.combinations(r, 2))
    n = len(records)
    for least in (1, 40):
        got = {(r.item_a, r.item_b): r for r in together.members_together(df, least, None).collect()}
        assert {k: r.n_ab for k, r in got.items()} == {k: c for k, c in both.items() if c >= least}
        for (a, b), r in got.items():
            assert (r.n, r.n_a, r.n_b) == (n, single[a], single[b]) and abs(r.lift - r.n_ab * n / (single[a] * single[b])) < 1e-9
            rest = single[a] - r.n_ab
            assert (r.conviction is None) == (rest == 0) and (rest == 0 or abs(r.conviction - single[a] * (n - single[b]) / (n * rest)) < 1e-9)
    assert together.members_together(df.limit(0)).count() == 0
    large = spark.createDataFrame([(1, ",".join(f"v{k:04d}@N@x" for k in range(600)))], "eventid long, form string")
    assert together.members_together(large, 1, None).count() == 600 * 599 // 2


def test_all_pairs(spark, tmp_path):
    rows = [(1, "a@N@x,b@V@y"), (2, "a@N@x, c@N@x"), (3, "a@N@x,b@V@y"), (4, "d@N@x,e@N@x"), (4, "d@N@x,e@N@x")]
    spark.createDataFrame(rows, "eventid long, form string").write.parquet(f"{tmp_path}/events_nodes.parquet")
    got = {tuple(r) for r in queries.p4_pairs(spark, str(tmp_path)).collect()}
    assert got == {("a@N@x", "b@V@y", 3, 2, 2, 1.333), ("a@N@x", "c@N@x", 3, 1, 1, 1.333), ("d@N@x", "e@N@x", 1, 1, 1, 4.0)}


def test_terms(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice(["hot", "hot", "a", "b", None, ""]), rnd.choice([0, 1, 2, None]), rnd.choice([1, 2, None])) for _ in range(400)]
    df = spark.createDataFrame(rows, "t string, rec int, w int").withColumn("__weightless", F.lit(1))
    total, records = Counter(), defaultdict(set)
    for t, r, w in rows:
        total[t] += w or 0
        records[t].add(r)
    assert {r.t: (r.occurrences, r.records) for r in terms.term_counts(df, ["t"], "rec", F.col("w"), 3).collect()} == {t: (total[t], len(records[t])) for t in records}
    words = [(1, " Dog", "NNS", 2, 0, T0), (1, "dog", "N", 1, 0, T0 + timedelta(1)), (1, "dog", "N", 1, 0, T0 + timedelta(1)), (2, "DOG ", "N", None, 1, None), (3, "the", "D", 5, 0, T0), (3, "the", "D", 5, 1, T0), (4, "mid", "N", 9, 1, T0), (5, None, None, 1, 1, T0)]
    df = spark.createDataFrame(words, "wordid long, form string, pos string, freq int, slice_id int, loaded_at timestamp").withColumn("occurrences", F.lit(1))
    got = {(r.form, r.pos): (r.freq, r.slices, r.mark) for r in terms.word_marks(df).collect()}
    assert got == {("dog", "N"): (1, 2, "rare"), ("the", "D"): (10, 2, "common"), ("mid", "N"): (9, 1, None), (None, None): (1, 1, "rare")}
    assert terms.word_marks(df.limit(0)).count() == 0


def test_last_seen_meets_repeats(spark):
    """The counter runs over the tokens themselves: a record that comes again, in any place, doesn't count again."""
    rnd = random.Random(8)
    rows = [(rnd.choice("ab"), rnd.choice([1, 2, 3, None])) for _ in range(200)]
    out = terms.last_seen(spark.createDataFrame(rows, "t string, rec int").repartition(5), ["t"], "rec")
    assert out.count() == 200 and out.filter("__new = 0").count() == 192
    assert {(r.t, r.n) for r in out.groupBy("t").agg(F.sum("__new").alias("n")).collect()} == {("a", 4), ("b", 4)}


def test_baskets_are_reduced_before_pairs(spark, monkeypatch):
    items = [f"v{k:04d}" for k in range(5000)]
    df = spark.createDataFrame([(items, 1), (["v0001", "v0100", "v4999"], 3), (["v0001"], 9), (["other", "v0001", "v4999"], 2)], "items array<string>, weight long")
    want = {("v0001", "v0100"): 4, ("v0001", "v4999"): 6, ("v0100", "v4999"): 4}
    frequent = spark.createDataFrame([(x,) for x in ("v0001", "v0100", "v4999")], "item string")
    for literal in (10, 2):
        monkeypatch.setattr(together, "LITERAL_ITEMS", literal)
        few = together.reduce_baskets(df, frequent, 3)
        assert {tuple(r["items"]): r.weight for r in few.collect()} == {("v0001", "v0100", "v4999"): 4, ("v0001", "v4999"): 2}
        assert {(r.item_a, r.item_b): r.n_ab for r in together.pairs_in(df, 4, None).collect()} == want
    assert together.enumerate_pairs(few).count() == 4


def test_large_baskets_are_divided(spark, monkeypatch):
    monkeypatch.setattr(together, "LARGE", 7)
    baskets = [([f"i{k:02d}" for k in range(n)], n + 1) for n in (0, 1, 2, 6, 7, 8, 14, 15, 40)]
    df = spark.createDataFrame(baskets, "items array<string>, weight long")
    want = Counter()
    for b, w in baskets:
        for p in itertools.combinations(b, 2):
            want[p, w] += 1
    assert Counter(((r.item_a, r.item_b), r.weight) for r in together.enumerate_pairs(df).collect()) == want
