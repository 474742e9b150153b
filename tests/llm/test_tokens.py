import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from eventweave.llm import bpe, packing


@pytest.fixture(scope="module")
def public():
    t = Tokenizer.from_file(bpe.VOCABULARY)
    t.encode_special_tokens = True
    return t


def own(texts):
    flat, ends = bpe.merger(bpe.VOCABULARY).encode(texts)
    return [x.tolist() for x in np.split(flat, ends[:-1])] if len(ends) else []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=60), st.text(alphabet="ab' \n\t1é<|>endoftxt", max_size=60)), max_size=6))
def test_any_text(texts):
    t = Tokenizer.from_file(bpe.VOCABULARY)
    t.encode_special_tokens = True
    assert own(texts) == [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_odd_texts(spark, public):
    rnd = random.Random(6)
    texts = ["", None, "a" * 20000, "ab" * 5000, "".join(rnd.choice("abcdefgh") for _ in range(3000)), "😀" * 999, " " * 5000, "<|endoftext|>", "hello world"] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = {r.doc_id: r.ids for r in bpe.encode(df, ["doc_id"]).collect()}
    assert got == {i: x.ids for i, x in enumerate(public.encode_batch([t or "" for t in texts], add_special_tokens=False))}
    assert got[0] == [] and got[1] == []
    counts = bpe.token_counts(df, ["doc_id"])
    assert {r.doc_id: r.n_tokens for r in counts.collect()} == {i: len(x) for i, x in got.items()}
    assert bpe.encode(df.limit(0), ["doc_id"]).count() == 0


def test_documents(spark, public):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.ids for r in bpe.encode(rows, ["doc_id"]).collect()}
    texts = rows.select("doc_id", "text").collect()
    want = public.encode_batch([r.text or "" for r in texts], add_special_tokens=False)
    assert all(got[r.doc_id] == w.ids for r, w in zip(texts, want)) and len(got) == len(texts)


def test_price_is_the_best_knapsack():
    rnd = random.Random(7)
    for _ in range(20):
        cap = rnd.randint(5, 30)
        value = np.array([-np.inf] + [rnd.choice([-np.inf, rnd.random() * s]) for s in range(1, cap + 1)])
        best = np.zeros(cap + 1)
        for c in range(1, cap + 1):
            best[c] = max([best[c - 1], *(best[c - s] + value[s] for s in range(1, c + 1))])
        counts = packing.price(value)
        held = np.flatnonzero(counts)
        assert counts @ np.arange(cap + 1) <= cap and abs(sum(counts[s] * value[s] for s in held) - best[cap]) < 1e-9


@pytest.mark.parametrize("cap,n,seed", [(20, 200, 1), (100, 3000, 2), (64, 5, 3), (50, 0, 4)])
def test_plan_holds_every_item_once(cap, n, seed):
    rnd = np.random.default_rng(seed)
    demand = np.bincount(rnd.integers(1, cap + 1, n) if n else np.empty(0, int), minlength=cap + 1)
    got = np.zeros(cap + 1, int)
    plan = packing.plan(demand, 60)
    for p in plan:
        assert sum(s * c for s, c in zip(p.sizes, p.counts)) <= cap and p.copies > 0
        for s, c in zip(p.sizes, p.counts):
            got[s] += c * p.copies
    assert (got == demand).all()
    large = int(demand[cap // 2 + 1 :].sum())
    lower = max(-(-int(demand @ np.arange(cap + 1)) // cap), large)
    assert sum(p.copies for p in plan) <= 1.08 * lower + 1


def test_pack(spark):
    sizes = [0, None, 7, 7, 7, 25, 30, 10, 3, -4] + [5] * 200
    df = spark.createDataFrame(list(enumerate(sizes)), "id int, size int").withColumn("container", F.lit("clash")).withColumn("rank", F.lit(1))
    rows = packing.pack(df, ["id"], "size", 10, 40, 4).collect()
    held = {}
    for r in rows:
        held[r.container] = held.get(r.container, 0) + r.n
    whole = {}
    for r in rows:
        whole.setdefault(r.id, []).append((r.piece, r.begin, r.n))
    assert set(whole) == set(range(len(sizes))) and max(held.values()) <= 10
    for i, s in enumerate(sizes):
        p = sorted(whole[i])
        assert sum(x[2] for x in p) == max(s or 0, 0) and [x[1] for x in p] == [10 * k for k in range(len(p))] and (len(p) == 1 or (s or 0) > 10)
    assert len(held) == 6 + 1 + 2 + 101  # full ones, 7 with 3, two 7 that nothing fits beside, pairs of 5
    assert packing.pack(df.limit(0), ["id"], "size", 10, 5).count() == 0
    assert [r.container for r in packing.pack(df.filter("size = 0"), ["id"], "size", 10, 5).collect()] == [0]
