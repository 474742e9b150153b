import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventweave.llm import heavy_hitters as hh


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 50)), max_size=200), st.integers(1, 5))
def test_bounds_hold(rows, parts):
    """Candidates' bounds hold, and every key at the threshold is a candidate or in hiding cells of all rows, however the rows are divided."""
    keys = np.array([k * 0x9E3779B97F4A7C15 % 2**64 for k, _ in rows], np.uint64).view(np.int64)
    weights = np.array([w for _, w in rows], np.int64)
    whole = hh.VoteSketch(4, 8)
    for i in range(parts):
        s = hh.VoteSketch(4, 8)
        s.fold(keys[i::parts], weights[i::parts])
        used = np.flatnonzero(s.total)
        whole.merge(used, s.total[used], s.key[used], s.surplus[used])
    true = pd.Series(weights).groupby(keys).sum() if len(rows) else pd.Series(dtype=np.int64)
    for key, w in true.items():
        k = np.array([key], np.int64)
        for row in range(4):
            c = whole.cells(k, row)[0]
            mine = whole.key[c] == key and whole.surplus[c] > 0
            assert 2 * w <= whole.total[c] + (whole.surplus[c] if mine else -whole.surplus[c]) or (whole.key[c] == key and 2 * w <= whole.total[c] + whole.surplus[c])
            if mine:
                assert w >= whole.surplus[c]


def events(spark, rows):
    return spark.createDataFrame(rows, "eventid long, form string, freq int").withColumn("item", F.lit("clash")).withColumn("key", F.lit(1)).withColumn("weight", F.lit(2))


def test_frequent_events(spark):
    rows = [(1, "b@N@x, a@V@HEAD", 60), (1, "b@N@x, a@V@HEAD", 60), (2, "a@V@HEAD,b@N@x\t", 40), (3, None, 1000), (4, "", 1000), (5, "a@b", 1000), (6, "a@@c,d@e@f", 1000), (7, "z@N@x", None), (8, "m@N@x," + "y" * 50000 + "@N@x", 3), (None, "n@N@x", 7), (None, "n@N@x", 7)]
    rows += [(100 + i, f"w{i}@N@x", 1) for i in range(500)]
    got = {r.form: r for r in hh.frequent_events(events(spark, rows), 20).collect()}
    assert set(got) == {"a@V@HEAD,b@N@x"}
    r = got["a@V@HEAD,b@N@x"]
    assert r.total == 100 and r.lower <= 100 <= r.upper
    assert hh.frequent_events(events(spark, rows).limit(0), 20).count() == 0
    assert hh.frequent_events(events(spark, [(1, "a@N@x", None), (2, "b@N@x", -5)]), 20).count() == 0


def test_crowded_sketch_loses_nothing(spark):
    """With far fewer cells than frequent items, the cells that may hide one are counted exactly."""
    rows = [(i, f"w{i % 100}@N@x", 5) for i in range(2000)]
    df = events(spark, rows)
    got = hh.heavy_hitters(df, F.col("form"), F.col("freq"), 150, ["eventid"], depth=2, width=16)
    assert got.count() == 100 and {r.total for r in got.collect()} == {100}
