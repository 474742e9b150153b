"""Most frequent items: a majority-vote sketch with provable bounds."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventweave.functions.text import event_key

#: Rows that are folded into a sketch at once; bounds the memory of a task besides the sketch itself.
BLOCK = 1 << 18
CELLS = pa.schema([("cell", pa.int32()), ("total", pa.int64()), ("key", pa.int64()), ("surplus", pa.int64())])
CELLS_DDL = "cell int, total bigint, key bigint, surplus bigint"


class VoteSketch:
    """`depth` rows of `width` cells; a cell holds the total weight hashed to it, a candidate and the candidate's surplus of votes.

    For every key x of a cell: weight(x) <= (total + surplus) / 2 if x is the candidate, else <= (total - surplus) / 2; and the candidate's
    weight is at least the surplus. Folding and merging keep both.
    """

    def __init__(self, depth: int, width: int):
        if width & (width - 1) or width > 1 << 16 or not 1 <= depth <= 4:
            raise ValueError("width must be a power of two up to 65536, depth 1 to 4")
        self.depth, self.width = depth, width
        self.total = np.zeros(depth * width, np.int64)
        self.key = np.zeros(depth * width, np.int64)
        self.surplus = np.zeros(depth * width, np.int64)

    def cells(self, keys: np.ndarray, row: int) -> np.ndarray:
        """Cell numbers of hashed keys in one row: its own 16 bits of the hash."""
        return ((keys.view(np.uint64) >> np.uint64(16 * row)) & np.uint64(self.width - 1)).astype(np.int64) + row * self.width

    def merge(self, cell: np.ndarray, total: np.ndarray, key: np.ndarray, surplus: np.ndarray) -> None:
        """Add other cells (each number once): equal candidates join their votes, different ones cancel them."""
        mine, own = self.surplus[cell], self.key[cell]
        same = own == key
        left = np.where(same, mine + surplus, mine - surplus)
        # equal votes leave none; the smaller key is kept, so that the order of merging two sketches doesn't matter
        take = (left < 0) | ((left == 0) & (key < own))
        self.key[cell] = np.where(same | ~take, own, key)
        self.surplus[cell] = np.abs(left)
        self.total[cell] += total

    def fold(self, keys: np.ndarray, weights: np.ndarray) -> None:
        """Add weighted keys: each cell's share of the block becomes one cell by itself and is merged."""
        if not len(keys):
            return
        order = np.argsort(keys, kind="stable")
        keys, weights = keys[order], weights[order]
        start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        keys, weights = keys[start], np.add.reduceat(weights, start)
        for row in range(self.depth):
            cell = self.cells(keys, row)
            order = np.lexsort((-weights, cell))
            c, w, k = cell[order], weights[order], keys[order]
            first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
            total = np.add.reduceat(w, first)
            self.merge(c[first], total, k[first], np.maximum(2 * w[first] - total, 0))

    def batch(self) -> pa.RecordBatch:
        used = np.flatnonzero(self.total)
        return pa.record_batch([pa.array(used.astype(np.int32)), *(pa.array(x[used]) for x in (self.total, self.key, self.surplus))], schema=CELLS)


@dataclass(frozen=True)
class Bounds:
    """What a merged sketch knows: candidates with bounds, and the cells that may hide a key at or above the threshold."""

    weight: int
    key: np.ndarray
    lower: np.ndarray
    upper: np.ndarray
    hiding: list[list[int]]


def _fold(depth: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, keys, weights, held = VoteSketch(depth, width), [], [], 0
        for b in batches:
            keys.append(b.column(0).to_numpy(zero_copy_only=False))
            weights.append(b.column(1).to_numpy(zero_copy_only=False))
            held += b.num_rows
            if held >= BLOCK:
                sketch.fold(np.concatenate(keys), np.concatenate(weights))
                keys, weights, held = [], [], 0
        if held:
            sketch.fold(np.concatenate(keys), np.concatenate(weights))
        yield sketch.batch()

    return run


def _merge(depth: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = VoteSketch(depth, width)
        for b in batches:
            cell, total, key, surplus = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            while len(cell):  # a batch may hold a cell from several sketches: one of each at a time
                _, at = np.unique(cell, return_index=True)
                sketch.merge(cell[at].astype(np.int64), total[at], key[at], surplus[at])
                rest = np.ones(len(cell), bool)
                rest[at] = False
                cell, total, key, surplus = cell[rest], total[rest], key[rest], surplus[rest]
        yield sketch.batch()

    return run


def vote_sketch(hashed: DataFrame, depth: int = 4, width: int = 4096) -> DataFrame:
    """The merged sketch of (key bigint, weight bigint) rows: at most depth * width cells, whatever the input.

    Each task folds its rows into one sketch, so a key with a third of all rows is at most one cell of each row when anything is shuffled.
    """
    parts = hashed.select("key", "weight").mapInArrow(_fold(depth, width), CELLS_DDL)
    return parts.repartition("cell").mapInArrow(_merge(depth, width), CELLS_DDL)


def bounds(cells: DataFrame, depth: int, width: int, one_in: int) -> Bounds:
    """Candidates that may weigh at least one `one_in`-th of everything. Only the sketch goes to the driver: depth * width cells of 28 bytes."""
    got = cells.toArrow()
    sketch = VoteSketch(depth, width)
    if got.num_rows:
        at = got.column("cell").to_numpy().astype(np.int64)
        for name in ("total", "key", "surplus"):
            getattr(sketch, name)[at] = got.column(name).to_numpy()
    weight = int(sketch.total[:width].sum())
    key = np.unique(sketch.key[sketch.surplus > 0])
    lower, upper2 = np.zeros(len(key), np.int64), np.full(len(key), np.iinfo(np.int64).max)
    for row in range(depth):
        c = sketch.cells(key, row)
        mine = sketch.key[c] == key
        upper2 = np.minimum(upper2, sketch.total[c] + np.where(mine, 1, -1) * sketch.surplus[c])
        lower = np.maximum(lower, np.where(mine, sketch.surplus[c], 0))
    least2 = -(-2 * weight // one_in)  # of twice the weight, rounded up: nothing is multiplied that may overflow
    keep = upper2 >= least2
    hides = (sketch.total > 0) & (sketch.total - sketch.surplus >= least2)
    hiding = [np.flatnonzero(hides[r * width : (r + 1) * width]).tolist() for r in range(depth)]
    return Bounds(weight, key[keep], lower[keep], upper2[keep] // 2, hiding)


def may_be_frequent(hash_col: Column, found: Bounds, depth: int, width: int) -> Column:
    """Keys that may reach the threshold: the candidates, and those whose cell in every row may hide one. Complete for any input."""
    hidden = F.lit(True)
    for row in range(depth):
        cell = F.shiftrightunsigned(hash_col, 16 * row).bitwiseAND(F.lit(width - 1).cast("bigint"))
        hidden = hidden & (cell.isin(found.hiding[row]) if found.hiding[row] else F.lit(False))
    return hash_col.isin([int(k) for k in found.key]) | hidden if len(found.key) else hidden


def heavy_hitters(df: DataFrame, item: Column, weight: Column, one_in: int = 500, copies: list[str] | None = None, depth: int = 4, width: int = 4096) -> DataFrame:
    """Items that weigh at least one `one_in`-th of the whole: (item, lower, upper, total).

    `lower` and `upper` come from the sketch, `total` from an exact count of the few items that it can't rule out. An item never misses: where the
    sketch's residual doesn't prove that a cell hides none, the keys of that cell are counted too.
    `copies`: columns that identify a row; rows that agree in them and the item count once, with their greatest weight.
    Null items are left out, null and negative weights add nothing; an empty table has no items. Ties need no rule: every item at the threshold comes out.
    """
    rows = df.select(*[df[c].alias(f"c{i}") for i, c in enumerate(copies or [])], item.alias("item"), F.greatest(F.coalesce(weight.cast("bigint"), F.lit(0)), F.lit(0)).alias("weight")).filter(F.col("item").isNotNull())
    names = [f"c{i}" for i in range(len(copies or []))]
    hashed = rows.withColumn("key", F.xxhash64("item"))
    first = hashed.select(*names, "key", "weight")
    if names:
        first = first.groupBy(*names, "key").agg(F.max("weight").alias("weight"))
    found = bounds(vote_sketch(first, depth, width), depth, width, one_in)
    few = hashed.filter(may_be_frequent(F.col("key"), found, depth, width))
    if names:
        few = few.groupBy(*names, "key", "item").agg(F.max("weight").alias("weight"))
    exact = few.groupBy("item", "key").agg(F.sum("weight").alias("total")).filter(F.col("total") >= -(-found.weight // one_in))
    if not found.weight:
        exact = exact.filter("false")
    spark = df.sparkSession
    known = spark.createDataFrame([(int(k), int(a), int(b)) for k, a, b in zip(found.key, found.lower, found.upper)], "key bigint, lower bigint, upper bigint")
    out = exact.join(F.broadcast(known), "key", "left")  # at most depth * one_in rows
    return out.select("item", F.coalesce("lower", F.lit(0)).alias("lower"), F.coalesce("upper", "total").alias("upper"), "total")


def frequent_events(events: DataFrame, one_in: int = 500) -> DataFrame:
    """Event forms with at least one `one_in`-th of the total `freq`: (form, lower, upper, total). Rows of one `eventid` count once."""
    return heavy_hitters(events, event_key(events["form"]), events["freq"], one_in, copies=["eventid"]).withColumnRenamed("item", "form")
