"""Items of varying length in containers of fixed capacity: a configuration linear program over the length histogram."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventweave.llm import bpe
from eventweave.session import materialize


@dataclass(frozen=True)
class Pattern:
    """`copies` containers that each hold `counts[i]` items of `sizes[i]`."""

    sizes: tuple[int, ...]
    counts: tuple[int, ...]
    copies: int


def price(value: np.ndarray) -> np.ndarray:
    """The most valuable content of one container: how many items of each size. `value[s]` is the price of size s (minus infinity: none), its
    length the capacity plus one. Unbounded knapsack by dynamic programming over the filled space."""
    capacity = len(value) - 1
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        options = best[c - 1 :: -1] + value[1 : c + 1] if c < capacity else best[:c][::-1] + value[1:]
        j = int(options.argmax())
        if options[j] > best[c - 1]:
            best[c], last[c] = options[j], j + 1
        else:
            best[c] = best[c - 1]
    counts, c = np.zeros(capacity + 1, np.int64), capacity
    while c > 0:
        if last[c]:
            counts[last[c]] += 1
            c -= int(last[c])
        else:
            c -= 1
    return counts


def fractional(demand: np.ndarray, rounds: int, rate: float = 0.7) -> list[tuple[np.ndarray, float]]:
    """The covering program `least containers so that every size has its demand`, by multiplicative weights: (content, containers) of each round.

    Each round prices one container and takes it as often as its scarcest size allows; the prices of what it holds fall by the share of the demand
    that is covered. The sum over rounds, divided by how often a size is covered on average, is near the program's optimum.
    """
    capacity = len(demand) - 1
    there = demand > 0
    weight = np.where(there, np.arange(capacity + 1) / capacity, 0.0)
    covered = np.zeros(capacity + 1)
    found = []
    for _ in range(rounds):
        counts = price(np.where(there, weight, -np.inf))
        used = counts > 0
        if not used.any():
            break
        step = float((demand[used] / counts[used]).min())
        share = counts[used] * step / demand[used]
        covered[used] += share
        weight[used] *= np.exp(-rate * share)
        found.append((counts, step))
    space = demand * np.arange(capacity + 1)
    scale = max(1.0, float((covered * space).sum() / max(space.sum(), 1)))
    return [(c, s / scale) for c, s in found]


def _take(left: np.ndarray, counts: np.ndarray, most: float, out: list[Pattern]) -> None:
    used = np.flatnonzero(counts)
    copies = int(min(most, (left[used] // counts[used]).min()))
    if copies > 0:
        left[used] -= counts[used] * copies
        out.append(Pattern(tuple(used.tolist()), tuple(counts[used].tolist()), copies))


def plan(demand: np.ndarray, rounds: int = 400) -> list[Pattern]:
    """Whole containers for the histogram `demand` (`demand[s]` items of size s, s up to the capacity): every item in exactly one.

    The fractional program is rounded down; what is left is solved once more, and the rest goes largest first into the best remaining fit, as many equal
    containers at a time as the counts allow. Work and memory depend on the capacity and `rounds`, not on the number of items.
    """
    capacity = len(demand) - 1
    left = demand.astype(np.int64).copy()
    left[0] = 0
    out: list[Pattern] = []
    for share in (rounds, rounds // 2):
        if not left.any():
            break
        before = int(left.sum())
        merged: dict[bytes, tuple[np.ndarray, float]] = {}
        for counts, step in fractional(left, share):
            merged[counts.tobytes()] = (counts, merged.get(counts.tobytes(), (counts, 0.0))[1] + step)
        for counts, step in sorted(merged.values(), key=lambda x: (-x[1], x[0].tobytes())):
            if int(counts @ np.arange(capacity + 1)) == capacity:  # others waste space that the rest may fill
                _take(left, counts, np.floor(step + 1e-9), out)
        if int(left.sum()) > 0.9 * before:
            break
    while left.any():
        counts, room = np.zeros(capacity + 1, np.int64), capacity
        while room > 0:
            fits = np.flatnonzero(left[: room + 1] > counts[: room + 1])
            if not len(fits):
                break
            s = int(fits[-1])
            n = min(room // s, int(left[s] - counts[s]))
            counts[s] += n
            room -= n * s
        _take(left, counts, np.inf, out)
    return out


def pieces(df: DataFrame, ids: list[str], size: str, capacity: int) -> DataFrame:
    """(*ids, piece, begin, n): an item within the capacity is one piece; a larger one is divided into full pieces and its rest. Size 0 or null is one piece of 0."""
    n = F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0))
    cut = df.select(*ids, n.alias("__n")).select(*ids, "__n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest((F.col("__n") - 1).cast("bigint"), F.lit(0)) - F.pmod(F.greatest(F.col("__n") - 1, F.lit(0)), F.lit(capacity)), F.lit(capacity).cast("bigint"))).alias("begin"))
    return cut.select(*ids, (F.col("begin") / capacity).cast("int").alias("piece"), "begin", F.least(F.col("__n") - F.col("begin"), F.lit(capacity)).cast("int").alias("n"))


def pack(df: DataFrame, ids: list[str], size: str, capacity: int = 2048, rounds: int = 400, buckets: int = 256) -> DataFrame:
    """(*ids, piece, begin, n, container): every item in a container of at most `capacity`; only larger items are divided.

    Only the histogram (at most `capacity` counts) goes to the driver; the plan it gets is a table of at most a few thousand rows. Items of one size are
    numbered within `buckets` of their hash and shifted by the counts of the buckets before, so a size with a third of all items is no single task.
    Items of size 0 (or null) take no space and lie in container 0. Equal rows are items each; an empty table gives no rows.
    """
    items = materialize(pieces(df, ids, size, capacity), "pieces")
    spark = df.sparkSession
    demand = np.zeros(capacity + 1, np.int64)
    for s, n in items.groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect():  # at most capacity + 1 rows
        demand[s] = n
    rows, filled, base = [], np.zeros(capacity + 1, np.int64), 0
    for p in plan(demand, rounds):
        for s, per in zip(p.sizes, p.counts):
            rows.append((s, int(filled[s]), int(filled[s] + per * p.copies), base, per))
            filled[s] += per * p.copies
        base += p.copies
    rows.append((0, 0, int(max(demand[0], 1)), 0, int(max(demand[0], 1))))
    slots = F.broadcast(spark.createDataFrame(rows, "n int, lo bigint, hi bigint, base bigint, per bigint"))  # bounded by the patterns: rounds + capacity
    items = items.withColumn("bucket", F.pmod(F.xxhash64(*ids, "piece"), F.lit(buckets)).cast("int"))
    before = items.groupBy("n", "bucket").agg(F.count(F.lit(1)).alias("k"))
    before = before.select("n", "bucket", (F.sum("k").over(W.partitionBy("n").orderBy("bucket")) - F.col("k")).alias("shift"))
    ranked = items.withColumn("rank", F.row_number().over(W.partitionBy("n", "bucket").orderBy(*ids, "piece")) - 1).join(before, ["n", "bucket"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("shift"))
    out = ranked.join(slots, (ranked["n"] == slots["n"]) & (ranked["rank"] >= slots["lo"]) & (ranked["rank"] < slots["hi"]))
    container = F.col("base") + F.floor((F.col("rank") - F.col("lo")) / F.col("per"))
    return out.select(*ids, "piece", "begin", ranked["n"], container.cast("bigint").alias("container"))


def pack_documents(docs: DataFrame, capacity: int = 2048, path: str = bpe.VOCABULARY) -> DataFrame:
    """(doc_id, piece, begin, n, container) of all documents, sized in tokens of the vocabulary at `path`."""
    return pack(bpe.token_counts(docs, ["doc_id"], path=path), ["doc_id"], "n_tokens", capacity)
