"""The active context of many items at once, in numpy, over a table of vectors that every task holds.

The same numbers as `representation.fold_context` and `functions.vectors`: sums run over words, relations and dimensions in the same order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Contexts folded at once.
CHUNK = 2048


@dataclass(frozen=True)
class Fold:
    """`vectors`: one a row; the other fields as in `representation.Settings`."""

    vectors: np.ndarray
    m: int
    forward: bool
    backward: bool


def _center(f: Fold, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean, whether there is one) of contexts: over lists that aren't empty, of the means of their first m vectors. ids: (contexts, lists, places)."""
    total, lists = np.zeros((len(ids), f.vectors.shape[1])), np.zeros(len(ids), np.int64)
    for u in range(ids.shape[1]):
        k = np.minimum(size[:, u], f.m)
        there = np.flatnonzero(k)
        own = f.vectors[ids[there, u, 0]]
        for j in range(1, k.max(initial=0)):
            more = np.flatnonzero(k[there] > j)
            own[more] += f.vectors[ids[there[more], u, j]]
        total[there] += own / k[there, None]
        lists[there] += 1
    return total / np.maximum(lists, 1)[:, None], lists > 0


def _rank(f: Fold, ids: np.ndarray, size: np.ndarray, head: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Lists (contexts, places) by cosine to the heads that are there: highest first, equal ones in their order, NaN and then undefined ones last."""
    dot, square, norm = np.zeros(ids.shape), np.zeros(len(ids)), np.zeros(len(f.vectors))
    for d in range(head.shape[1]):
        column = np.ascontiguousarray(f.vectors[:, d])
        dot += column[ids] * head[:, d, None]
        square += head[:, d] * head[:, d]
        norm += column * column
    by = np.sqrt(norm)[ids] * np.sqrt(square)[:, None]
    place = np.arange(ids.shape[1])
    last = np.where(place >= size[:, None], 2, by == 0)
    key = np.where(there[:, None], np.where(last > 0, 0.0, -(dot / by)), place)
    last = np.where(there[:, None], last, 0)
    return np.take_along_axis(ids, np.lexsort((key, last), axis=-1), 1)


def fold(f: Fold, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The representation of contexts and whether there is one. ids: (contexts, steps, places) numbers of vectors; size: (contexts, steps), how many of the places hold one."""
    ids = ids.copy()
    for t in range(ids.shape[1]):
        if f.forward and t:
            ids[:, t] = _rank(f, ids[:, t], size[:, t], *_center(f, ids[:, :t], size[:, :t]))
        if f.backward and t:
            head = _center(f, ids[:, t : t + 1], size[:, t : t + 1])
            for u in range(t):
                ids[:, u] = _rank(f, ids[:, u], size[:, u], *head)
    return _center(f, ids, size)


def _places(group: np.ndarray) -> np.ndarray:
    """Place of each entry within its group; equal groups are next to each other."""
    at = np.arange(len(group))
    return at - np.maximum.accumulate(np.where(np.r_[True, group[1:] != group[:-1]], at, 0)) if len(group) else at


def _means(rows: np.ndarray, vectors: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The mean of the vectors of each of n rows, summed in their order, and whether there is one."""
    total, place = np.zeros((n, vectors.shape[1])), _places(rows)
    for p in range(place.max(initial=-1) + 1):
        total[rows[place == p]] += vectors[place == p]
    count = np.bincount(rows, minlength=n)
    return total / np.maximum(count, 1)[:, None], count > 0


def _codes(names: pa.Array) -> tuple[np.ndarray, int]:
    """Numbers of strings, in their order, and how many there are."""
    coded = names.dictionary_encode()
    known, code = np.unique(np.array(coded.dictionary.to_pylist(), object), return_inverse=True)
    return code[coded.indices.to_numpy(zero_copy_only=False)].astype(np.int64) if len(known) else np.zeros(0, np.int64), max(len(known), 1)


def item_vectors(f: Fold, words: pa.ListArray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Both vectors (lc, ac) of items, each with whether it is there, of arrays of structs (step, rel, id, counts, lists) by step; see `representation.known_rows`."""
    n, row = len(words), pc.list_parent_indices(words).to_numpy().astype(np.int64)
    _, rel, at, counts, lists = words.flatten().flatten()
    (code, kinds), use = _codes(rel), np.flatnonzero(counts.to_numpy(zero_copy_only=False))
    first, which = np.unique(row[use] * kinds + code[use], return_index=True)  # of several words in a relation the first
    lc = _means(first // kinds, f.vectors[at.to_numpy()[use[which]]], n)

    of_list = row[pc.list_parent_indices(lists).to_numpy()]
    box, ids = lists.flatten().flatten()
    code, kinds = _codes(box)
    context, order = of_list * kinds + code, np.argsort(of_list * kinds + code, kind="stable")
    keys, number = np.unique(context[order], return_inverse=True)
    size, flat = pc.list_value_length(ids).to_numpy().astype(np.int64), ids.flatten().to_numpy()
    begin, place = (np.cumsum(size) - size)[order], _places(number)
    size = size[order]
    table, sizes = np.zeros((len(keys), place.max(initial=0) + 1, size.max(initial=1)), np.int32), np.zeros((len(keys), place.max(initial=0) + 1), np.int64)
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    table[np.repeat(number, size), np.repeat(place, size), within] = flat[np.repeat(begin, size) + within]
    sizes[number, place] = size
    parts = [fold(f, table[i : i + CHUNK], sizes[i : i + CHUNK]) for i in range(0, len(keys), CHUNK)]
    vectors, there = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros((0, f.vectors.shape[1])), np.zeros(0, bool))
    return lc, _means((keys // kinds)[there], vectors[there], n)


def _column(vectors: np.ndarray, there: np.ndarray) -> pa.ListArray:
    offsets = np.r_[0, np.cumsum(there * vectors.shape[1])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(vectors[there].ravel()), mask=pa.array(~there))


def vectors_of(f: Fold, columns: dict[str, tuple[str | None, str | None]]):
    """For `mapInArrow`: each of `columns` in place of its array of words becomes the vectors (lc, ac) under the given names; without a name a vector is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(all="ignore"):
            for b in batches:
                out = {c: b.column(c) for c in b.schema.names if c not in columns}
                for c, names in columns.items():
                    out |= {name: _column(*x) for name, x in zip(names, item_vectors(f, b.column(c))) if name}
                yield pa.RecordBatch.from_arrays([*out.values()], names=[*out])

    return run
