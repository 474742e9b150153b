"""Encoding with a public byte-level BPE vocabulary, by batched merge rounds."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Fixed value: the pattern that cuts a text into words before any merge.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Where the vocabulary lies on every machine, unless a query is given another place.
VOCABULARY = os.environ.get("EVENTWEAVE_BPE", "/opt/tokenizers/byte_bpe_50k.json")
#: Words whose ids a worker keeps, at about 200 bytes each, words of at most KEPT_LENGTH bytes; texts are handled in blocks of about BLOCK characters.
KEPT_WORDS, KEPT_LENGTH, BLOCK = 200_000, 64, 4_000_000
NONE = np.int64(1) << 40
IDS = T.ArrayType(T.IntegerType(), False)


def byte_names() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary file: itself if printable, else the next free one from 256 on."""
    printable = {b for lo, hi in ((33, 126), (161, 172), (174, 255)) for b in range(lo, hi + 1)}
    hidden = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Merger:
    """The merges as sorted pair keys: key = left id * number of ids + right id; rank and result lie at the key's place."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.n_ids = max(vocab.values()) + 1
        self.byte_id = np.zeros(256, np.int64)
        for b, name in byte_names().items():
            self.byte_id[b] = vocab[name]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, whole = (np.fromiter(x, np.int64, len(pairs)) for x in ((vocab[a] for a, _ in pairs), (vocab[b] for _, b in pairs), (vocab[a + b] for a, b in pairs)))
        keys = left * self.n_ids + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.whole = keys[order], order.astype(np.int64), whole[order]
        self.words = regex.compile(PATTERN)
        self.known: dict[str, np.ndarray] = {}

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (NONE if it doesn't merge) and its place among the keys."""
        key = left * self.n_ids + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NONE), at

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word. The symbols of all words lie in one array; a round merges in every word its lowest-ranked pair, wherever it stands."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        symbol = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), length)
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(words)
        rank, at = self._ranks(symbol, word)
        while len(symbol):
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, start)
            size = np.diff(np.r_[start, len(symbol)])
            ready = best == NONE
            if ready.any():  # words that are done leave the array
                for s, n in zip(start[ready], size[ready]):
                    out[word[s]] = symbol[s : s + n].astype(np.int32)
                stay = np.repeat(~ready, size)
                symbol, word, rank, at = symbol[stay], word[stay], rank[stay], at[stay]
                best, size = best[~ready], size[~ready]
                if not len(symbol):
                    break
            hit = rank == np.repeat(best, size)
            # of a run of overlapping pairs (a a a) every second one merges, from the left
            place = np.flatnonzero(hit)
            run = np.cumsum(np.r_[True, (np.diff(place) > 1) | (word[place[1:]] != word[place[:-1]])]) - 1
            first = place[np.r_[True, np.diff(run) > 0]]
            place = place[(place - first[run]) % 2 == 0]
            symbol[place] = self.whole[at[place]]
            stay = np.ones(len(symbol), bool)
            stay[place + 1] = False
            touched = np.zeros(len(symbol), bool)  # only pairs beside a merge have a new rank
            touched[place] = True
            touched[np.maximum(place - 1, 0)] = True
            symbol, word, rank, at, touched = symbol[stay], word[stay], rank[stay], at[stay], touched[stay]
            self._refresh(symbol, word, rank, at, touched)
        return out

    def _ranks(self, symbol: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, at = np.full(len(symbol), NONE), np.zeros(len(symbol), np.int64)
        if len(symbol):
            self._refresh(symbol, word, rank, at, np.ones(len(symbol), bool))
        return rank, at

    def _refresh(self, symbol: np.ndarray, word: np.ndarray, rank: np.ndarray, at: np.ndarray, touched: np.ndarray) -> None:
        i = np.flatnonzero(touched)
        rank[i] = NONE
        i = i[i + 1 < len(symbol)]
        i = i[word[i] == word[i + 1]]
        rank[i], at[i] = self.find(symbol[i], symbol[i + 1])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, end of each text in it)."""
        seen: dict[str, int] = {}
        number = []
        counts = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            if text:
                found = self.words.findall(text)
                counts[k] = len(found)
                number.extend([seen.setdefault(w, len(seen)) for w in found])
        ids: list[np.ndarray | None] = [self.known.get(w) for w in seen]
        new = [w for w, x in zip(seen, ids) if x is None]
        merged = iter(self.merge([w.encode() for w in new]))
        if len(self.known) + len(new) > KEPT_WORDS:
            self.known.clear()
        for i, w in enumerate(seen):
            if ids[i] is None:
                ids[i] = x = next(merged)
                if len(w) <= KEPT_LENGTH and len(self.known) < KEPT_WORDS:
                    self.known[w] = x
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
        begin = np.r_[0, np.cumsum(size)[:-1]] if ids else np.empty(0, np.int64)
        number = np.asarray(number, np.int64)
        each = size[number]
        total = np.r_[0, np.cumsum(each)]
        take = np.repeat(begin[number] - total[:-1], each) + np.arange(total[-1])
        return flat[take] if len(flat) else flat, total[np.cumsum(counts)] if len(counts) else np.empty(0, np.int64)


_mergers: dict[str, Merger] = {}


def merger(path: str) -> Merger:
    if path not in _mergers:
        _mergers[path] = Merger(path)
    return _mergers[path]


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    begin = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= BLOCK:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def _encoder(path: str, counts_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = merger(path)
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            for lo, hi in _blocks(texts):
                flat, ends = own.encode(texts[lo:hi])
                offsets = np.r_[0, ends].astype(np.int32)
                last = pa.array(np.diff(offsets).astype(np.int32)) if counts_only else pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
                kept = [b.column(i).slice(lo, hi - lo) for i in range(b.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, last], names=[*b.schema.names[:-1], "n_tokens" if counts_only else "ids"])

    return run


def encode(df: DataFrame, keep: list[str], text: str = "text", path: str = VOCABULARY, counts_only: bool = False) -> DataFrame:
    """(*keep, ids) of every row, or (*keep, n_tokens): the text as ids of the vocabulary at `path`, without special tokens; their strings are ordinary text.

    A null or empty text has an empty list (0 tokens). One narrow stage: rows aren't moved, repeated texts and rows come out as often as they are there.
    Text is never cut; only a text's own words are merged, so its memory is that of one text. Columns named like the result must not be in `keep`.
    """
    last = T.StructField("n_tokens", T.IntegerType()) if counts_only else T.StructField("ids", IDS)
    schema = T.StructType([*(df.schema[c] for c in keep), last])
    return df.select(*[df[c] for c in keep], df[text].alias("__text")).mapInArrow(_encoder(path, counts_only), schema)


def token_counts(df: DataFrame, keep: list[str], text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(*keep, n_tokens): as `encode`, without the ids."""
    return encode(df, keep, text, path, counts_only=True)
