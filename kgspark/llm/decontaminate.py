"""Benchmark decontamination by greedy string tiling.

Words are letters, digits and what is neither white space nor ASCII punctuation, small. Every run of MIN_TILE words of a
benchmark item is a seed (an item with fewer words is one seed); documents and items that share seeds are joined by
binary search over the sorted seed hashes. For the pairs whose shared seeds cover enough of the item, tiles are marked:
the longest matches of unmarked words, found by Karp-Rabin hashes of a falling length, first; none overlap. A document is
contaminated by an item if tiles cover COVERAGE of the item's words, in whatever order they stand.

The benchmark is sent to all tasks in blocks of at most BLOCK_BYTES, one block after another; documents are never shuffled.
Null or empty texts and items without a word share nothing. Null ids stay, repeated rows each give their rows, an item
that occurs twice under two ids is reported under both, an item row that is repeated once, and other columns are not read.
Empty tables: no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import id_text, ngram_hashes, slices, word_hashes

MIN_TILE, COVERAGE, BLOCK_BYTES = 5, 0.5, 16 << 20
_PUNCTUATION = bytes(c for c in range(128) if not chr(c).isalnum())
_SPACES = bytes.maketrans(_PUNCTUATION, b" " * len(_PUNCTUATION))
PAIRS = "doc_id long, item_id long, coverage double, n_words int, tiles array<struct<doc_start:int,item_start:int,words:int>>"


def normal(text: str | None) -> bytes:
    return (text or "").lower().encode().translate(_SPACES)


def scan(p: np.ndarray, t: np.ndarray, free_p: np.ndarray, free_t: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """All (words, start in p, start in t) of maximal matches of at least `length` unmarked words, by Karp-Rabin hashes."""
    if min(len(p), len(t)) < length:
        return []

    def whole(free: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.convolve(free.astype(np.int64), np.ones(length, np.int64), "valid") == length)

    at_p, at_t = whole(free_p), whole(free_t)
    hash_p, hash_t = ngram_hashes(p, length)[at_p], ngram_hashes(t, length)[at_t]
    order = np.argsort(hash_t, kind="stable")
    low, high = np.searchsorted(hash_t[order], hash_p, "left"), np.searchsorted(hash_t[order], hash_p, "right")
    found = []
    for i, a, b in zip(at_p.tolist(), low.tolist(), high.tolist(), strict=True):
        for j in at_t[order[a:b]].tolist():
            if i and j and free_p[i - 1] and free_t[j - 1] and p[i - 1] == t[j - 1]:
                continue  # part of the match that starts before
            n = length if (p[i : i + length] == t[j : j + length]).all() else 0
            while n and i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n] and free_p[i + n] and free_t[j + n]:
                n += 1
            if n:
                found.append((n, i, j))
    return found


def free_runs(free_p: np.ndarray, free_t: np.ndarray, n: int, i: int, j: int) -> list[tuple[int, int, int]]:
    """What is left unmarked of a match of n words, as (words, start in p, start in t)."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], free_p[i : i + n] & free_t[j : j + n], [False])).astype(np.int8)))
    return [(b - a, i + a, j + a) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]


def tiling(p: np.ndarray, t: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiles (words, start in p, start in t) of an item's word hashes p in a text's t.

    Exactly those of the greedy rule: the longest match of unmarked words first, of equal ones the first in p, then in t. Each
    round's Karp-Rabin search finds all matches of its length or more; what a tile leaves of one comes back among the others.
    """
    free_p, free_t, tiles = np.ones(len(p), bool), np.ones(len(t), bool), []
    length = max(least, len(p))
    while True:
        found = [(-n, i, j) for n, i, j in scan(p, t, free_p, free_t, length)]
        heapq.heapify(found)
        while found:
            n, i, j = heapq.heappop(found)
            left = free_runs(free_p, free_t, -n, i, j)
            if left == [(-n, i, j)]:
                free_p[i : i - n] = free_t[j : j - n] = False
                tiles.append((-n, i, j))
            else:
                for m, a, b in left:
                    if m >= length:
                        heapq.heappush(found, (-m, a, b))
        if length == least:
            return sorted(tiles, key=lambda m: m[1])
        length = max(least, length * 2 // 3)


class Benchmark:
    """The items' word hashes and the sorted hashes of their seeds."""

    def __init__(self, items: list[tuple[int | None, str | None]], least: int = MIN_TILE):
        self.ids, self.least = [i for i, _ in items], least
        words, at = word_hashes([normal(t) for _, t in items])
        self.words = [words[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in {min(least, len(w)) for w in self.words if len(w)}:
            keys, item, place = [], [], []
            for k, w in enumerate(self.words):
                if min(least, len(w)) == n:
                    g = ngram_hashes(w, n)
                    keys.append(g), item.append(np.full(len(g), k)), place.append(np.arange(len(g)))
            keys, item, place = map(np.concatenate, (keys, item, place))
            order = np.argsort(keys, kind="stable")
            self.seeds[n] = keys[order], item[order], place[order]

    def pairs(self, texts: list[str | None], coverage: float) -> Iterator[tuple[int, int, float, list[tuple[int, int, int]]]]:
        """(text number, item number, coverage, tiles) of the contaminated texts."""
        words, at = word_hashes([normal(t) for t in texts])
        for n, (keys, item, place) in self.seeds.items():
            grams = ngram_hashes(words, n)
            low = np.searchsorted(keys, grams, "left")
            hit = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == grams)
            doc = np.searchsorted(at, hit, "right") - 1
            inside = hit + n <= at[doc + 1]
            hit, doc = hit[inside], doc[inside]
            low, many = low[hit], np.searchsorted(keys, grams[hit], "right") - low[hit]
            seed = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
            hit, doc = np.repeat(hit, many), np.repeat(doc, many)
            key = doc * len(self.words) + item[seed]
            order = np.argsort(key, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(key[order])) + 1) if len(order) else []:
                d, k = int(doc[rows[0]]), int(item[seed[rows[0]]])
                p, covered = self.words[k], np.zeros(len(self.words[k]), bool)
                covered[(np.unique(place[seed[rows]])[:, None] + np.arange(n)).ravel()] = True
                if covered.sum() < coverage * len(p):
                    continue  # tiles cover no more than shared seeds do
                there = np.unique(hit[rows][:, None] + np.arange(n))  # the text's words in shared seeds
                gap = np.flatnonzero(np.diff(there) > 1) + 1
                t, origin = np.insert(words[there], gap, np.uint64(0)), np.insert(there - at[d], gap, -1)
                tiles = [(m, i, int(origin[j])) for m, i, j in tiling(p, t, n)]
                share = sum(m for m, _, _ in tiles) / len(p)
                if share >= coverage:
                    yield d, k, share, tiles


def blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> Iterator[Benchmark]:
    """The benchmark in blocks of at most BLOCK_BYTES (of one item where it is longer)."""
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("t IS NOT NULL").distinct()
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = 1 + total * 2 // BLOCK_BYTES
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect() if n > 1 else items.collect()
        if rows:
            yield Benchmark([(r[0], r[1]) for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))])


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """PAIRS: the contaminated documents, the items, the share of the item's words, how many it has, and the tiles."""
    out = None
    for block in blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            kinds = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("n_words", pa.int32()), ("tiles", pa.list_(pa.struct([("doc_start", pa.int32()), ("item_start", pa.int32()), ("words", pa.int32())])))])
            for part in slices(batches, 1):
                ids, block = part.column(0).to_pylist(), sent.value
                rows = [{"doc_id": ids[d], "item_id": block.ids[k], "coverage": share, "n_words": len(block.words[k]), "tiles": [{"doc_start": j, "item_start": i, "words": m} for m, i, j in tiles]} for d, k, share, tiles in block.pairs(part.column(1).to_pylist(), coverage)]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kinds)

        found = id_text(docs, "doc_id", "text").mapInArrow(run, PAIRS)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], PAIRS)


def leak_test(sent: Broadcast[Benchmark], coverage: float) -> Callable:
    """A column function: whether a text is contaminated by an item of the block."""

    def leaks(texts: pd.Series) -> pd.Series:
        out = np.zeros(len(texts), bool)
        part = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts.where(texts.notna(), None), pa.string())], ["n", "text"])
        for some in slices(iter([part]), 1):
            for d, *_ in sent.value.pairs(some.column(1).to_pylist(), coverage):
                out[some.column(0)[d].as_py()] = True
        return pd.Series(out)

    return F.pandas_udf(leaks, "boolean")


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, text_col: str = "text") -> DataFrame:
    """docs without the contaminated ones, all columns as they came."""
    for block in blocks(benchmark):
        docs = docs.where(~leak_test(docs.sparkSession.sparkContext.broadcast(block), coverage)(F.col(text_col)))
    return docs
