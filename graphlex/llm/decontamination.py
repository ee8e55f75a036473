"""Benchmark decontamination by spaced-seed hashing.

A fixed mask selects some positions of a short span of tokens and ignores the others, so that a span still matches when
tokens at ignored positions were substituted. The masked tokens at every position of every text are hashed and joined with
those of the benchmark items; the texts are compared token by token on each hit's diagonal, and a pair stays if some run of `min_words`
tokens or more (or the whole item, if that is shorter) on it agrees in 80 % of its tokens. Items of SHORT tokens or fewer get
masks of their own that hit whenever 80 % of the whole item agree; an overlap with a longer item needs a hit of MASKS.

The benchmark is the query set: it is read in blocks of at most `block_tokens` tokens, and each block's hash table is
broadcast and joined on the map side, so documents are not shuffled and no table grows beyond the block.

A token is a lower-cased word without ASCII punctuation. Items with fewer than `shortest` tokens match nothing. Null and
empty texts match nothing. Items with equal ids are separate rows but give one result row per id and document row: that of the
longest overlap, and of equal ones the earliest. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import received, share, small_batches, table

#: Selected positions of each mask.
MASKS = ((0, 1, 2, 3, 4, 5), (0, 1, 3, 4, 7, 8), (0, 2, 3, 6, 8, 9), (0, 1, 4, 6, 9, 10))
SIMILARITY = 0.8
#: Longest item, in tokens, with masks of its own: at most two substitutions.
SHORT = 14
SCHEMA = "doc_id long, item_id long, n_overlap long, n_equal long, start long, item_start long"
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_PUNCTUATION = string.punctuation.encode()


def tokens(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(None, _PUNCTUATION).split()


def seeds(ids: np.ndarray, mask: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the mask at each position where all selected tokens are known (not 0)."""
    n = len(ids) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    known = ids > 0
    ok = np.ones(n, bool)
    for o in mask:
        ok &= known[o : o + n]
    at = np.flatnonzero(ok)
    h = np.full(len(at), sum(1 << o for o in mask), np.uint64)
    for k, o in enumerate(mask):
        h = (h ^ ids[at + o].astype(np.uint64)) * _MIX[k % 6]
        h ^= h >> np.uint64(29)
    return at, h


def before(at: np.ndarray, h: np.ndarray, none: int) -> np.ndarray:
    """The hash at the position just before each, `none` where there is none."""
    out = np.full(len(h), none, np.uint64)
    next_to = np.flatnonzero(at[1:] == at[:-1] + 1)
    out[next_to + 1] = h[next_to]
    return out


def short_masks(n: int) -> set[tuple]:
    """Masks of an item of n tokens, SHORT at most: of five parts as many are left out as tokens may differ, so one mask misses every difference."""
    parts = [tuple(map(int, x)) for x in np.array_split(np.arange(n), 5)]
    return {sum(kept, ()) for kept in combinations(parts, 5 - n // 5)}


def longest_similar(equal: np.ndarray, at: int | np.ndarray) -> tuple[int, int]:
    """[start, end) of the longest run through position `at` (or one of several, sorted) in which the share of equal tokens is SIMILARITY or more; the earliest of equals."""
    at = np.atleast_1d(at)
    total = np.concatenate(([0], np.cumsum(np.where(equal, 1, -4))))  # equal at both ends of a run of 80 %
    peak = np.maximum.accumulate(total[::-1])[::-1]  # the highest total from there on
    start = np.arange(at[-1] + 1)
    end = np.searchsorted(-peak, -total[start], side="right") - 1  # the last end that keeps the sum at 0 or more
    length = np.where(end > at[np.searchsorted(at, start)], end - start, 0)
    s = int(np.argmax(length))
    return (s, s + int(length[s])) if length[s] else (int(at[0]), int(at[0]))


class Block:
    """The seeds of some benchmark items."""

    def __init__(self, items: list[tuple[int, list[bytes]]], min_words: int, shortest: int):
        self.min_words = min_words
        self.vocab: dict[bytes, int] = {}
        self.items = [(i, np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words], np.int64)) for i, words in items if len(words) >= shortest]
        own: dict[tuple, set[int]] = {}
        for n in {len(x) for _, x in self.items if len(x) <= SHORT}:
            for mask in short_masks(n):
                own.setdefault(mask, set()).add(n)
        self.masks = (*MASKS, *sorted(set(own) - set(MASKS)))
        at: list = []
        for mask in self.masks:
            for j, (_, x) in enumerate(self.items):
                if mask in MASKS or len(x) in own[mask]:
                    p, h = seeds(x, mask)
                    at.append((h, np.full(len(p), j, np.int64), p, before(p, h, 0)))
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        h, item, p, q = (np.concatenate(c) for c in zip(*at, strict=True)) if at else none
        order = np.argsort(h, kind="stable")
        self.hashes, self.item, self.at, self.before = h[order], item[order], p[order], q[order]

    def search(self, text: str | None, one: bool = False) -> list[tuple]:
        """(item_id, n_overlap, n_equal, start, item_start), one for each item found, or (one) just the first found.

        A hit is looked at if the seeds just before it do not hit as well: the first of each run on a diagonal. So repetitive texts
        and items give as many diagonals as they have tokens, not as many hits as the product of their lengths.
        """
        words = tokens(text)
        ids = np.fromiter(map(self.vocab.get, words, repeat(0)), np.int64, len(words))
        hits: set[tuple] = set()
        for mask in self.masks:
            p, h = seeds(ids, mask)
            lo, hi = np.searchsorted(self.hashes, h), np.searchsorted(self.hashes, h, side="right")
            q = before(p, h, 1)
            for k in np.flatnonzero(hi > lo):
                r = lo[k] + np.flatnonzero(self.before[lo[k] : hi[k]] != q[k])
                hits.update(zip(self.item[r].tolist(), (p[k] - self.at[r]).tolist(), strict=True))
        found: dict = {}
        whole: set[int] = set()
        for j, diagonal in sorted(hits):
            i, x = self.items[j]
            if j in whole:  # no later diagonal of the item is longer or earlier
                continue
            first, last = max(0, -diagonal), min(len(x), len(ids) - diagonal)
            equal = x[first:last] == ids[first + diagonal : last + diagonal]
            s, e = longest_similar(equal, np.arange(len(equal)))
            if e - s >= min(self.min_words, len(x)):
                row = (e - s, -(s + first + diagonal), -(s + first), int(equal[s:e].sum()))
                found[i] = max(found.get(i, row), row)
                if one:
                    break
                if e - s == len(x):
                    whole.add(j)
        return [(i, n, same, -start, -item_start) for i, (n, start, item_start, same) in sorted(found.items())]


def blocks(benchmark: DataFrame, min_words: int, shortest: int, block_tokens: int) -> Iterator[Block]:
    items, size = [], 0
    for r in benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator():
        words = tokens(r.text)
        if items and size + len(words) > block_tokens:
            yield Block(items, min_words, shortest)
            items, size = [], 0
        items.append((r.item_id, words))
        size += len(words)
    if items:
        yield Block(items, min_words, shortest)


def _searcher(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = received(shared)
        for batch in batches:
            rows = [(i.as_py(), *found) for i, text in zip(*batch.columns, strict=True) for found in block.search(text.as_py())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "item_id", "n_overlap", "n_equal", "start", "item_start"])

    return run


def _dropper(shared, column: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = received(shared)
        for batch in batches:
            yield batch.filter(pa.array([not block.search(x.as_py(), one=True) for x in batch.column(column)], pa.bool_()))

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, min_words: int = 13, shortest: int = 5, block_tokens: int = 1_000_000) -> DataFrame:
    """A row for each document row and item that overlap: ids, words of the overlap, equal ones, and where it starts in both (in tokens)."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    out = spark.createDataFrame([], SCHEMA)
    for block in blocks(benchmark, min_words, shortest, block_tokens):
        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_searcher(share(spark, block)), SCHEMA)
        out = out.unionAll(found)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, min_words: int = 13, shortest: int = 5, block_tokens: int = 1_000_000) -> DataFrame:
    """The rows of docs, unchanged, that overlap with no item."""
    small_batches(docs.sparkSession)
    for block in blocks(benchmark, min_words, shortest, block_tokens):
        docs = docs.mapInArrow(_dropper(share(docs.sparkSession, block), docs.columns.index("text")), docs.schema)
    return docs


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
