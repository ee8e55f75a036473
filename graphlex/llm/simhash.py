"""SimHash near duplicates by vantage-point trees.

Every text has a 64-bit fingerprint: the majority of the XXH64 bits (seed 42) of its three-word shingles. Two fingerprints within
3 bits are within 1 bit in their lower or their upper half, so there is a vantage-point tree over each half, fitted on a
bounded sample of distinct fingerprints. A tree cuts the space into shards: an inner node sends fingerprints at distance up to
its radius r to the left and those further away to the right. By the triangle inequality a fingerprint at distance up to r - 1
has no partner on the right; the others on the left also go right, to the shard that they overlap. So any two fingerprints
within 3 bits meet in some shard of a tree, where all 64 bits are compared exactly. The shards' links then give components.

A shard emits a spanning forest, one link for each fingerprint at most, never all pairs. The tree is only a division of
labour: links are the same for any tree. Fingerprints, not documents, are compared, so exact copies cost nothing.

Null and wordless texts have fingerprint zero and are linked like any other. Null ids are never the smallest; a component
with null ids only has component_id null. Rows with equal ids each give a row. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import aside, back, cut, received, share, small_batches, table
from .components import components

SEED = 42
SHINGLE = 3
BLOCK = 1 << 16
#: The bits over which the trees measure distance.
HALVES = (np.uint64(0xFFFFFFFF), np.uint64(0xFFFFFFFF00000000))


def fingerprint(text: str | None) -> int:
    """The fingerprint, unsigned."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and white space \x20 \x09-\x0d only
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)))) if len(words) >= SHINGLE else iter([b" ".join(words)])
    n, ones = 0, np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    while block := [digest(s, SEED) for s in islice(shingles, BLOCK)]:
        bits = np.unpackbits(np.array(block, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        n += len(block)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = np.array([fingerprint(x.as_py()) for x in batch.column(batch.num_columns - 1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp, pa.int64())], names=[*batch.schema.names[:-1], "fp"])


class Tree:
    """A vantage-point tree over the masked bits of fingerprints; `near` is the largest distance there of fingerprints that must meet."""

    def __init__(self, sample: np.ndarray, mask: np.uint64, total: int, near: int, leaf: int, seed: int = 1):
        self.mask, self.near, self.nodes, self.leaves = mask, near, [], 0
        self.root = self._build(sample, total / max(1, len(sample)), leaf, np.random.default_rng(seed), 0)

    def _build(self, own: np.ndarray, weight: float, leaf: int, rng, depth: int) -> int:
        """An inner node's number, or ~number of a leaf."""
        if len(own) * weight > leaf and len(own) >= 16 and depth < 40:
            best = None
            for v in rng.choice(own, min(4, len(own)), replace=False):
                d = np.bitwise_count((own ^ v) & self.mask)
                for r in range(max(0, int(np.median(d)) - 1), int(np.median(d)) + 3):
                    left, right = own[d <= r], own[d > r - self.near]
                    if best is None or max(len(left), len(right)) < max(len(best[2]), len(best[3])):
                        best = (v, r, left, right)
            v, r, left, right = best
            if max(len(left), len(right)) < 0.9 * len(own):
                at = len(self.nodes)
                self.nodes.append(None)
                self.nodes[at] = (np.uint64(v), r, self._build(left, weight, leaf, rng, depth + 1), self._build(right, weight, leaf, rng, depth + 1))
                return at
        self.leaves += 1
        return ~(self.leaves - 1)

    def route(self, fp: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, indexes of the fingerprints that it gets)."""
        todo = [(self.root, np.arange(len(fp)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if node < 0:
                yield ~node, at
                continue
            v, r, left, right = self.nodes[node]
            d = np.bitwise_count((fp[at] ^ v) & self.mask)
            todo += [(left, at[d <= r]), (right, at[d > r - self.near])]


def forest(fp: np.ndarray, near: int, tile: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """For fingerprints with a partner within `near` bits among fp: (fingerprint, smallest of its component), without those smallest."""
    fp = np.unique(fp)
    root = np.arange(len(fp))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for start in range(0, len(fp), tile):
        i, j = np.nonzero(np.bitwise_count(fp[start : start + tile, None] ^ fp[None, start:]) <= near)
        keep = j > i
        if keep.any():
            a, b = root[i[keep] + start], root[j[keep] + start]
            for x, y in np.unique(np.stack([a, b], 1)[a != b], axis=0):
                x, y = find(int(x)), find(int(y))
                root[max(x, y)] = min(x, y)
    while (nxt := root[root] != root).any():
        root[nxt] = root[root[nxt]]
    out = root != np.arange(len(fp))
    return fp[out], fp[root[out]]


def _router(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = received(shared)
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            got = [(leaf * len(trees) + k, at) for k, tree in enumerate(trees) for leaf, at in tree.route(fp)]
            if got:
                leaf = np.concatenate([np.full(len(at), k, np.int64) for k, at in got])
                yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(np.concatenate([fp[at] for _, at in got]).view(np.int64))], names=["leaf", "fp"])

    return run


def shard_links(fp: np.ndarray, mask: np.uint64, near: int, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the fingerprints of one shard; a shard much larger than `leaf` is divided further by a tree fitted on all of it."""
    fp = np.unique(fp)
    if len(fp) <= 2 * leaf:
        return forest(fp, near)
    found = [forest(fp[at], near) for _, at in Tree(fp, mask, len(fp), near // 2, leaf).route(fp)]
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _linker(near: int, leaf: int) -> Callable:
    def run(own: pd.DataFrame) -> pd.DataFrame:
        a, b = shard_links(own["fp"].to_numpy(np.int64).view(np.uint64), HALVES[int(own["leaf"].iloc[0]) % len(HALVES)], near, leaf)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return run


def linked(distinct: DataFrame, near: int = 3, least_sample: int = 1 << 16, most_sample: int = 1 << 22, leaf: int = 16384) -> DataFrame:
    """Links (a, b) that connect all of the distinct fingerprints (column fp) that are within `near` bits, directly or not.

    The trees are fitted on 16 fingerprints for each leaf, between least_sample and most_sample; shards that are too large for that
    bound are divided again where they are compared.
    """
    total = distinct.count()
    sample = min(most_sample, max(least_sample, 16 * total // leaf))
    some = distinct.orderBy(F.xxhash64("fp"), "fp").limit(sample).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)  # bounded: `sample` longs
    trees = share(distinct.sparkSession, [Tree(some, mask, total, near // 2, leaf) for mask in HALVES])
    return distinct.select("fp").mapInArrow(_router(trees), "leaf long, fp long").groupBy("leaf").applyInPandas(_linker(near, leaf), "a long, b long")


def with_components(docs: DataFrame, near: int = 3) -> DataFrame:
    """doc_id, text_hash (xxhash64), fp, root (the component's smallest fingerprint) and component_id for each row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    thin = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(_fingerprints, "doc_id long, text_hash long, fp long"))
    groups = cut(thin.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(linked(groups, near)).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    own = groups.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    # Only fingerprints that have links need a second look; most stand alone.
    least = own.groupBy("root").agg(F.min("first").alias("component_id"))
    return thin.join(own.join(least, "root").select("fp", "root", "component_id"), "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def keep_one(docs: DataFrame, near: int = 3) -> DataFrame:
    """One row of each component, that with the smallest id (of equal ids the smallest text hash); columns as in docs.

    A component with null ids only keeps one of its rows.
    """
    found = with_components(docs, near)
    # Nulls last; not by component_id, which components of rows with equal ids share.
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash"))
    keep = found.groupBy("root").agg(first.alias("k")).select(F.col("k.doc_id").alias("id"), F.col("k.text_hash").alias("hash"))
    key = aside(docs, "doc_id", "text").withColumn("id", F.col("doc_id").cast("long")).withColumn("hash", F.xxhash64("text"))
    kept = key.join(keep, key["id"].eqNullSafe(keep["id"]) & (key["hash"] == keep["hash"]), "left_semi")
    # Rows equal in id and text: the first by a hash of their other columns. The join has brought them together.
    n = F.row_number().over(Window.partitionBy("id", "hash").orderBy(F.xxhash64(F.col("extra").cast("string")), F.col("extra").cast("string")))
    return kept.withColumn("n", n).where("n = 1").select(*[back(c, "doc_id", "text") for c in docs.columns])


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
