"""Conflict-constrained best-fit packing of documents into sequences of a fixed number of tokens.

Tokens are UTF-8 bytes plus one separator at the end of each document (the byte-level model), or the caller's own count.
A document longer than a sequence is cut; its full pieces fill sequences alone and only the rest is packed. Documents are dealt
into parts by a hash, about `rows_per_part` each whatever the corpus' size, and each part is packed by itself: longest first,
open bins in order of their free room, each with a bitmap of the sources and one of the duplicate clusters it holds. The
search starts at the smallest room that suffices and goes on to its successors until a bin holds neither the document's
source nor its cluster. So no sequence mixes two documents of one source or two copies.

Clusters are equal texts unless the caller names a column. Null sources and null clusters conflict with nothing. Null texts
are empty: one separator. Ties go by id, then cluster, then source; repeated rows are packed one by one, and
where they are many, spread over the parts. Empty tables give
empty results.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, text_of

SCHEMA = "doc_id long, piece long, start long, length long, bin long, offset long"


def pack(items: Iterable[tuple], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) for each of the items (size, source, cluster), which come in packing order."""
    items = list(items)
    source_bit = {x: 1 << k for k, x in enumerate(dict.fromkeys(s for _, s, _ in items if s is not None))}
    copies = Counter(c for *_, c in items if c is not None)
    cluster_bit = {x: 1 << k for k, x in enumerate(x for x, n in copies.items() if n > 1)}  # a text without copies has no conflict
    rooms: list[int] = []  # room << 32 | bin, in order
    sources, clusters, out = [], [], []
    for size, source, cluster in items:
        s, c = source_bit.get(source, 0), cluster_bit.get(cluster, 0)
        k = bisect_left(rooms, size << 32)
        while k < len(rooms) and (sources[b := rooms[k] & 0xFFFFFFFF] & s or clusters[b] & c):
            k += 1
        if k < len(rooms):
            room = rooms.pop(k) >> 32
            sources[b] |= s
            clusters[b] |= c
        else:
            b, room = len(sources), capacity
            sources.append(s)
            clusters.append(c)
        out.append((b, capacity - room))
        if room > size:
            insort(rooms, (room - size) << 32 | b)
    return out


def _packer(capacity: int) -> Callable:
    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.assign(rest=own["n"] % capacity).sort_values(["rest", "doc_id", "cluster", "source", "n"], ascending=[False, True, True, True, True], kind="stable")
        none = lambda v: None if pd.isna(v) else v
        rows, bins = [], 0
        left = own[own["rest"] > 0]
        places = pack(zip(left["rest"].tolist(), map(none, left["source"]), map(none, left["cluster"]), strict=True), capacity)
        part = int(own["part"].iloc[0]) << 32
        bins = max((b for b, _ in places), default=-1) + 1
        for i, n, (b, offset) in zip(left["doc_id"], left["n"].tolist(), places, strict=True):
            rows.append((i, n // capacity, n - n % capacity, n % capacity, part | b, offset))
        for i, n in zip(own["doc_id"], own["n"].tolist(), strict=True):
            for piece in range(n // capacity):
                rows.append((i, piece, piece * capacity, capacity, part | bins, 0))
                bins += 1
        out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "bin", "offset"])
        return out.astype({"doc_id": "Int64"})

    return run


def best_fit(docs: DataFrame, capacity: int = 8192, n_tokens: Column | None = None, cluster: Column | None = None, rows_per_part: int = 8192) -> DataFrame:
    """A row for each piece: the document, the piece's number, its first token and length, its bin, and its place in the bin."""
    text = text_of(docs)
    n = F.octet_length(text) + 1 if n_tokens is None else n_tokens
    same = F.xxhash64(text) if cluster is None else cluster
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), same.alias("cluster"), n.cast("long").alias("n"), F.monotonically_increasing_id().alias("row"))
    thin = cut(thin.where("n > 0"))  # numbers and sources only; fixes the rows' numbers
    parts = max(1, -(-thin.count() // rows_per_part))
    key = ("doc_id", "cluster", "n")
    often = thin.groupBy(*key).count().where(F.col("count") > max(1, rows_per_part // 16)).select(*[F.col(c).alias(f"{c}_") for c in key])
    dealt = thin.join(often, [thin[c].eqNullSafe(often[f"{c}_"]) for c in key], "left")
    salt = F.when(F.col("n_").isNotNull(), F.col("row"))  # rows that repeat often go to all parts, others by what they hold
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64(*key, salt), F.lit(parts))).drop(*[f"{c}_" for c in key], "row")
    return dealt.groupBy("part").applyInPandas(_packer(capacity), SCHEMA)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(table(spark, sf_dir, "documents"))
