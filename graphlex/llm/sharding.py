"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly; equal texts stay together.

Groups of equal texts are hashed into a fixed number of cells, so that what the driver places is bounded whatever the corpus'
size; a group that alone is large against a shard is a cell of its own, and one that no shard could balance is split into
pieces. Cells are placed largest first, each into the shard where the dot product of its share of bytes, tokens and rows with
the shard's free capacity is highest. Only numbers are shuffled, never texts.

Law `bytes`: the shards' sizes are near equal. Null texts are empty (size 1). Ties go by id, then text, then place in the input. Rows with equal ids
and texts each have a slot; pieces of a large group are dealt by row, so they are near equal whatever its ids. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, table, text_of

DIMENSIONS = ("size", "n_tokens", "n_rows")


def place(cells: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each cell (a row of DIMENSIONS), largest cells first."""
    share = cells / np.maximum(cells.sum(axis=0), 1)
    free = np.full((shards, cells.shape[1]), 1 / shards)
    out = np.zeros(len(cells), np.int64)
    for k in np.lexsort((np.arange(len(cells)), -share.max(axis=1))):
        fits = (free >= share[k]).all(axis=1)
        worth = free @ share[k]
        out[k] = int(np.where(fits, worth, worth - 10).argmax())
        free[out[k]] -= share[k]
    return out


def shard(docs: DataFrame, shards: int = 16, cells: int = 8192, split_above: float = 0.5) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs (doc_id, text).

    split_above: the share of a shard's capacity from which a group of equal texts is cut into pieces.
    """
    spark = docs.sparkSession
    text = text_of(docs)
    thin = cut(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.xxhash64(text).alias("same"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_tokens"),
            F.monotonically_increasing_id().alias("row"),  # fixed by the checkpoint
        )
    ).withColumn("cell", F.pmod("same", F.lit(cells)))
    sums = [F.sum("size").alias("size"), F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_rows")]
    first = thin.groupBy("cell").agg(*sums).collect()  # `cells` rows
    total = np.maximum(np.array([[r[d] for d in DIMENSIONS] for r in first], float).reshape(-1, 3).sum(axis=0), 1)
    limit = total * split_above / shards
    heavy = [r.cell for r in first if any(r[d] > x for d, x in zip(DIMENSIONS, limit, strict=True))]
    large = []
    if heavy:  # at most 3 * shards / split_above cells, and as many groups
        over = F.greatest(*[F.col(d) / float(x) for d, x in zip(DIMENSIONS, limit, strict=True)])
        groups = thin.where(F.col("cell").isin(heavy)).groupBy("same", "text_crc32", F.col("size").alias("own")).agg(*sums).withColumn("over", over).where("over > 1")
        large = [(r.same, r.text_crc32, r.own, cells + 4096 * k, int(np.ceil(r.over)) * 2) for k, r in enumerate(groups.orderBy("same", "text_crc32", "own").collect())]
    if large:
        pieces = F.broadcast(spark.createDataFrame(large, "same long, text_crc32 long, size long, base long, n_pieces long"))
        own = F.when(F.col("base").isNotNull(), F.col("base") + F.pmod(F.xxhash64("row"), F.col("n_pieces"))).otherwise(F.col("cell"))
        thin = thin.join(pieces, ["same", "text_crc32", "size"], "left").withColumn("cell", own)
    rows = sorted(thin.groupBy("cell").agg(*sums).collect())
    at = place(np.array([[r[d] for d in DIMENSIONS] for r in rows], float).reshape(-1, 3), shards)
    offsets, used = [], [0] * shards
    for r, s in zip(rows, at, strict=True):
        offsets.append((r.cell, int(s), used[s]))
        used[s] += r.n_rows
    where = F.broadcast(spark.createDataFrame(offsets, "cell long, shard int, before long"))
    in_cell = F.row_number().over(Window.partitionBy("cell").orderBy("doc_id", "same", "row"))
    return thin.join(where, "cell").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + in_cell - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
