"""Connected components of a table of links, without collecting any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _signature(links: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    return tuple(links.agg(F.count("*"), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 31)))).first())


def components(links: DataFrame) -> DataFrame:
    """(a, b) for every value of the long columns a, b that isn't the smallest of its component; b is that smallest.

    Alternating large-star and small-star rounds; each round is an aggregate and a join on node values and ends in a
    checkpoint. Null values and loops are ignored, repeated links count once; an empty table gives an empty one.
    """
    now = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while (sign := _signature(now)) != before:
        before = sign
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        now = cut(small.where("a <> b").distinct())
    return now
