"""What the operators of this subpackage share."""

from __future__ import annotations

import pickle
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, in Java's and Python's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(docs: DataFrame, column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(docs[column], F.lit(""))


def aside(docs: DataFrame, *used: str) -> DataFrame:
    """docs with the columns `used` and one more, `extra`, that holds all others, so that their names can't clash with an operator's own."""
    rest = [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns if c not in used]
    return docs.select(*used, (F.struct(*rest) if rest else F.lit(None).cast("string")).alias("extra"))


def back(column: str, *used: str) -> Column:
    """The column again, of a table that aside() has made."""
    return F.col(column) if column in used else F.col("extra").getField(column).alias(column)


def folder(spark: SparkSession) -> str:
    """The shared folder that the session names; where none is named, on a local master only, one of our own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="graphlex-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings, for queries planned meanwhile."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _shuffles_removed(spark: SparkSession):
    """Queries planned meanwhile remove their shuffle files when they end; what they wrote stays."""
    return settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    folder(df.sparkSession)
    with _shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df written as a table to the shared folder and read again: smaller than a checkpoint, and read by column."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    with _shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of whole texts hold 1000 rows, not the default 10000, unless the session sets another number: memory on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def worker_memo() -> dict:
    """A dict that lives as long as the Python worker; functions travel by value, so module globals live for one task only."""
    return sys.__dict__.setdefault("_graphlex_memo", {})


def share(spark: SparkSession, value) -> Broadcast:
    """A broadcast whose classes travel by value as well; received() takes it out on a worker."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(shared: Broadcast):
    return pickle.loads(shared.value)
