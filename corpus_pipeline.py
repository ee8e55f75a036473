"""The corpus pipeline: five stages, each applying one operator of graphlex.llm to all that the stage before kept.

language_id drops documents whose language the filters do not know; line_dedup takes out lines that are equal or similar to an
earlier line, and documents of which no word is left by that; near_dedup keeps one document of each SimHash component;
decontamination drops documents that overlap with a benchmark item; packing lays out the rest in sequences.

Nulls, empty texts, repeated rows and empty tables are handled as each operator's module says: null and letterless texts go in
the first stage, repeated rows in the third. Extra columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlex.llm import decontamination, language_id, line_dedup, packing, simhash
from graphlex.llm.common import table

#: Texts that the best language's filter knows less well than this are rejected.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_known(docs, language_id.fit(language_id.training_rows(docs)), LEAST_SCORE)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    n_lines, n_removed = (fresh(docs, n) for n in ("n_lines", "n_removed"))
    gone = F.col(n_removed) > 0
    left = line_dedup.dedup_lines(docs, names=(n_lines, n_removed)).where(~gone | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.select(*[F.when(gone, F.char_length("text").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def fresh(docs: DataFrame, name: str) -> str:
    """The name, with as many underscores as no column of docs has it."""
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    return name


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit(docs)


STAGES = [("language_id", language), ("line_dedup", lines), ("near_dedup", near), ("decontamination", clean), ("packing", packed)]
#: SQL has neither filters over n-grams, nor fingerprints, nor best fit: the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
