"""Queries that fit and apply models, and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compact, program
from ..operators.graph import cut
from ..operators.metrics import lightweight_fidelity
from ..sources.fixtures import event_edges
from ..streaming.streams import drain, event_stream, windowed_counts
from .registry import query
from .tokenizer import GraphTokenizer

#: A small model: a few rules of each kind. The tokenizer's defaults learn up to 384 rules of a kind at a job each: 326 s for one query at sf0.01.
SMALL = {"compact": {"max_macros": 4, "max_macro_len": 6, "max_merges": 6}, "motif": {"most_structural": 2, "structural_len": 6, "most_schemas": 32}, "program": {"block_size": 64}}


@query()
def roundtrip_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each graph in six modes, with tokens, bits and whether the original program comes back."""
    e = cut(event_edges(spark, sf_dir))
    return GraphTokenizer(SMALL).fit(e).encode(e).select("graph_id", "mode", "bits", "bits_per_edge", "original_token_count", "token_count", "lossless_expand_match")


@query()
def reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural metrics of each graph after encoding and decoding in the compact mode."""
    e = cut(event_edges(spark, sf_dir))
    out = GraphTokenizer({**SMALL, "patch": {"sparse_edge_patches": True, "sparse_density": 1.0, "sparse_clustering": 1.0}}).fit(e).evaluate(e, "compact")
    return out.select("graph_id", "mode", "edge_f1", "strict_exact_reconstruction", "exact_reconstruction", "degree_l1", "spectrum_distance", "motif_f1")


@query()
def decoded_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs against what their edge-cover programs build, by relational metrics."""
    e = cut(event_edges(spark, sf_dir))
    codes = spark.createDataFrame([(0, 2, [[0, 1]])], "code int, n int, edges array<array<int>>")
    back = cut(program.decode(program.compile_edge_cover(e), codes))
    return lightweight_fidelity(e, back).select("graph_id", "same_counts", "same_degree_sequence", "wl_match", "component_error", "triangles_error")


@query()
def macro_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first macros of the grouped programs."""
    rows = program.sequences(program.compile_edge_cover(event_edges(spark, sf_dir))).withColumnRenamed("graph_id", "seq_id")
    rules, _ = compact.learn_macros(compact.over_arrays(rows, compact.base_compact), 4, 3, 6)
    return spark.createDataFrame([(k, " ".join(v)) for k, v in rules.items()], "token string, parts string")


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by day from a stream over the events."""
    out = drain(windowed_counts(event_stream(spark, sf_dir), "event_type"), "graphlex_stream_counts")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")
