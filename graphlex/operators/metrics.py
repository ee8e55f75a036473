"""Metrics: how well graphs come back, what programs cost, and summaries over datasets and modes."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph as G
from .kernels import Undecided, adjacency, component_sets, edge_list, isomorphism, spectrum, triangle_list, wl_digest


def summarize(rows: DataFrame, keys: list[str], mode: str, modes: tuple[str, ...], columns: list[str], failed: str | None = None) -> DataFrame:
    """Means of columns by keys and mode; every mode has a row for each key, with zeros where nothing was measured."""
    spark = rows.sparkSession
    every = rows.select(*keys).distinct().crossJoin(F.broadcast(spark.createDataFrame([(m,) for m in modes], f"{mode} string")))  # a few modes, a fixed list
    own = [F.count("*").alias("graphs"), *[F.avg(F.col(c).try_cast("double")).alias(f"avg_{c}") for c in columns]]
    if failed:
        own.append(F.count(F.when(F.col(failed), 1)).alias("failed_graphs"))
    out = every.join(rows.groupBy(*keys, mode).agg(*own), [*keys, mode], "left")
    return out.fillna(0, [c for c in out.columns if c not in (*keys, mode)])


def lightweight_fidelity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Original edges a against reconstructed edges b, relational only: raw edge scores, equal counts and degree sequences, component error, equal hashes."""
    seq = lambda e, name: G.degrees(e).groupBy("graph_id").agg(F.array_sort(F.collect_list("degree")).alias(f"{name}_degrees"))
    stat = lambda e, name: G.graph_stats(e).select("graph_id", *[F.col(c).alias(f"{name}_{c}") for c in ("n", "e", "components", "triangles", "cycles")])
    wl = lambda e, name: G.wl_hash(e).withColumnRenamed("wl", f"{name}_wl")
    out = G.edge_scores(a, b)
    for e, name in ((a, "a"), (b, "b")):
        for f in (seq, stat, wl):
            out = out.join(f(e, name), "graph_id", "left")
    error = lambda c: (F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) / F.greatest(F.lit(1), F.col(f"a_{c}"))).alias(f"{c}_error")
    same = F.coalesce((F.col("a_n") == F.col("b_n")) & (F.col("a_e") == F.col("b_e")), F.lit(False))
    return out.select(
        "graph_id", "tp", "fp", "fn", "precision", "recall", "f1", same.alias("same_counts"), F.coalesce(F.col("a_degrees") == F.col("b_degrees"), F.lit(False)).alias("same_degree_sequence"),
        F.coalesce(F.col("a_wl") == F.col("b_wl"), F.lit(False)).alias("wl_match"), F.abs(F.col("a_components") - F.col("b_components")).alias("component_error"), *map(error, ("n", "e", "triangles", "cycles")),
    )


def f1_of(tp: float, fp: float, fn: float) -> tuple[float, float, float]:
    p, r = tp / max(1, tp + fp), tp / max(1, tp + fn)
    return p, r, 2 * p * r / max(1e-12, p + r)


def fidelity(a_edges, b_edges, a_nodes: int, b_nodes: int) -> dict[str, float]:
    """All structural metrics of one reconstructed graph b against its original a."""
    a, b = adjacency(a_edges, range(a_nodes)), adjacency(b_edges, range(b_nodes))
    ea, eb = set(edge_list(a)), set(edge_list(b))
    try:
        mapping = isomorphism(b, a)
        exact = 0.0 if mapping is None else 1.0
    except Undecided:
        mapping = exact = None  # neither equal nor different
    if mapping is None:
        key = lambda g: sorted(g, key=lambda v: (-len(g[v]), v))
        mapping = {v: w for v, w in zip(key(b), [*key(a), *range(len(a), len(a) + len(b))], strict=False)}
    aligned = {(min(mapping[u], mapping[v]), max(mapping[u], mapping[v])) for u, v in eb}
    p, r, f = f1_of(len(ea & eb), len(eb - ea), len(ea - eb))
    ap, ar, af = f1_of(len(ea & aligned), len(aligned - ea), len(ea - aligned))
    ca, cb = len(component_sets(a)), len(component_sets(b))
    ta, tb = len(triangle_list(a)), len(triangle_list(b))
    ya, yb = len(ea) - len(a) + ca, len(eb) - len(b) + cb
    ha, hb = (Counter(map(len, g.values())) for g in (a, b))
    stars = [sum(len(x) >= 3 for x in g.values()) for g in (a, b)]
    motifs = list(zip((ta, ya, stars[0]), (tb, yb, stars[1]), strict=True))
    mf = f1_of(sum(map(min, motifs)), sum(max(0, y - x) for x, y in motifs), sum(max(0, x - y) for x, y in motifs))[2]
    return {
        "raw_edge_precision": p, "raw_edge_recall": r, "raw_edge_f1": f, "edge_precision": max(p, ap), "edge_recall": max(r, ar), "edge_f1": max(f, af), "exact_reconstruction": float(len(a) == len(b) and len(ea) == len(eb) and wl_digest(a) == wl_digest(b)),
        "strict_exact_reconstruction": exact, "node_count_error": abs(len(a) - len(b)) / max(1, len(a)), "edge_count_error": abs(len(ea) - len(eb)) / max(1, len(ea)), "connected_component_error": float(abs(ca - cb)),
        "triangle_error": abs(ta - tb) / max(1, ta), "cycle_error": abs(ya - yb) / max(1, ya), "degree_l1": sum(abs(ha[k] - hb[k]) for k in ha | hb) / max(1, len(a)), "motif_f1": mf,
        "spectrum_distance": float(np.abs(spectrum(a) - spectrum(b)).mean()), "graph_edit_approx": float(len(eb - ea) + len(ea - eb) + abs(len(a) - len(b))), "same_degree_sequence": float(ha == hb),
    }


FIDELITY = tuple(fidelity([(0, 1)], [(0, 1)], 2, 2))


def structure_fidelity(pairs: DataFrame) -> DataFrame:
    """pairs (graph_id, a_nodes, a_edges, b_nodes, b_edges), a graph a row: all metrics of each."""

    def run(batches):
        for own in batches:
            rows = [{"graph_id": str(r.graph_id), **fidelity([tuple(x) for x in r.a_edges], [tuple(x) for x in r.b_edges], r.a_nodes, r.b_nodes)} for r in own.itertuples()]
            yield pd.DataFrame(rows, columns=["graph_id", *FIDELITY])

    return pairs.select("graph_id", "a_nodes", "a_edges", "b_nodes", "b_edges").mapInPandas(run, "graph_id string, " + ", ".join(f"{c} double" for c in FIDELITY))


def merge_quality(executed: DataFrame) -> DataFrame:
    """One row over (merges, mismatches, actions): precision 1 - mismatches / merges, recall merges / actions, and F1."""
    s = executed.agg(*[F.sum(c).alias(c) for c in ("merges", "mismatches", "actions")])
    p, r = 1 - F.col("mismatches") / F.greatest(F.lit(1), F.col("merges")), F.col("merges") / F.greatest(F.lit(1), F.col("actions"))
    return s.select(p.alias("merge_precision"), r.alias("merge_recall"), (2 * p * r / F.greatest(F.lit(1e-12), p + r)).alias("merge_f1"))


def mean_columns(rows: DataFrame, columns: list[str], prefix: str = "") -> DataFrame:
    """One row: means of columns, null as 0."""
    return rows.agg(*[F.avg(F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))).alias(prefix + c) for c in columns])
