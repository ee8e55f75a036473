"""Graph operators as relational plans over edges (graph_id, u, v), undirected with u < v.

All of them keep graph_id as part of every key, so one huge graph spreads over the cluster like many small ones.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "graph_id"


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder that the session names; where none is named, on a local master only, in one of our own."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="graphlex-"))
    return df.checkpoint()


def running_sum(rows: DataFrame, order: list, value: Column, name: str) -> DataFrame:
    """rows with the sum of `value` over all rows before each, in a total order over the whole table, and without one task that sees it all.

    Rows are dealt by ranges of the order and checkpointed, so that a second pass finds the same ranges; the driver gets one sum for each range.
    """
    keys = [f"__o{k}" for k in range(len(order))]
    dealt = rows.select("*", *[c.alias(k) for c, k in zip(order, keys, strict=True)], value.alias("__v"))
    dealt = cut(dealt.repartitionByRange(*keys).withColumn("__p", F.spark_partition_id()))
    before, at = [], 0
    for p, total in sorted((r["__p"], r["t"]) for r in dealt.groupBy("__p").agg(F.sum("__v").alias("t")).collect()):
        before.append((p, at))
        at += total
    offsets = F.broadcast(rows.sparkSession.createDataFrame(before, "__p int, __b long"))
    inside = F.coalesce(F.sum("__v").over(Window.partitionBy("__p").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.join(offsets, "__p").withColumn(name, (F.col("__b") + inside).cast("long")).drop("__p", "__b", "__v", *keys)


def canonical_edges(edges: DataFrame, directed: bool = False) -> DataFrame:
    """Distinct edges without loops; ends sorted unless directed."""
    ends = ("u", "v") if directed else (F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return edges.where("u <> v").select(KEY, *ends).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, as (graph_id, node, other). One pass over the edges."""
    pair = F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("other")), F.struct(F.col("v").alias("node"), F.col("u").alias("other"))))
    return edges.select(KEY, pair.alias("p")).select(KEY, "p.node", "p.other")


def with_nodes(graphs: DataFrame) -> DataFrame:
    """(graph_id, node) for nodes 0 .. num_nodes - 1 of each graph, isolated ones too."""
    return graphs.where("num_nodes > 0").select(KEY, F.explode(F.sequence(F.lit(0), F.col("num_nodes") - 1)).alias("node"))


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(graph_id, node, degree); with a node table isolated nodes have degree 0."""
    out = both_ways(edges).groupBy(KEY, "node").agg(F.count("*").alias("degree"))
    return out if nodes is None else nodes.join(out, [KEY, "node"], "left").select(KEY, "node", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def triangles(edges: DataFrame) -> DataFrame:
    """(graph_id, a, b, c), a < b < c. Wedges open at the end of lower degree, which bounds them on skewed graphs."""
    d = degrees(edges)
    rank = F.struct("degree", "node")
    ends = edges.join(d.select(KEY, F.col("node").alias("u"), F.struct("degree", "node").alias("ru")), [KEY, "u"]).join(d.select(KEY, F.col("node").alias("v"), rank.alias("rv")), [KEY, "v"])
    out = ends.select(KEY, F.when(F.col("ru") < F.col("rv"), F.col("u")).otherwise(F.col("v")).alias("x"), F.when(F.col("ru") < F.col("rv"), F.col("v")).otherwise(F.col("u")).alias("y"))
    wedge = out.alias("p").join(out.withColumnRenamed("y", "z").alias("q"), [KEY, "x"]).where("y < z")
    closed = wedge.join(edges.select(KEY, F.col("u").alias("y"), F.col("v").alias("z")), [KEY, "y", "z"], "left_semi")
    s = F.array_sort(F.array("x", "y", "z"))
    return closed.select(KEY, s[0].alias("a"), s[1].alias("b"), s[2].alias("c"))


def node_triangles(edges: DataFrame) -> DataFrame:
    """(graph_id, node, triangles) for nodes in at least one."""
    return triangles(edges).select(KEY, F.explode(F.array("a", "b", "c")).alias("node")).groupBy(KEY, "node").agg(F.count("*").alias("triangles"))


def clustering(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(graph_id, node, degree, triangles, clustering): 2T / (d (d - 1)), 0 where d < 2."""
    out = degrees(edges, nodes).join(node_triangles(edges), [KEY, "node"], "left").withColumn("triangles", F.coalesce("triangles", F.lit(0)).cast("long"))
    return out.withColumn("clustering", F.when(F.col("degree") > 1, 2.0 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0))


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(graph_id, node, component): the smallest node of the component. Label propagation with pointer jumping; rounds grow with the
    logarithm of the diameter, and each ends in a checkpoint."""
    ends = cut(both_ways(edges))
    every = ends.select(KEY, "node").distinct() if nodes is None else nodes.select(KEY, "node").distinct()
    now = cut(every.withColumn("label", F.col("node")))
    while True:
        near = ends.join(now.select(KEY, F.col("node").alias("other"), "label"), [KEY, "other"]).groupBy(KEY, "node").agg(F.min("label").alias("m"))
        low = now.join(near, [KEY, "node"], "left").select(KEY, "node", F.col("label").alias("old"), F.least("label", F.coalesce("m", "label")).alias("label"))
        # Hooking: what a node learns holds for the label it had as well; then follow the label's own label.
        hook = low.groupBy(KEY, F.col("old").alias("node")).agg(F.min("label").alias("h"))
        jump = low.join(hook.withColumnRenamed("node", "old"), [KEY, "old"]).select(KEY, "node", "old", F.least("label", "h").alias("label"))
        to = jump.select(KEY, F.col("node").alias("label"), F.col("label").alias("next"))
        new = cut(jump.join(to, [KEY, "label"], "left").select(KEY, "node", "old", F.least("label", F.coalesce("next", "label")).alias("label")))
        changed = new.where("label <> old").limit(1).count()
        now = new.drop("old")
        if not changed:
            return now.select(KEY, "node", F.col("label").alias("component"))


def graph_stats(edges: DataFrame, nodes: DataFrame | None = None, with_components: bool = True) -> DataFrame:
    """One row for each graph: n, e, density, triangles, avg_clustering, components, cycles (e - n + components), is_forest."""
    c = clustering(edges, nodes).groupBy(KEY).agg(F.count("*").alias("n"), (F.sum("degree") / 2).cast("long").alias("e"), (F.sum("triangles") / 3).cast("long").alias("triangles"), F.avg("clustering").alias("avg_clustering"), F.max("degree").alias("max_degree"))
    c = c.withColumn("density", F.when(F.col("n") > 1, 2.0 * F.col("e") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0))
    if not with_components:
        return c
    k = components(edges, nodes).groupBy(KEY).agg(F.count_distinct("component").alias("components"))
    return c.join(k, KEY).withColumn("cycles", F.col("e") - F.col("n") + F.col("components")).withColumn("is_forest", F.col("cycles") == 0)


def edge_patch_test(max_density: float, max_clustering: float) -> Column:
    """On graph_stats: whether a graph is sparse enough to be covered by its edges."""
    return (F.col("e") == 0) | F.col("is_forest") | ((F.col("density") <= max_density) & (F.col("avg_clustering") <= max_clustering))


def wl_labels(edges: DataFrame, rounds: int = 2, nodes: DataFrame | None = None) -> DataFrame:
    """(graph_id, depth, node, label): Weisfeiler-Lehman labels by rounds; round 0 is the degree, later ones the first 8 hex digits of SHA-1 over
    the own label and the sorted labels around."""
    ends = both_ways(edges)
    now = degrees(edges, nodes).select(KEY, "node", F.col("degree").cast("string").alias("label"))
    out = now.withColumn("depth", F.lit(0))
    for depth in range(1, rounds + 1):
        near = ends.join(now.select(KEY, F.col("node").alias("other"), F.col("label").alias("near")), [KEY, "other"]).groupBy(KEY, "node").agg(F.array_join(F.array_sort(F.collect_list("near")), ",").alias("around"))
        text = F.concat("label", F.lit("|"), F.coalesce("around", F.lit("")))
        now = now.join(near, [KEY, "node"], "left").select(KEY, "node", F.substring(F.sha1(text), 1, 8).alias("label"))
        out = out.unionByName(now.withColumn("depth", F.lit(depth)))
    return out


def wl_hash(edges: DataFrame, rounds: int = 3, nodes: DataFrame | None = None) -> DataFrame:
    """(graph_id, wl): one digest of each graph's label histograms; equal for isomorphic graphs."""
    counts = wl_labels(edges, rounds, nodes).groupBy(KEY, "depth", "label").agg(F.count("*").alias("n"))
    item = F.concat_ws(":", "depth", "label", "n")
    return counts.groupBy(KEY).agg(F.sha1(F.array_join(F.array_sort(F.collect_list(item)), ",").cast("binary")).alias("wl"))


def core_numbers(edges: DataFrame) -> DataFrame:
    """(graph_id, node, core): the fixpoint of h-index iteration, which is the core number. Local, so each round is one join and aggregate."""
    ends = cut(both_ways(edges))
    now = cut(degrees(edges).select(KEY, "node", F.col("degree").alias("h")))
    while True:
        near = ends.join(now.select(KEY, F.col("node").alias("other"), F.col("h").alias("x")), [KEY, "other"]).groupBy(KEY, "node").agg(F.sort_array(F.collect_list("x"), asc=False).alias("xs"))
        h = F.expr("aggregate(xs, struct(0L AS i, 0L AS h), (s, x) -> struct(s.i + 1 AS i, CASE WHEN x >= s.i + 1 THEN s.i + 1 ELSE s.h END AS h), s -> s.h)")
        new = cut(now.join(near.select(KEY, "node", h.alias("g")), [KEY, "node"]).select(KEY, "node", F.least("h", "g").alias("h"), F.col("h").alias("old")))
        if not new.where("h < old").limit(1).count():
            return new.select(KEY, "node", F.col("h").alias("core"))
        now = new.drop("old")


def k_hop_nodes(edges: DataFrame, centers: DataFrame, radius: int) -> DataFrame:
    """(graph_id, center, node, hops): nodes up to `radius` steps from each center (graph_id, center)."""
    ends = both_ways(edges)
    seen = centers.select(KEY, "center", F.col("center").alias("node"), F.lit(0).alias("hops"))
    last = seen
    for k in range(1, radius + 1):
        step = last.join(ends, [KEY, "node"]).select(KEY, "center", F.col("other").alias("node")).distinct()
        last = step.join(seen, [KEY, "center", "node"], "left_anti").withColumn("hops", F.lit(k))
        seen = seen.unionByName(last)
    return seen


def ego_graphs(edges: DataFrame, centers: DataFrame, radius: int, max_nodes: int) -> DataFrame:
    """Induced subgraphs around centers, nearest `max_nodes` nodes: (graph_id, center, u, v)."""
    order = Window.partitionBy(KEY, "center").orderBy("hops", "node")
    near = k_hop_nodes(edges, centers, radius).withColumn("k", F.row_number().over(order)).where(F.col("k") <= max_nodes).select(KEY, "center", "node")
    a, b = near.withColumnRenamed("node", "u"), near.withColumnRenamed("node", "v")
    return a.join(edges, [KEY, "u"]).join(b, [KEY, "center", "v"], "left_semi").select(KEY, "center", "u", "v")


def boundary_nodes(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Of members (graph_id, part, node): those with a neighbour outside their part."""
    ends = both_ways(edges)
    inside = members.select(KEY, "part", F.col("node").alias("other"))
    return members.join(ends, [KEY, "node"]).join(inside, [KEY, "part", "other"], "left_anti").select(KEY, "part", "node").distinct()


def crossing_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with exactly one end in a part of members (graph_id, part, node): (graph_id, part, u, v)."""
    hit = lambda end: edges.join(members.withColumnRenamed("node", end), [KEY, end]).select(KEY, "part", "u", "v")
    return hit("u").unionByName(hit("v")).groupBy(KEY, "part", "u", "v").agg(F.count("*").alias("k")).where("k = 1").drop("k")


def canonical_rank(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(graph_id, node, rank from 0): by degree, triangles, core and clustering, highest first, then id."""
    c = clustering(edges, nodes).join(core_numbers(edges), [KEY, "node"], "left")
    order = Window.partitionBy(KEY).orderBy(F.desc("degree"), F.desc("triangles"), F.desc(F.coalesce("core", F.lit(0))), F.desc(F.round("clustering", 6)), "node")
    return c.select(KEY, "node", (F.row_number().over(order) - 1).alias("rank"))


def edge_scores(a: DataFrame, b: DataFrame) -> DataFrame:
    """Edges of graphs a (original) against b (reconstructed): tp, fp, fn, precision, recall, f1 for each graph_id of a or b."""
    both = a.withColumn("x", F.lit(1)).join(b.withColumn("y", F.lit(1)), [KEY, "u", "v"], "full_outer")
    n = both.groupBy(KEY).agg(*[F.count(F.when(c, 1)).alias(k) for k, c in (("tp", F.expr("x = 1 AND y = 1")), ("fp", F.expr("x IS NULL")), ("fn", F.expr("y IS NULL")))])
    p, r = F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fp")), F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fn"))
    n = n.withColumn("precision", p).withColumn("recall", r)
    return n.withColumn("f1", F.expr("2 * precision * recall / greatest(1e-12D, precision + recall)"))


def degree_l1(a: DataFrame, b: DataFrame) -> DataFrame:
    """(graph_id, degree_l1): difference of the degree histograms over the nodes of a."""
    h = lambda e, name: degrees(e).groupBy(KEY, "degree").agg(F.count("*").alias(name))
    both = h(a, "x").join(h(b, "y"), [KEY, "degree"], "full_outer").fillna(0, ["x", "y"])
    return both.groupBy(KEY).agg((F.sum(F.abs(F.col("x") - F.col("y"))) / F.greatest(F.lit(1), F.sum("x"))).alias("degree_l1"))
