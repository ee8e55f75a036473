"""Graph queries over the views of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import kernels as K
from ..operators import patches as P
from ..sources.fixtures import BRAND_EDGES_SQL, EVENT_EDGES_SQL, FOREST_EDGES_SQL, brand_edges, event_edges, forest_edges
from .registry import query

#: Edges of dense graphs from this weight on; it keeps some hundreds of edges a graph.
WEIGHT = 3
G1 = f"WITH {EVENT_EDGES_SQL}"
ENDS = "ends AS (SELECT graph_id, u AS node, v AS other FROM g1 UNION ALL SELECT graph_id, v, u FROM g1)"
DEGREE = "deg AS (SELECT graph_id, node, count(*) AS degree FROM ends GROUP BY ALL)"
TRI = "tri AS (SELECT x.graph_id, x.u AS a, x.v AS b, y.v AS c FROM g1 x JOIN g1 y ON x.graph_id = y.graph_id AND x.v = y.u JOIN g1 z ON z.graph_id = x.graph_id AND z.u = x.u AND z.v = y.v)"
NODE_TRI = "nt AS (SELECT graph_id, node, count(*) AS triangles FROM (SELECT graph_id, unnest([a, b, c]) AS node FROM tri) GROUP BY ALL)"
CLUSTER = "cl AS (SELECT graph_id, node, degree, coalesce(triangles, 0) AS triangles, CASE WHEN degree > 1 THEN 2.0 * coalesce(triangles, 0) / (degree * (degree - 1)) ELSE 0.0 END AS clustering FROM deg LEFT JOIN nt USING (graph_id, node))"
REACH = "reach AS (SELECT DISTINCT graph_id, node, node AS low FROM ends UNION SELECT r.graph_id, e.other, r.low FROM reach r JOIN ends e ON e.graph_id = r.graph_id AND e.node = r.node)"
COMP = "comp AS (SELECT graph_id, node, min(low) AS component FROM reach GROUP BY ALL)"
WITH_ALL = f"WITH RECURSIVE {EVENT_EDGES_SQL}, {ENDS}, {DEGREE}, {TRI}, {NODE_TRI}, {CLUSTER}, {REACH}, {COMP}"


@query(f"{G1} SELECT graph_id, CAST(u AS BIGINT) AS u, CAST(v AS BIGINT) AS v FROM g1")
def edges_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.canonical_edges(event_edges(spark, sf_dir))


@query(f"{G1}, {ENDS}, {DEGREE} SELECT graph_id, CAST(node AS BIGINT) AS node, CAST(degree AS BIGINT) AS degree FROM deg")
def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degrees(event_edges(spark, sf_dir))


@query(f"{G1}, {TRI} SELECT graph_id, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(c AS BIGINT) AS c FROM tri")
def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.triangles(event_edges(spark, sf_dir))


@query(f"WITH {EVENT_EDGES_SQL}, {ENDS}, {DEGREE}, {TRI}, {NODE_TRI}, {CLUSTER} SELECT graph_id, CAST(node AS BIGINT) AS node, CAST(degree AS BIGINT) AS degree, CAST(triangles AS BIGINT) AS triangles, round(clustering, 6) AS clustering FROM cl")
def clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.clustering(event_edges(spark, sf_dir))


STATS = f"""{WITH_ALL} SELECT graph_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(degree) // 2 AS BIGINT) AS e, CAST(sum(triangles) // 3 AS BIGINT) AS triangles,
  round(avg(clustering), 6) AS avg_clustering, CAST(max(degree) AS BIGINT) AS max_degree, round(CASE WHEN count(*) > 1 THEN sum(degree) * 1.0 / (count(*) * (count(*) - 1)) ELSE 0.0 END, 6) AS density,
  CAST(count(DISTINCT component) AS BIGINT) AS components, CAST(sum(degree) // 2 - count(*) + count(DISTINCT component) AS BIGINT) AS cycles,
  sum(degree) // 2 - count(*) + count(DISTINCT component) = 0 AS is_forest FROM cl JOIN comp USING (graph_id, node) GROUP BY graph_id"""


@query(STATS)
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.graph_stats(event_edges(spark, sf_dir))


@query(f"SELECT graph_id, is_forest OR e = 0 OR (density <= 0.5 AND avg_clustering <= 0.1) AS by_edges FROM ({STATS})")
def forest_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.graph_stats(event_edges(spark, sf_dir)).select("graph_id", G.edge_patch_test(0.5, 0.1).alias("by_edges"))


@query(f"{WITH_ALL} SELECT graph_id, CAST(node AS BIGINT) AS node, CAST(component AS BIGINT) AS component FROM comp")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.components(event_edges(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {FOREST_EDGES_SQL}, ends AS (SELECT graph_id, u AS node, v AS other FROM g2 UNION ALL SELECT graph_id, v, u FROM g2),
  {REACH.replace("SELECT DISTINCT graph_id, node, node AS low FROM ends", "SELECT DISTINCT graph_id, u AS node, u AS low FROM g2 WHERE u < 100")}
  SELECT graph_id, CAST(node AS BIGINT) AS node, CAST(min(low) AS BIGINT) AS component FROM reach GROUP BY graph_id, node"""
)
def forest_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.components(forest_edges(spark, sf_dir))


@query(
    f"""WITH {EVENT_EDGES_SQL}, {ENDS}, {DEGREE}, h AS (SELECT graph_id, degree, count(*) AS n FROM deg GROUP BY ALL),
  p AS (SELECT a.graph_id, a.degree, a.n AS x, 0 AS y FROM h a UNION ALL SELECT graph_id - 1, degree, 0, n FROM h)
  SELECT graph_id, round(sum(d) * 1.0 / greatest(1, sum(x)), 6) AS degree_l1 FROM (SELECT graph_id, degree, sum(x) AS x, abs(sum(x) - sum(y)) AS d FROM p GROUP BY ALL) GROUP BY graph_id"""
)
def degree_hist_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each graph's degree histogram against that of the user's next week."""
    e = event_edges(spark, sf_dir)
    return G.degree_l1(e, e.withColumn("graph_id", F.col("graph_id") - 1))


@query(
    f"""WITH {EVENT_EDGES_SQL}, b AS (SELECT graph_id - 1 AS graph_id, u, v FROM g1), j AS (SELECT coalesce(a.graph_id, b.graph_id) AS graph_id, a.u IS NOT NULL AS x, b.u IS NOT NULL AS y FROM g1 a FULL JOIN b ON a.graph_id = b.graph_id AND a.u = b.u AND a.v = b.v),
  n AS (SELECT graph_id, count(*) FILTER (x AND y) AS tp, count(*) FILTER (NOT x) AS fp, count(*) FILTER (NOT y) AS fn FROM j GROUP BY graph_id), m AS (SELECT *, tp * 1.0 / greatest(1, tp + fp) AS precision, tp * 1.0 / greatest(1, tp + fn) AS recall FROM n)
  SELECT graph_id, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / greatest(1e-12, precision + recall), 6) AS f1 FROM m"""
)
def edge_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_edges(spark, sf_dir)
    return G.edge_scores(e, e.withColumn("graph_id", F.col("graph_id") - 1))


@query(
    f"""WITH {EVENT_EDGES_SQL}, {ENDS}, {DEGREE}, {TRI}, {NODE_TRI}, {CLUSTER} SELECT graph_id, CAST(node AS BIGINT) AS node, CAST((degree + node) % 8 AS BIGINT) AS node_type,
  round(degree * 1.0 / max(degree) OVER (PARTITION BY graph_id), 6) AS attr_degree, round(clustering, 6) AS attr_clustering, round(node / 4.0, 6) AS attr_place, 1.0::DOUBLE AS attr_one FROM cl"""
)
def node_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = G.clustering(event_edges(spark, sf_dir))
    top = F.max("degree").over(Window.partitionBy("graph_id"))
    return c.select("graph_id", "node", ((F.col("degree") + F.col("node")) % 8).alias("node_type"), (F.col("degree") / top).alias("attr_degree"), F.col("clustering").alias("attr_clustering"), (F.col("node") / 4.0).alias("attr_place"), F.lit(1.0).alias("attr_one"))


def _halves(e: DataFrame) -> DataFrame:
    return G.both_ways(e).select("graph_id", (F.col("node") % 2).alias("part"), "node").distinct()


@query(f"{G1}, {ENDS} SELECT DISTINCT graph_id, CAST(node % 2 AS BIGINT) AS part, CAST(node AS BIGINT) AS node FROM ends WHERE node % 2 <> other % 2")
def boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_edges(spark, sf_dir)
    return G.boundary_nodes(e, _halves(e))


@query(f"{G1} SELECT graph_id, CAST(p AS BIGINT) AS part, CAST(u AS BIGINT) AS u, CAST(v AS BIGINT) AS v FROM g1, unnest([0, 1]) AS t(p) WHERE u % 2 <> v % 2")
def boundary_xor(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_edges(spark, sf_dir)
    return G.crossing_edges(e, _halves(e))


@query(f"{G1} SELECT graph_id, CAST(row_number() OVER (PARTITION BY graph_id ORDER BY u, v) - 1 AS BIGINT) AS pos, CAST(u AS BIGINT) AS u, CAST(v AS BIGINT) AS v FROM g1")
def edge_cover_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.edge_cover(event_edges(spark, sf_dir))


@query(f"SELECT * FROM ({G1} SELECT graph_id, CAST(row_number() OVER (PARTITION BY graph_id ORDER BY u, v) - 1 AS BIGINT) AS pos, CAST(u AS BIGINT) AS u, CAST(v AS BIGINT) AS v FROM g1) WHERE pos < 3")
def patch_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.edge_cover(event_edges(spark, sf_dir), 3)


@query(f"SELECT graph_id, u, v FROM ({G1} SELECT graph_id, row_number() OVER (PARTITION BY graph_id ORDER BY u, v) - 1 AS pos, CAST(u AS BIGINT) AS u, CAST(v AS BIGINT) AS v FROM g1) WHERE pos >= 3")
def residual_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that the first three patches of each graph leave."""
    e = event_edges(spark, sf_dir)
    some = P.edge_cover(e, 3).select("graph_id", F.array(F.array("u", "v")).alias("edges"))
    return P.residual_edges(e, some)


@query(
    f"""{G1}, {ENDS}, s AS (SELECT graph_id, node, list(DISTINCT other) AS around FROM ends GROUP BY ALL) SELECT a.graph_id, CAST(a.node AS BIGINT) AS node, CAST(b.node AS BIGINT) AS other, CAST(len(list_filter(b.around, lambda x: NOT list_contains(a.around, x))) AS BIGINT) AS gain
  FROM s a JOIN s b ON a.graph_id = b.graph_id AND a.node < b.node"""
)
def cover_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many neighbours a node adds to those of another."""
    s = G.both_ways(event_edges(spark, sf_dir)).groupBy("graph_id", "node").agg(F.collect_set("other").alias("around"))
    b = s.select("graph_id", F.col("node").alias("other"), F.col("around").alias("more"))
    return s.join(b, "graph_id").where("node < other").select("graph_id", "node", "other", F.size(F.array_except("more", "around")).alias("gain"))


@query(
    f"""WITH {EVENT_EDGES_SQL}, {ENDS}, l0 AS (SELECT graph_id, node, CAST(count(*) AS VARCHAR) AS label FROM ends GROUP BY ALL),
  l1 AS (SELECT e.graph_id, e.node, substr(sha1(any_value(a.label) || '|' || string_agg(b.label, ',' ORDER BY b.label)), 1, 8) AS label FROM ends e JOIN l0 a ON a.graph_id = e.graph_id AND a.node = e.node JOIN l0 b ON b.graph_id = e.graph_id AND b.node = e.other GROUP BY ALL),
  l2 AS (SELECT e.graph_id, e.node, substr(sha1(any_value(a.label) || '|' || string_agg(b.label, ',' ORDER BY b.label)), 1, 8) AS label FROM ends e JOIN l1 a ON a.graph_id = e.graph_id AND a.node = e.node JOIN l1 b ON b.graph_id = e.graph_id AND b.node = e.other GROUP BY ALL),
  w AS (SELECT 0 AS depth, * FROM l0 UNION ALL SELECT 1, * FROM l1 UNION ALL SELECT 2, * FROM l2), n AS (SELECT graph_id, depth, label, count(*) AS n FROM w GROUP BY ALL)
  SELECT graph_id, CAST(row_number() OVER (PARTITION BY graph_id ORDER BY depth, label) - 1 AS BIGINT) AS pos, 'WL' || depth || '(' || label || ')x' || n AS tok FROM n"""
)
def wl_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.views import wl_view as view

    return view(event_edges(spark, sf_dir))


@query(
    f"""WITH {BRAND_EDGES_SQL}, e AS (SELECT graph_id, u, v FROM g3 WHERE w >= {WEIGHT}), ends AS (SELECT graph_id, u AS node FROM e UNION ALL SELECT graph_id, v FROM e), d AS (SELECT graph_id, node, count(*) AS degree FROM ends GROUP BY ALL),
  t AS (SELECT x.graph_id, count(*) AS triangles FROM e x JOIN e y ON x.graph_id = y.graph_id AND x.v = y.u JOIN e z ON z.graph_id = x.graph_id AND z.u = x.u AND z.v = y.v GROUP BY ALL)
  SELECT graph_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(degree) // 2 AS BIGINT) AS e, CAST(coalesce(any_value(triangles), 0) AS BIGINT) AS triangles FROM d LEFT JOIN t USING (graph_id) GROUP BY graph_id"""
)
def dense_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = brand_edges(spark, sf_dir, WEIGHT).select("graph_id", "u", "v")
    return G.graph_stats(e, with_components=False).select("graph_id", "n", "e", "triangles")


@query()
def core_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.core_numbers(brand_edges(spark, sf_dir, WEIGHT).select("graph_id", "u", "v"))


@query()
def canonical_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.canonical_rank(event_edges(spark, sf_dir))


@query(
    f"""{G1}, {ENDS}, h1 AS (SELECT DISTINCT graph_id, node AS center, other AS node FROM ends), h2 AS (SELECT DISTINCT h.graph_id, h.center, e.other AS node FROM h1 h JOIN ends e ON e.graph_id = h.graph_id AND e.node = h.node WHERE e.other <> h.center)
  SELECT graph_id, CAST(center AS BIGINT) AS center, CAST(node AS BIGINT) AS node, CAST(min(hops) AS BIGINT) AS hops FROM (SELECT DISTINCT graph_id, node AS center, node, 0 AS hops FROM ends UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2) GROUP BY graph_id, center, node"""
)
def ego_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_edges(spark, sf_dir)
    centers = G.both_ways(e).select("graph_id", F.col("node").alias("center")).distinct()
    return G.k_hop_nodes(e, centers, 2)


#: Bridges by brute force: without the edge its ends are no longer connected.
BRIDGES = f"""WITH RECURSIVE {EVENT_EDGES_SQL}, cutted AS (
    SELECT g.graph_id, g.u AS cu, g.v AS cv, e.u, e.v FROM g1 g JOIN g1 e ON e.graph_id = g.graph_id WHERE (e.u, e.v) <> (g.u, g.v)
  ), ends AS (SELECT graph_id, cu, cv, u AS node, v AS other FROM cutted UNION ALL SELECT graph_id, cu, cv, v, u FROM cutted),
  reach AS (SELECT graph_id, u AS cu, v AS cv, u AS node FROM g1 UNION SELECT r.graph_id, r.cu, r.cv, e.other FROM reach r JOIN ends e ON e.graph_id = r.graph_id AND e.cu = r.cu AND e.cv = r.cv AND e.node = r.node)
  SELECT graph_id, CAST(u AS BIGINT) AS u, CAST(v AS BIGINT) AS v FROM g1 g WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.graph_id = g.graph_id AND r.cu = g.u AND r.cv = g.v AND r.node = g.v)"""


@query(BRIDGES)
def bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.bridges(event_edges(spark, sf_dir))


@query()
def cut_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.cut_vertices(event_edges(spark, sf_dir))


@query()
def cycle_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.cycles(event_edges(spark, sf_dir))


@query()
def cliques(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.cliques(event_edges(spark, sf_dir))


@query()
def propose_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.propose(event_edges(spark, sf_dir))
    return p.select("graph_id", "pos", "patch_id", F.concat_ws(",", F.col("nodes").cast("array<string>")).alias("nodes"), "n", "e", F.size("ports").alias("n_ports"), "score", "visual_key")
