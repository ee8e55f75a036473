"""Codebooks: patches grouped by shape, and the assignment of patches and vectors to codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Features of a patch and their weights in the distance to a code.
FEATURES = ("num_nodes", "num_edges", "ports", "triangles", "cycles", "max_degree", "density")
WEIGHTS = (1.2, 1.2, 0.8, 1.0, 1.0, 1.0, 0.6)


def shape_codes(patches: DataFrame, most: int = 4096) -> DataFrame:
    """The default codebook: one code for each labelled shape, in order of first appearance by (graph_id, pos); `most` codes.

    Columns code, visual_key, n, e, shape, usage. One aggregate; the numbering runs over shapes, not patches.
    """
    local = F.transform(F.col("edges"), lambda x: F.transform(x, lambda v: (F.array_position(F.col("nodes"), v) - 1).cast("int")))
    rows = patches.select("graph_id", "pos", "n", "e", "visual_key", local.alias("shape"))
    groups = rows.groupBy("visual_key").agg(F.count("*").alias("usage"), F.min(F.struct("graph_id", "pos", "n", "e", "shape")).alias("f"))
    first = groups.orderBy("f.graph_id", "f.pos", "visual_key").limit(most)
    order = Window.orderBy("f.graph_id", "f.pos", "visual_key")
    return first.select((F.row_number().over(order) - 1).alias("code"), "visual_key", F.col("f.n").alias("n"), F.col("f.e").alias("e"), F.col("f.shape").alias("edges"), "usage")


def with_basics(codes: DataFrame) -> DataFrame:
    """codes and, numbered after them, the single edge and the single node where they are missing: by these any graph has a program."""
    basics = codes.sparkSession.createDataFrame([("2:0-1", 2, 1, [[0, 1]], 0), ("1:", 1, 0, [], 0)], "visual_key string, n int, e int, edges array<array<int>>, usage long")
    top = codes.agg(F.coalesce(F.max("code"), F.lit(-1)).alias("top"))
    new = basics.join(codes.select("visual_key"), "visual_key", "left_anti").withColumn("k", F.row_number().over(Window.orderBy(F.desc("n"))))  # two rows
    return codes.unionByName(new.join(F.broadcast(top)).select((F.col("top") + F.col("k")).cast("int").alias("code"), "visual_key", "n", "e", "edges", "usage"))


def assign_exact(patches: DataFrame, codes: DataFrame) -> DataFrame:
    """patches with the code of their exact shape, null if there is none. A codebook has `most` rows at most, so it is broadcast."""
    return patches.join(F.broadcast(codes.select("visual_key", "code")), "visual_key", "left")


def interfaces(patches: DataFrame, columns: tuple[str, ...] = ("ports", "anchors", "edge_anchors")) -> DataFrame:
    """(interface, schema, usage): distinct port and anchor schemas, by (-usage, schema)."""
    schema = F.to_json(F.struct(*columns))
    groups = patches.groupBy(schema.alias("schema")).agg(F.count("*").alias("usage"))
    return groups.select((F.row_number().over(Window.orderBy(F.desc("usage"), "schema")) - 1).alias("interface"), "schema", "usage")


def extend_interfaces(known: DataFrame, patches: DataFrame, columns: tuple[str, ...] = ("ports", "anchors", "edge_anchors")) -> DataFrame:
    """known interfaces and, numbered after them, the schemas of patches that they lack. An explicit step: encoding changes no table."""
    new = interfaces(patches, columns).join(known.select("schema"), "schema", "left_anti")
    top = known.agg(F.coalesce(F.max("interface"), F.lit(-1)).alias("top"))
    numbered = new.select((F.row_number().over(Window.orderBy("interface"))).alias("k"), "schema", "usage").join(F.broadcast(top))
    return known.unionByName(numbered.select((F.col("top") + F.col("k")).cast("int").alias("interface"), "schema", "usage"))


def usage_stats(counts: DataFrame, size: int | None = None) -> DataFrame:
    """One row over usage counts (n): used, total, entropy (nats), perplexity, and the share of `size` codes that are unused."""
    used = counts.where("n > 0").groupBy("n").agg(F.count("*").alias("k"))  # counts of counts: few rows
    total = F.sum(F.col("n") * F.col("k")).over(Window.partitionBy(F.lit(1)))
    rows = used.withColumn("p", F.col("n") / total)
    out = rows.agg(F.sum("k").cast("long").alias("used"), F.sum(F.col("n") * F.col("k")).cast("long").alias("total"), F.sum(-F.col("k") * F.col("p") * F.log(F.col("p") + 1e-12)).alias("entropy"))
    out = out.withColumn("perplexity", F.exp("entropy"))
    return out if size is None else out.withColumn("dead_ratio", 1 - F.col("used") / F.lit(float(max(1, size))))


def means(rows: DataFrame, group: str) -> DataFrame:
    """(group, dim, mean) of vectors in long form (group, dim, value)."""
    return rows.groupBy(group, "dim").agg(F.avg("value").alias("mean"))


def distances(rows: DataFrame, centres: DataFrame, item: str, code: str, weights: Column | None = None) -> DataFrame:
    """(item, code, distance): L1 distance of every item to every code. `centres` (code, dim, mean) is a codebook: small, broadcast."""
    gap = F.abs(F.col("value") - F.col("mean"))
    return rows.join(F.broadcast(centres), "dim").groupBy(item, code).agg(F.sum(gap if weights is None else gap * weights).alias("distance"))


def nearest(rows: DataFrame, centres: DataFrame, item: str, code: str, digits: int = 6) -> DataFrame:
    """(item, code, distance): the nearest code of each item, ties by the smaller code."""
    d = distances(rows, centres, item, code)
    return d.groupBy(item).agg(F.min(F.struct(F.round("distance", digits).alias("distance"), F.col(code))).alias("b")).select(item, F.col(f"b.{code}").alias(code), F.col("b.distance").alias("distance"))


def medoids(rows: DataFrame, group: str, item: str, digits: int = 6) -> DataFrame:
    """(group, item, distance): the item nearest to its group's mean, ties by the smaller item."""
    d = rows.join(means(rows, group), [group, "dim"]).groupBy(group, item).agg(F.sum(F.abs(F.col("value") - F.col("mean"))).alias("distance"))
    return d.groupBy(group).agg(F.min(F.struct(F.round("distance", digits).alias("distance"), F.col(item))).alias("b")).select(group, F.col(f"b.{item}").alias(item), F.col("b.distance").alias("distance"))


def patch_distance() -> Column:
    """Distance of a patch (features f_*) and a code (features c_*): weighted L1 and 0.75 if the shapes differ."""
    terms = [F.lit(w) * F.abs(F.col(f"f_{k}") - F.col(f"c_{k}")) for k, w in zip(FEATURES, WEIGHTS, strict=True)]
    out = F.when(F.col("visual_key") == F.col("code_visual_key"), 0.0).otherwise(0.75)
    for t in terms:
        out = out + t
    return out


#: How far node, edge and port counts of a candidate may differ.
BANDS = ((-2, -1, 0, 1, 2), (-4, -2, -1, 0, 1, 2, 4), (-1, 0, 1))


def band_candidates(items: DataFrame, codes: DataFrame, keys: tuple[str, ...], bands: tuple = BANDS, limit: int = 256) -> DataFrame:
    """(item columns, code): codes whose keys lie in the bands around the item's. An equi join on exploded offsets; the codebook is broadcast."""
    out = items
    for k, offsets in zip(keys, bands, strict=False):
        out = out.withColumn(f"__{k}", F.explode(F.array(*[F.col(k) + o for o in offsets])))
    on = codes.select("code", *[F.col(k).alias(f"__{k}") for k in keys])
    found = out.join(F.broadcast(on), [f"__{k}" for k in keys]).select(*items.columns, "code")
    return found.withColumn("k", F.row_number().over(Window.partitionBy(*items.columns).orderBy("code"))).where(F.col("k") <= limit).drop("k")


def shape_category(n: Column, e: Column, max_degree: Column, min_degree: Column, connected: Column) -> Column:
    """What a shape is called; the first that holds (a triangle is a clique, a path of three a star)."""
    return (
        F.when(n == 0, "empty")
        .when((n == 1) & (e == 0), "atom")
        .when((n == 2) & (e == 1), "edge")
        .when((n >= 3) & (e * 2 == n * (n - 1)), "clique")
        .when((n >= 3) & (e == n) & (max_degree == 2) & (min_degree == 2) & connected, "cycle")
        .when((n >= 3) & (e == n - 1) & (max_degree == n - 1), "star")
        .when((n >= 3) & (e == n - 1) & (max_degree <= 2) & connected, "chain")
        .when((e == n - 1) & connected, "treelet")
        .otherwise("motif")
    )


def code_quality(assigned: DataFrame) -> DataFrame:
    """One row over (code, distance): mean distance, share of codes whose mean distance is over 2.5, top-1 and top-10 usage shares."""
    per = assigned.groupBy("code").agg(F.count("*").alias("n"), F.avg("distance").alias("d"))
    ranked = per.withColumn("k", F.row_number().over(Window.orderBy(F.desc("n"), "code")))
    share = lambda k: (F.sum(F.when(F.col("k") <= k, F.col("n")).otherwise(0)) / F.greatest(F.lit(1), F.sum("n")))
    return ranked.agg(F.avg("d").alias("mean_distance"), F.avg((F.col("d") > 2.5).cast("int")).alias("split_necessity_rate"), share(1).alias("top1_share"), share(10).alias("top10_share"))
