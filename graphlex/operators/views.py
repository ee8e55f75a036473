"""Token views of graphs, vocabularies, splits and features for sequence models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tokens as T
from . import graph as G
from .compact import learn_merges, over_arrays, replace
from .kernels import edge_walk, per_graph, traversal


def edge_list_view(edges: DataFrame) -> DataFrame:
    """(graph_id, pos, tok): E(u,v) in order."""
    pos = F.row_number().over(Window.partitionBy("graph_id").orderBy("u", "v")) - 1
    return edges.select("graph_id", pos.alias("pos"), F.format_string("E(%d,%d)", "u", "v").alias("tok"))


def adjacency_view(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(graph_id, pos, tok): N(v):a,b for every node; isolated nodes need a node table."""
    near = G.both_ways(edges).groupBy("graph_id", "node").agg(F.array_join(F.array_sort(F.collect_list("other")).cast("array<string>"), ",").alias("around"))
    rows = near if nodes is None else nodes.join(near, ["graph_id", "node"], "left").withColumn("around", F.coalesce("around", F.lit("")))
    pos = F.row_number().over(Window.partitionBy("graph_id").orderBy("node")) - 1
    return rows.select("graph_id", pos.alias("pos"), F.format_string("N(%d):%s", "node", "around").alias("tok"))


def summary_view(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(graph_id, pos, tok): binned nodes, edges, tenths of density, triangles."""
    s = G.graph_stats(edges, nodes, with_components=False)
    toks = F.array(F.format_string("NODES_BIN(%d)", T.bin_value(F.col("n"))), F.format_string("EDGES_BIN(%d)", T.bin_value(F.col("e"))), F.format_string("DENSITY_BIN(%d)", F.floor(F.col("density") * 10 + 1e-9).cast("int")), F.format_string("TRIANGLES_BIN(%d)", T.bin_value(F.col("triangles"))))
    return s.select("graph_id", F.posexplode(toks).alias("pos", "tok"))


def wl_view(edges: DataFrame, rounds: int = 2, nodes: DataFrame | None = None) -> DataFrame:
    """(graph_id, pos, tok): WLd(label)xcount by depth and label."""
    n = G.wl_labels(edges, rounds, nodes).groupBy("graph_id", "depth", "label").agg(F.count("*").alias("n"))
    pos = F.row_number().over(Window.partitionBy("graph_id").orderBy("depth", "label")) - 1
    return n.select("graph_id", pos.alias("pos"), F.format_string("WL%d(%s)x%d", "depth", "label", "n").alias("tok"))


def traversal_view(edges: DataFrame, breadth_first: bool, nodes: DataFrame | None = None) -> DataFrame:
    return per_graph(edges, lambda adj: list(enumerate(traversal(adj, breadth_first))), "pos int, tok string", nodes)


def edge_walk_view(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    return per_graph(edges, lambda adj: list(enumerate(edge_walk(adj))), "pos int, tok string", nodes)


def shuffled_view(tokens: DataFrame, seed: int) -> DataFrame:
    """The tokens of each graph in an order given by a hash of seed, graph and position."""
    key = F.sha1(F.concat_ws("|", F.lit(str(seed)), F.col("graph_id").cast("string"), F.col("pos").cast("string")).cast("binary"))
    return tokens.select("graph_id", (F.row_number().over(Window.partitionBy("graph_id").orderBy(key, "pos")) - 1).alias("pos"), "tok")


def random_view(tokens: DataFrame, seed: int) -> DataFrame:
    """As many random ids, below a million."""
    key = F.concat_ws("|", F.lit(str(seed)), F.col("graph_id").cast("string"), F.col("pos").cast("string"))
    return tokens.select("graph_id", "pos", F.concat(F.lit("RID("), (T.hash_int(key) % 1_000_000).cast("long").cast("string"), F.lit(")")).alias("tok"))


def union_views(views: dict[str, DataFrame]) -> DataFrame:
    """(view, graph_id, pos, tok)."""
    out = None
    for name, v in views.items():
        rows = v.select(F.lit(name).alias("view"), "graph_id", F.col("pos").cast("int").alias("pos"), "tok")
        out = rows if out is None else out.unionByName(rows)
    return out


BASE_VIEWS = ("edge_list", "adjacency_list", "bfs_order", "dfs_order", "edge_walk", "statistics_only", "structural_summary", "wl_summary")


def build_view(name: str, edges: DataFrame, program_tokens: DataFrame | None = None, seed: int = 2026) -> DataFrame:
    """A view by name: a base view of the graph, or `program`, `program_shuffled`, `program_random_ids` of its program's tokens."""
    if name in BASE_VIEWS:
        return {
            "edge_list": lambda: edge_list_view(edges), "adjacency_list": lambda: adjacency_view(edges), "bfs_order": lambda: traversal_view(edges, True), "dfs_order": lambda: traversal_view(edges, False),
            "edge_walk": lambda: edge_walk_view(edges), "statistics_only": lambda: summary_view(edges), "structural_summary": lambda: summary_view(edges), "wl_summary": lambda: wl_view(edges),
        }[name]()
    if program_tokens is None:
        raise ValueError(f"view {name} needs program tokens")
    made = {"program": lambda t: t, "program_shuffled": lambda t: shuffled_view(t, seed), "program_random_ids": lambda t: random_view(t, seed)}
    if name not in made:
        raise ValueError(f"no view is called {name}")
    return made[name](program_tokens)


def learn_view_merges(sequences: DataFrame, most: int = 500, least_count: int = 2) -> dict[str, tuple[str, ...]]:
    """Pair merges BPEi<a+b> of a view's sequences (seq_id, tokens); fit on training rows only."""
    return learn_merges(sequences, most, least_count, "BPE{}<{}+{}>")[0]


def apply_view_merges(sequences: DataFrame, rules: dict[str, tuple[str, ...]]) -> DataFrame:
    def fold(tokens: list[str]) -> list[str]:
        for name, parts in rules.items():
            tokens = replace(tokens, parts, name)
        return tokens

    return over_arrays(sequences, fold)


def vocabulary(rows: DataFrame, most: int = 100_000) -> DataFrame:
    """(tok, id, n) of the long form (seq_id, pos, tok): by frequency, then first appearance; ids from 4, after the specials."""
    n = rows.groupBy("tok").agg(F.count("*").alias("n"), F.min(F.struct("seq_id", "pos")).alias("first"))
    top = n.orderBy(F.desc("n"), "first").limit(most - len(T.SPECIALS))
    return top.select("tok", (F.row_number().over(Window.orderBy(F.desc("n"), "first")) + 3).alias("id"), "n")


def encode_ids(rows: DataFrame, vocab: DataFrame, max_len: int) -> DataFrame:
    """(seq_id, ids): BOS, ids (3 where unknown), EOS, cut to max_len, padded with 0. The vocabulary is bounded, so it is broadcast."""
    ids = rows.join(F.broadcast(vocab.select("tok", "id")), "tok", "left").select("seq_id", "pos", F.coalesce("id", F.lit(3)).alias("id"))
    body = F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"])
    full = ids.groupBy("seq_id").agg(F.slice(F.concat(F.array(F.lit(1)), body, F.array(F.lit(2))), 1, max_len).alias("ids"))
    return full.select("seq_id", F.concat("ids", F.array_repeat(F.lit(0), F.greatest(F.lit(0), F.lit(max_len) - F.size("ids")))).alias("ids"))


def ratio_split(rows: DataFrame, key: str, train: float, val: float, seed: int | None = None) -> DataFrame:
    """rows with a split: contiguous by key, or by a hash of it and the seed; sizes are ratios of the count, halves to even."""
    order = F.sha1(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")) if seed is not None else F.col(key)
    total = rows.count()
    a = round(train * total)
    b = a + round(val * total)
    ranked = G.running_sum(rows, [order, F.col(key)], F.lit(1), "__k")
    return ranked.withColumn("split", F.when(F.col("__k") < a, "train").when(F.col("__k") < b, "val").otherwise("test")).drop("__k")


def hash_cap(rows: DataFrame, key: str, cap: int, seed: int, group: str | None = None) -> DataFrame:
    """A sample of `cap` rows (of each group), by a hash of key and seed."""
    order = F.sha1(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    if group is None:
        return rows.orderBy(order, key).limit(cap)
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(group).orderBy(order, key))).where(F.col("__k") <= cap).drop("__k")


def bias_pairs(refs: DataFrame, edge_pairs: DataFrame, length: int) -> DataFrame:
    """(seq_id, i, j): places of a sequence that attend to each other: equal or adjacent, sharing a reference, or joined by an edge.

    refs: (seq_id, pos, ref); edge_pairs: (seq_id, a, b).
    """
    places = refs.select("seq_id", "pos").distinct().where(F.col("pos") < length)
    near = places.select("seq_id", F.col("pos").alias("i"), F.explode(F.array(F.col("pos") - 1, F.col("pos"), F.col("pos") + 1)).alias("j")).where((F.col("j") >= 0) & (F.col("j") < length))
    near = near.join(places.withColumnRenamed("pos", "j"), ["seq_id", "j"], "left_semi").select("seq_id", "i", "j")
    a, b = refs.select("seq_id", F.col("pos").alias("i"), "ref"), refs.select("seq_id", F.col("pos").alias("j"), "ref")
    shared = a.join(b, ["seq_id", "ref"]).select("seq_id", "i", "j")
    ends = edge_pairs.select("seq_id", F.col("a").alias("x"), F.col("b").alias("y"))
    ends = ends.unionByName(ends.select("seq_id", F.col("y").alias("x"), F.col("x").alias("y")))
    linked = ends.join(a.withColumnRenamed("ref", "x"), ["seq_id", "x"]).join(b.withColumnRenamed("ref", "y"), ["seq_id", "y"]).select("seq_id", "i", "j")
    return near.unionByName(shared).unionByName(linked).where((F.col("i") < length) & (F.col("j") < length)).distinct()


def standardise(rows: DataFrame, column: str) -> DataFrame:
    """column less its mean, over its population standard deviation (1 where that is 0)."""
    s = rows.agg(F.avg(column).alias("__m"), F.stddev_pop(column).alias("__s"))
    return rows.join(F.broadcast(s)).withColumn(column, (F.col(column) - F.col("__m")) / F.when(F.col("__s") > 0, F.col("__s")).otherwise(1.0)).drop("__m", "__s")


def macro_f1(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """One row: accuracy and macro F1 over the classes of either column."""
    n = rows.groupBy(truth, guess).agg(F.count("*").alias("n"))
    flat = n.select(F.explode(F.array(F.struct(F.col(truth).alias("c"), F.col("n").alias("t"), F.lit(0).cast("long").alias("g"), F.when(F.col(truth) == F.col(guess), F.col("n")).otherwise(0).alias("h")), F.struct(F.col(guess).alias("c"), F.lit(0).cast("long").alias("t"), F.col("n").alias("g"), F.lit(0).cast("long").alias("h")))).alias("x")).select("x.*")
    per = flat.groupBy("c").agg(F.sum("t").alias("t"), F.sum("g").alias("g"), F.sum("h").alias("h"))
    f1 = F.when(F.col("t") + F.col("g") > 0, 2.0 * F.col("h") / (F.col("t") + F.col("g"))).otherwise(0.0)
    return per.agg((F.sum("h") / F.sum("t")).alias("accuracy"), F.avg(f1).alias("macro_f1"))


def roc_auc(rows: DataFrame, label: str, score: str) -> DataFrame:
    """One row: area under the curve by rank sums, ties at their mean rank. Ranks come from counts by score, so only distinct scores are ordered."""
    n = rows.groupBy(score).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    ranked = G.running_sum(n, [F.col(score)], F.col("n"), "before")
    r = ranked.select("n", "pos", (F.col("before") + (F.col("n") + 1) / 2.0).alias("rank")).agg(F.sum(F.col("pos") * F.col("rank")).alias("s"), F.sum("pos").alias("p"), F.sum("n").alias("t"))
    return r.select(F.when((F.col("p") > 0) & (F.col("p") < F.col("t")), (F.col("s") - F.col("p") * (F.col("p") + 1) / 2.0) / (F.col("p") * (F.col("t") - F.col("p")))).alias("auc"))


