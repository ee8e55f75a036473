"""Graph operators and kernels on graphs whose answers are known, and against brute force."""

from itertools import combinations, permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphlex.operators import graph as G
from graphlex.operators import kernels as K
from graphlex.operators import patches as P
from graphlex.operators.metrics import fidelity

GRAPHS = {
    "cycle6": [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (0, 5)],
    "star5": [(0, k) for k in range(1, 6)],
    "path7": [(k, k + 1) for k in range(6)],
    "k4": list(combinations(range(4), 2)),
    "k5": list(combinations(range(5), 2)),
    "bowtie": [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (2, 4)],
    "barbell": [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (4, 5), (3, 5)],
}


def table(spark, graphs=None):
    return spark.createDataFrame([(g, u, v) for g, es in (graphs or GRAPHS).items() for u, v in es], "graph_id string, u int, v int")


def random_graph(r, n, p):
    return [(u, v) for u, v in combinations(range(n), 2) if r.random() < p]


def test_closed_forms(spark):
    s = {r.graph_id: r for r in G.graph_stats(table(spark)).collect()}
    assert (s["cycle6"].n, s["cycle6"].e, s["cycle6"].triangles, s["cycle6"].cycles, s["cycle6"].components) == (6, 6, 0, 1, 1)
    assert (s["star5"].cycles, s["star5"].is_forest, s["path7"].is_forest) == (0, True, True)
    assert (s["k4"].triangles, s["k4"].cycles, s["k4"].avg_clustering) == (4, 3, 1.0) and (s["k5"].triangles, s["k5"].cycles) == (10, 6)
    assert K.low_links(K.adjacency(GRAPHS["bowtie"])) == ([], [2]) and K.low_links(K.adjacency(GRAPHS["barbell"]))[0] == [(2, 3)]
    assert len(K.low_links(K.adjacency(GRAPHS["star5"]))[0]) == 5 and K.low_links(K.adjacency(GRAPHS["path7"]))[1] == [1, 2, 3, 4, 5]
    assert {r.core for r in G.core_numbers(table(spark)).where("graph_id = 'k5'").collect()} == {4}


def test_canonical_edges_and_isolated_nodes(spark):
    e = spark.createDataFrame([("g", 2, 1), ("g", 1, 2), ("g", 3, 3), ("g", 1, 2)], "graph_id string, u int, v int")
    assert [tuple(r) for r in G.canonical_edges(e).collect()] == [("g", 1, 2)]
    nodes = G.with_nodes(spark.createDataFrame([("g", 4), ("h", 0)], "graph_id string, num_nodes int"))
    d = {r.node: r.degree for r in G.degrees(G.canonical_edges(e), nodes).collect()}
    assert d == {0: 0, 1: 1, 2: 1, 3: 0}
    assert G.components(G.canonical_edges(e), nodes).select(F.count_distinct("component")).first()[0] == 3


def test_kernels_against_brute_force():
    r = np.random.default_rng(1)
    for _ in range(40):
        n = int(r.integers(2, 9))
        adj = K.adjacency(random_graph(r, n, 0.4), range(n))
        edges, parts = K.edge_list(adj), len(K.component_sets(adj))
        without = lambda e: len(K.component_sets(K.adjacency([x for x in edges if x != e], range(n))))
        bridges, cuts = K.low_links(adj)
        assert bridges == [e for e in edges if without(e) > parts]
        drop = lambda v: len(K.component_sets(K.adjacency([e for e in edges if v not in e], [x for x in range(n) if x != v])))
        assert cuts == [v for v in range(n) if adj[v] and drop(v) > parts]
        cliques = [c for k in range(1, n + 1) for c in combinations(range(n), k) if all(b in adj[a] for a, b in combinations(c, 2))]
        best = [c for c in cliques if not any(set(c) < set(d) for d in cliques)]
        assert sorted(K.maximal_cliques(adj, 1)) == sorted(best)
        basis = K.cycle_basis(adj)
        assert len(basis) <= len(edges) - n + parts and all(len(c) >= 3 for c in basis)
        assert len([t for t in K.traversal(adj, True) if t[0] == "T"]) == n - parts == len([t for t in K.traversal(adj, False) if t[0] == "T"])
        assert len([t for t in K.edge_walk(adj) if t[0] == "W"]) == len(edges)


def test_isomorphism_against_all_mappings():
    r = np.random.default_rng(2)
    for _ in range(60):
        n = int(r.integers(1, 6))
        a, b = (K.adjacency(random_graph(r, n, 0.5), range(n)) for _ in range(2))
        exists = any(all((p[v] in b[p[u]]) for u, v in K.edge_list(a)) and len(K.edge_list(a)) == len(K.edge_list(b)) for p in permutations(range(n)))
        found = K.isomorphism(a, b)
        assert (found is not None) == exists
        if found is not None:
            assert {tuple(sorted((found[u], found[v]))) for u, v in K.edge_list(a)} == set(K.edge_list(b))


def test_relabelled_graphs_share_a_hash_and_full_fidelity(spark):
    r = np.random.default_rng(3)
    for _ in range(15):
        n = int(r.integers(3, 15))
        e = random_graph(r, n, 0.3)
        p = r.permutation(n).tolist()
        m = fidelity(e, [(p[u], p[v]) for u, v in e], n, n)
        assert m["edge_f1"] == (1.0 if e else 0.0) and m["strict_exact_reconstruction"] == m["exact_reconstruction"] == 1.0 and m["spectrum_distance"] < 1e-6
    two = {"a": GRAPHS["barbell"], "b": [(5 - u, 5 - v) for u, v in GRAPHS["barbell"]], "c": GRAPHS["cycle6"]}
    h = {r.graph_id: r.wl for r in G.wl_hash(G.canonical_edges(table(spark, two))).collect()}
    assert h["a"] == h["b"] != h["c"]


@pytest.mark.parametrize("sparse", [False, True])
def test_patches_cover_every_edge(spark, sparse):
    r = np.random.default_rng(4)
    graphs = {**GRAPHS, **{f"r{k}": random_graph(r, 14, 0.25) for k in range(6)}}
    e = G.canonical_edges(table(spark, graphs))
    p = P.propose(e, {"sparse_edge_patches": sparse, "sparse_density": 1.0, "sparse_clustering": 1.0})
    assert P.residual_edges(e, p).count() == 0
    rows = p.toPandas()
    assert rows.n.max() <= 9 and (rows.ports.map(len) <= 9).all() and rows.patch_id.is_unique
    if sparse:
        assert (rows.e == 1).all()
    roles = {x["role"] for ports in rows.ports for x in ports}
    assert roles <= {"cycle-anchor", "bridge-port", "chain-end"}


def test_node_limit_of_ego_graphs(spark):
    e = G.canonical_edges(table(spark, {"k5": GRAPHS["k5"]}))
    c = spark.createDataFrame([("k5", 0)], "graph_id string, center int")
    assert G.ego_graphs(e, c, 2, 3).count() == 3 and G.k_hop_nodes(e, c, 1).count() == 5
