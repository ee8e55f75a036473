"""Patches: overlapping subgraphs that cover a graph.

Sparse graphs are covered by their edges, which is one window function. Other graphs are cut by a search per graph: structural seeds
are grown, pruned and scored, then chosen by greedy set cover. A patch is stored with local node numbers; `nodes` maps them back.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, fields

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import PATCHES
from . import graph as G
from .kernels import Adjacency, adjacency, component_sets, cycle_basis, edge_list, low_links, maximal_cliques, triangle_list, wl_digest


@dataclass(frozen=True)
class PatchOptions:
    min_size: int = 2
    max_size: int = 9
    max_ports: int = 8
    max_patches_per_graph: int = 384
    overlap_budget: int = 2
    learned_port_subtypes: int = 16
    max_port_capacity: int = 12
    grow_rounds: int = 6
    sparse_edge_patches: bool = False
    sparse_density: float = 0.08
    sparse_clustering: float = 0.05
    weight_inside: float = 1.0
    weight_outside: float = 0.25
    weight_ports: float = 0.20
    weight_cut: float = 0.20
    weight_motif: float = 1.20

    @classmethod
    def of(cls, options: dict | PatchOptions | None) -> PatchOptions:
        if isinstance(options, cls):
            return options
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in (options or {}).items() if k in known})


def stable_subtype(values: tuple, modulus: int) -> int:
    """SHA-1 of the values as a whole number, modulo; 0 for moduli up to 1."""
    return int(hashlib.sha1("|".join(map(str, values)).encode()).hexdigest(), 16) % modulus if modulus > 1 else 0


def visual_key(n: int, edges: list[tuple[int, int]]) -> str:
    """The labelled shape: node count and local edges."""
    return f"{n}:" + ";".join(f"{u}-{v}" for u, v in sorted(edges))


class Proposal:
    """The search on one graph."""

    def __init__(self, adj: Adjacency, options: PatchOptions):
        self.adj, self.o = adj, options
        self.sets = {v: set(a) for v, a in adj.items()}
        self.edges = edge_list(adj)
        self.bridges = set(low_links(adj)[0])
        self.cuts = low_links(adj)[1]
        self.cycles = cycle_basis(adj)
        self.triangles = triangle_list(adj)
        self.motifs = [(frozenset(t), True) for t in self.triangles] + [(frozenset(c), len(c) <= options.max_size + 1) for c in self.cycles]
        self.of_node: dict[int, list[int]] = {}
        for k, (m, _) in enumerate(self.motifs):
            for v in m:
                self.of_node.setdefault(v, []).append(k)

    def inner(self, own: set[int]) -> list[tuple[int, int]]:
        return [(u, v) for u in sorted(own) for v in self.adj[u] if u < v and v in own]

    def boundary(self, own: set[int]) -> set[int]:
        return {v for v in own if not self.sets[v] <= own}

    def score(self, own: set[int]) -> float:
        o, n, e = self.o, len(own), len(self.inner(own))
        leaving = [(min(v, w), max(v, w)) for v in own for w in self.adj[v] if w not in own]
        near = {k for v in own for k in self.of_node.get(v, ())}
        closed = sum(self.motifs[k][0] <= own for k in near)
        cut = sum(self.motifs[k][1] and not self.motifs[k][0] <= own for k in near)
        bridging = sum(x in self.bridges for x in leaving)
        return o.weight_inside * (e / max(1, n * (n - 1) / 2) + e) - o.weight_outside * len(leaving) - o.weight_ports * len(self.boundary(own)) - o.weight_cut * cut + o.weight_motif * closed + 0.25 * bridging

    def seeds(self) -> list[tuple[int, ...]]:
        most = self.o.max_size
        by_degree = sorted((v for v in self.adj if len(self.adj[v]) >= 3), key=lambda v: (-len(self.adj[v]), v))
        found = [
            *self.triangles,
            *(c for c in self.cycles if 3 <= len(c) <= most),
            *maximal_cliques(self.adj, 3, most),
            *((v, *self.adj[v][: most - 1]) for v in by_degree),
            *self.edges,
            *((v, *self.adj[v][: most - 1]) for v in self.cuts),
            *((v,) for v in self.adj),
        ]
        return list(dict.fromkeys(tuple(sorted(set(s))) for s in found))

    def grow(self, own: set[int]) -> set[int]:
        for _ in range(max(1, self.o.grow_rounds)):
            if len(own) >= self.o.max_size:
                break
            base, best = self.score(own), None
            for v in sorted({w for u in own for w in self.adj[u]} - own):
                bigger = own | {v}
                if len(self.boundary(bigger)) <= self.o.max_ports:
                    gain = self.score(bigger) - base
                    if gain > -1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = (gain, v)
            if best is None:
                break
            own = own | {best[1]}
        return own

    def prune(self, own: set[int]) -> set[int]:
        while len(own) > self.o.min_size and (len(own) > self.o.max_size or len(self.boundary(own)) > self.o.max_ports):
            smaller = [own - {v} for v in sorted(own)]
            whole = [s for s in smaller if len(component_sets({v: [w for w in self.adj[v] if w in s] for v in sorted(s)})) == 1] or smaller
            own = max(whole, key=lambda s: (self.score(s), -min(s), -sum(s)))
        return own

    def ports(self, own: list[int], inside: set[int]) -> tuple[list, list, list]:
        o, at = self.o, {v: k for k, v in enumerate(own)}
        through = {v for v in own for w in self.adj[v] if (min(v, w), max(v, w)) not in self.bridges}
        role = lambda v: "cycle-anchor" if v in through else "bridge-port" if self.adj[v] else "chain-end"
        ports, anchors, edge_anchors = [], [], []
        for v in own:
            outside = sum(w not in inside for w in self.adj[v])
            anchors.append((at[v], "node", role(v), stable_subtype((role(v), len(self.adj[v]), at[v]), o.learned_port_subtypes), [at[v]]))
            if outside:
                mode = "CLOSE" if role(v) == "cycle-anchor" else "MERGE"
                ports.append((len(ports), at[v], role(v), mode, min(o.max_port_capacity, outside), stable_subtype((role(v), len(self.adj[v]), outside, at[v]), o.learned_port_subtypes)))
        for k, (u, v) in enumerate(self.inner(inside)):
            edge_role = "bridge-port" if (u, v) in self.bridges else "cycle-anchor"
            edge_anchors.append((k, "edge", edge_role, stable_subtype((len(self.adj[u]), len(self.adj[v]), at[u], at[v]), o.learned_port_subtypes), [at[u], at[v]]))
        return ports, anchors, edge_anchors

    def make(self, inside: set[int]) -> dict:
        own = sorted(inside)
        at = {v: k for k, v in enumerate(own)}
        local = [(at[u], at[v]) for u, v in self.inner(inside)]
        adj = adjacency(local, range(len(own)))
        ports, anchors, edge_anchors = self.ports(own, inside)
        n, e = len(own), len(local)
        degree = [len(a) for a in adj.values()]
        features = {
            "num_nodes": n, "num_edges": e, "density": 2 * e / (n * (n - 1)) if n > 1 else 0.0, "avg_degree": 2 * e / n, "max_degree": max(degree),
            "triangles": sum(set(t) <= inside for t in self.triangles), "cycles": e - n + len(component_sets(adj)), "ports": len(ports),
            "bridge_cuts": sum((u in inside) != (v in inside) for u, v in self.bridges),
        }
        digest = hashlib.sha1(f"{n};{e};{wl_digest(adj)};{sorted(degree)}".encode()).hexdigest()
        return {"nodes": own, "edges": [[own[u], own[v]] for u, v in local], "n": n, "e": e, "ports": ports, "anchors": anchors, "edge_anchors": edge_anchors, "score": self.score(inside), "structural_hash": digest, "visual_key": visual_key(n, local), "features": {k: float(v) for k, v in features.items()}}

    def edge_cover(self) -> list[dict]:
        alone = [{v} for v in self.adj if not self.adj[v]]
        return [self.make(set(x)) for x in [*self.edges, *alone]]

    def sparse(self) -> bool:
        n, e = len(self.adj), len(self.edges)
        if not e or e == n - len(component_sets(self.adj)):
            return True
        corners = dict.fromkeys(self.adj, 0)
        for t in self.triangles:
            for v in t:
                corners[v] += 1
        local = [2 * corners[v] / (d * (d - 1)) if (d := len(a)) > 1 else 0.0 for v, a in self.adj.items()]
        return 2 * e / (n * (n - 1)) <= self.o.sparse_density and sum(local) / n <= self.o.sparse_clustering

    def cover(self, found: list[dict]) -> list[dict]:
        used = dict.fromkeys(self.adj, 0)
        todo, out = set(self.edges), []
        for p in sorted(found, key=lambda p: (-p["score"], p["structural_hash"], p["nodes"])):
            if not todo:
                break
            own = {tuple(x) for x in p["edges"]}
            if own & todo and all(used[v] < self.o.overlap_budget + 1 for v in p["nodes"]):
                out.append(p)
                todo -= own
                for v in p["nodes"]:
                    used[v] += 1
        out += [self.make(set(x)) for x in sorted(todo)]
        seen = {v for p in out for v in p["nodes"]}
        return out + [self.make({v}) for v in self.adj if v not in seen]

    def run(self) -> list[dict]:
        if self.o.sparse_edge_patches and self.sparse():
            return self.edge_cover()[: self.o.max_patches_per_graph]
        best: dict[tuple, dict] = {}
        for seed in self.seeds():
            own = frozenset(self.prune(self.grow(set(seed))))
            if own not in best:
                best[own] = self.make(set(own))
        out = self.cover(list(best.values()))
        return sorted(out, key=lambda p: (p["structural_hash"], -p["e"], p["nodes"]))[: self.o.max_patches_per_graph]


def propose(edges: DataFrame, options: dict | PatchOptions | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """Patches of each graph by search; a graph is one task's input. Columns as schemas.PATCHES, graph_id as a string."""
    o = PatchOptions.of(options)
    rows = edges.select(F.col("graph_id").cast("string").alias("graph_id"), F.col("u").cast("int").alias("u"), F.col("v").cast("int").alias("v"))
    if nodes is not None:
        rows = rows.unionByName(nodes.select(F.col("graph_id").cast("string").alias("graph_id"), F.col("node").cast("int").alias("u"), F.lit(None).cast("int").alias("v")))
    names = ["local_index", "anchor", "role", "mode", "capacity", "subtype"]
    anchor_names = ["local_index", "kind", "role", "subtype", "nodes"]

    def run(own: pd.DataFrame) -> pd.DataFrame:
        pairs = own[own["v"].notna()]
        adj = adjacency(zip(pairs["u"], pairs["v"], strict=True), own["u"])
        name, out = own["graph_id"].iloc[0], []
        for pos, p in enumerate(Proposal(adj, o).run()):
            named = {"ports": [dict(zip(names, x, strict=True)) for x in p["ports"]], **{k: [dict(zip(anchor_names, x, strict=True)) for x in p[k]] for k in ("anchors", "edge_anchors")}}
            out.append({"graph_id": name, "patch_id": f"{name}_{pos:04d}_{p['structural_hash'][:8]}", "pos": pos, **p, **named})
        return pd.DataFrame(out, columns=[c.split()[0] for c in _columns(PATCHES)])

    return rows.groupBy("graph_id").applyInPandas(run, PATCHES)


def _columns(ddl: str) -> list[str]:
    out, depth, start = [], 0, 0
    for k, c in enumerate(ddl + ","):
        depth += (c in "<(") - (c in ">)")
        if c == "," and depth == 0:
            out.append(ddl[start:k].strip())
            start = k + 1
    return out


def edge_cover(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(graph_id, pos, u, v): one patch for each edge in order, `most` of each graph at most. No Python, one shuffle."""
    out = edges.select("graph_id", (F.row_number().over(Window.partitionBy("graph_id").orderBy("u", "v")) - 1).alias("pos"), "u", "v")
    return out if most is None else out.where(F.col("pos") < most)


def residual_edges(edges: DataFrame, patches: DataFrame) -> DataFrame:
    """Edges that no patch (with an `edges` array) covers."""
    covered = patches.select("graph_id", F.explode("edges").alias("x")).select("graph_id", F.col("x")[0].alias("u"), F.col("x")[1].alias("v"))
    return edges.join(covered, ["graph_id", "u", "v"], "left_anti")


def refine_inexact(patches: DataFrame, codes: DataFrame, edges: DataFrame, least_nodes: int = 3) -> DataFrame:
    """Patches without a code of their exact shape (`least_nodes` or more) give way to a patch for each edge that no other patch covers.

    Columns graph_id, pos, nodes, edges, n, e, visual_key; positions are dealt anew.
    """
    some = patches.select("graph_id", "pos", "nodes", "edges", "n", "e", "visual_key")
    exact = some.join(F.broadcast(codes.select("visual_key")), "visual_key", "left_semi").select(*some.columns)
    small = some.join(F.broadcast(codes.select("visual_key")), "visual_key", "left_anti").where(F.col("n") < least_nodes).select(*some.columns)
    kept = exact.unionByName(small)
    left = G.canonical_edges(edges).join(kept.select("graph_id", F.explode("edges").alias("x")).select("graph_id", F.col("x")[0].alias("u"), F.col("x")[1].alias("v")), ["graph_id", "u", "v"], "left_anti")
    single = left.select("graph_id", F.lit(None).cast("int").alias("pos"), F.array("u", "v").alias("nodes"), F.array(F.array("u", "v")).alias("edges"), F.lit(2).alias("n"), F.lit(1).alias("e"), F.lit("2:0-1").alias("visual_key"))
    order = Window.partitionBy("graph_id").orderBy(F.col("pos").asc_nulls_last(), "nodes")
    return kept.unionByName(single).withColumn("pos", F.row_number().over(order) - 1)


