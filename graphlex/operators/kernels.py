"""Searches on one graph that are sequential by nature, in plain Python and numpy; `per_graph` runs them on each graph of a table."""

from __future__ import annotations

import hashlib
from collections import Counter, deque
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Adjacency = dict[int, list[int]]


def adjacency(edges: Iterable[tuple[int, int]], nodes: Iterable[int] = ()) -> Adjacency:
    out: dict[int, set[int]] = {int(v): set() for v in nodes}
    for u, v in edges:
        if u != v:
            out.setdefault(int(u), set()).add(int(v))
            out.setdefault(int(v), set()).add(int(u))
    return {v: sorted(out[v]) for v in sorted(out)}


def edge_list(adj: Adjacency) -> list[tuple[int, int]]:
    return [(u, v) for u, around in adj.items() for v in around if u < v]


def low_links(adj: Adjacency) -> tuple[list[tuple[int, int]], list[int]]:
    """(bridges, cut vertices) by an iterative depth-first search with low links."""
    order: dict[int, int] = {}
    low: dict[int, int] = {}
    bridges, cuts = [], set()
    for root in adj:
        if root in order:
            continue
        order[root] = low[root] = len(order)
        stack = [(root, -1, iter(adj[root]))]
        children = 0
        while stack:
            v, parent, around = stack[-1]
            for w in around:
                if w not in order:
                    order[w] = low[w] = len(order)
                    stack.append((w, v, iter(adj[w])))
                    children += v == root
                    break
                if w != parent:
                    low[v] = min(low[v], order[w])
            else:
                stack.pop()
                if stack:
                    up = stack[-1][0]
                    low[up] = min(low[up], low[v])
                    if low[v] > order[up]:
                        bridges.append((min(up, v), max(up, v)))
                    if up != root and low[v] >= order[up]:
                        cuts.add(up)
        if children > 1:
            cuts.add(root)
    return sorted(bridges), sorted(cuts)


def component_sets(adj: Adjacency) -> list[list[int]]:
    seen: set[int] = set()
    out = []
    for root in adj:
        if root in seen:
            continue
        todo, own = [root], []
        seen.add(root)
        while todo:
            v = todo.pop()
            own.append(v)
            for w in adj[v]:
                if w not in seen:
                    seen.add(w)
                    todo.append(w)
        out.append(sorted(own))
    return out


def cycle_basis(adj: Adjacency) -> list[tuple[int, ...]]:
    """Node sets of the fundamental cycles of breadth-first trees from each component's smallest node, by (length, nodes)."""
    parent: dict[int, int] = {}
    depth: dict[int, int] = {}
    out = set()
    for root in adj:
        if root in depth:
            continue
        parent[root], depth[root] = root, 0
        queue = deque([root])
        extra = []
        while queue:
            v = queue.popleft()
            for w in adj[v]:
                if w not in depth:
                    parent[w], depth[w] = v, depth[v] + 1
                    queue.append(w)
                elif w != parent[v] and v < w and parent[w] != v:
                    extra.append((v, w))
        for v, w in extra:
            path = {v, w}
            while v != w:
                if depth[v] < depth[w]:
                    v, w = w, v
                v = parent[v]
                path.add(v)
            out.add(tuple(sorted(path)))
    return sorted(out, key=lambda c: (len(c), c))


def triangle_list(adj: Adjacency) -> list[tuple[int, int, int]]:
    sets = {v: set(a) for v, a in adj.items()}
    return [(u, v, w) for u in adj for v in adj[u] if v > u for w in adj[v] if w > v and w in sets[u]]


def maximal_cliques(adj: Adjacency, least: int = 3, most: int = 1 << 30) -> list[tuple[int, ...]]:
    """Maximal cliques with `least` to `most` nodes, by (-size, nodes). Bron-Kerbosch with pivots, on an explicit stack."""
    sets = {v: set(a) for v, a in adj.items()}
    out = []
    todo = [(set(), set(adj), set())]
    while todo:
        r, p, x = todo.pop()
        if not p and not x:
            if least <= len(r) <= most:
                out.append(tuple(sorted(r)))
            continue
        pivot = max(p | x, key=lambda v: len(p & sets[v]))
        for v in sorted(p - sets[pivot]):
            todo.append((r | {v}, p & sets[v], x & sets[v]))
            p = p - {v}
            x = x | {v}
    return sorted(out, key=lambda c: (-len(c), c))


def refined_colours(adj: Adjacency, rounds: int | None = None) -> dict[int, str]:
    """Colour refinement until the partition is stable (or for some rounds); colours are digests, comparable across graphs."""
    colour = {v: str(len(a)) for v, a in adj.items()}
    classes = len(set(colour.values()))
    k = 0
    while rounds is None or k < rounds:
        colour = {v: hashlib.sha1("|".join([colour[v], *sorted(colour[w] for w in adj[v])]).encode()).hexdigest()[:16] for v in adj}
        k += 1
        now = len(set(colour.values()))
        if rounds is None and now == classes:
            break
        classes = now
    return colour


def wl_digest(adj: Adjacency, rounds: int = 3) -> str:
    return hashlib.sha1(",".join(f"{c}:{n}" for c, n in sorted(Counter(refined_colours(adj, rounds).values()).items())).encode()).hexdigest()


class Undecided(Exception):
    """A search took more steps than it may."""


def isomorphism(a: Adjacency, b: Adjacency, steps: int = 1_000_000) -> dict[int, int] | None:
    """A mapping of a's nodes to b's that keeps all edges, None if there is none; Undecided after `steps` and 100 more a node.

    Colour refinement prunes, then nodes are matched along a connected order with backtracking.
    """
    if len(a) != len(b) or sum(map(len, a.values())) != sum(map(len, b.values())):
        return None
    n = max(1, len(a))
    ca, cb = refined_colours(a, min(n, 8)), refined_colours(b, min(n, 8))
    if Counter(ca.values()) != Counter(cb.values()):
        return None
    size = Counter(ca.values())
    by_colour: dict[str, list[int]] = {}
    for v in b:
        by_colour.setdefault(cb[v], []).append(v)
    order: list[int] = []
    placed: set[int] = set()
    for start in sorted(a, key=lambda v: (size[ca[v]], -len(a[v]), v)):
        if start in placed:
            continue
        queue = deque([start])
        placed.add(start)
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in sorted(a[v], key=lambda w: (size[ca[w]], w)):
                if w not in placed:
                    placed.add(w)
                    queue.append(w)
    where = {v: k for k, v in enumerate(order)}
    before = [[w for w in a[v] if where[w] < k] for k, v in enumerate(order)]
    sets = {v: set(x) for v, x in b.items()}
    to: dict[int, int] = {}
    used: set[int] = set()

    def options(k: int):
        v = order[k]
        pool = [w for w in b[to[before[k][0]]] if cb[w] == ca[v]] if before[k] else by_colour[ca[v]]
        return iter([w for w in pool if w not in used and all(to[u] in sets[w] for u in before[k])])

    stack = [options(0)] if order else []
    steps += 100 * len(a)
    while stack and len(to) < len(order):
        steps -= 1
        if steps < 0:
            raise Undecided
        k = len(stack) - 1
        if order[k] in to:
            used.discard(to.pop(order[k]))
        w = next(stack[-1], None)
        if w is None:
            stack.pop()
            continue
        to[order[k]] = w
        used.add(w)
        if len(to) < len(order):
            stack.append(options(k + 1))
    return to if len(to) == len(order) else None


def spectrum(adj: Adjacency, k: int = 10) -> np.ndarray:
    """The k smallest eigenvalues of the normalised Laplacian, padded with zeros."""
    out = np.zeros(k)
    if adj:
        at = {v: i for i, v in enumerate(adj)}
        m = np.zeros((len(adj), len(adj)))
        for u, v in edge_list(adj):
            m[at[u], at[v]] = m[at[v], at[u]] = 1
        d = m.sum(axis=1)
        s = np.divide(1, np.sqrt(d), out=np.zeros_like(d), where=d > 0)
        values = np.linalg.eigvalsh(np.diag((d > 0).astype(float)) - s[:, None] * m * s[None, :])[:k]
        out[: len(values)] = values
    return out


def traversal(adj: Adjacency, breadth_first: bool) -> list[str]:
    """START and T tokens of tree edges, from the node of highest degree (the smallest such), then from each component's smallest node.

    Every node is visited once; later components are not walked again from each of their nodes.
    """
    if not adj:
        return []
    first = min(adj, key=lambda v: (-len(adj[v]), v))
    seen: set[int] = set()
    out = []
    for root in [first, *adj]:
        if root in seen:
            continue
        out.append(f"START({root})")
        seen.add(root)
        if breadth_first:
            queue = deque([root])
            while queue:
                v = queue.popleft()
                for w in adj[v]:
                    if w not in seen:
                        seen.add(w)
                        out.append(f"T({v},{w})")
                        queue.append(w)
        else:
            stack = [(root, iter(adj[root]))]
            while stack:
                v, around = stack[-1]
                w = next((w for w in around if w not in seen), None)
                if w is None:
                    stack.pop()
                    continue
                seen.add(w)
                out.append(f"T({v},{w})")
                stack.append((w, iter(adj[w])))
    return out


def edge_walk(adj: Adjacency) -> list[str]:
    """START and WALK tokens that pass each edge once, components by their busiest node, neighbours by (-degree, id)."""
    out, passed = [], set()
    key = lambda v: (-len(adj[v]), v)
    for own in sorted(component_sets(adj), key=lambda c: min(map(key, c))):
        root = min(own, key=key)
        out.append(f"START({root})")
        stack = [(root, iter(sorted(adj[root], key=key)))]
        while stack:
            v, around = stack[-1]
            w = next((w for w in around if (min(v, w), max(v, w)) not in passed), None)
            if w is None:
                stack.pop()
                continue
            passed.add((min(v, w), max(v, w)))
            out.append(f"WALK({v},{w})")
            stack.append((w, iter(sorted(adj[w], key=key))))
    return out


def per_graph(edges: DataFrame, kernel: Callable[[Adjacency], list[tuple]], schema: str, nodes: DataFrame | None = None) -> DataFrame:
    """Rows (graph_id, *row) of the kernel for each graph. A graph is one task's input, so this is for graphs that fit a worker."""
    id_type = dict(edges.dtypes)["graph_id"]
    rows = edges.select("graph_id", "u", "v")
    if nodes is not None:
        rows = rows.unionByName(nodes.select("graph_id", F.col("node").cast(dict(edges.dtypes)["u"]).alias("u"), F.lit(None).cast(dict(edges.dtypes)["v"]).alias("v")))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(own: pd.DataFrame) -> pd.DataFrame:
        pairs = own[own["v"].notna()]
        adj = adjacency(zip(pairs["u"], pairs["v"], strict=True), own.loc[own["v"].isna(), "u"])
        out = pd.DataFrame(kernel(adj), columns=names)
        out.insert(0, "graph_id", own["graph_id"].iloc[0])
        return out

    return rows.groupBy("graph_id").applyInPandas(run, f"graph_id {id_type}, {schema}")


def bridges(edges: DataFrame) -> DataFrame:
    return per_graph(edges, lambda adj: low_links(adj)[0], "u int, v int")


def cut_vertices(edges: DataFrame) -> DataFrame:
    return per_graph(edges, lambda adj: [(v,) for v in low_links(adj)[1]], "node int")


def cycles(edges: DataFrame) -> DataFrame:
    return per_graph(edges, lambda adj: [(k, len(c), ",".join(map(str, c))) for k, c in enumerate(cycle_basis(adj))], "cycle int, length int, nodes string")


def cliques(edges: DataFrame, least: int = 3, most: int = 9) -> DataFrame:
    return per_graph(edges, lambda adj: [(k, len(c), ",".join(map(str, c))) for k, c in enumerate(maximal_cliques(adj, least, most))], "clique int, size int, nodes string")
