"""Programs: compiling patches to actions, executing actions, and what both cost.

With the default codebook a program holds EMIT and MERGE_NODE only, and both directions are relational: a reference is the distance to
the latest earlier anchor of the same node (a window), and executing merges is finding connected components of anchors. Programs with
ports, interfaces and links run on `Machine`, a state machine for one graph.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import GROUPS, OPS, op_of, render
from . import graph as G


def compile_patches(patches: DataFrame, ref_window: int = 768, block_size: int = 12, blocks: bool = True) -> DataFrame:
    """Actions (graph_id, pos, op, args) of patches (graph_id, pos, nodes, code): blocks, EMIT, and MERGE_NODE for every node seen before.

    `nodes` lists a patch's nodes by local number. An anchor's number counts the local nodes emitted before it.
    """
    before = F.coalesce(F.sum(F.size("nodes")).over(Window.partitionBy("graph_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("graph_id").orderBy("pos")) - 1
    rows = patches.select("graph_id", "pos", "nodes", "code", before.alias("base"), rank.alias("rank"))
    local = rows.select("graph_id", "rank", "base", F.posexplode("nodes").alias("i", "node"))
    last = F.lag(F.col("base") + F.col("i")).over(Window.partitionBy("graph_id", "node").orderBy("rank", "i"))
    merges = local.withColumn("ref", F.col("base") - last).where(F.col("ref") <= ref_window)
    # Places in a program: within a patch 0 BEGIN_BLOCK, 1 EMIT, 2 merges by (anchor, reference), 3 END_BLOCK.
    none = F.array().cast("array<int>")
    place = lambda k, i: F.struct(F.col("rank").cast("long").alias("r"), F.lit(k).alias("k"), i.cast("int").alias("i"))
    zero = F.lit(0)
    parts = [
        rows.select("graph_id", place(1, zero).alias("at"), F.lit("EMIT").alias("op"), F.array(F.col("code").cast("int")).alias("args")),
        merges.select("graph_id", place(2, F.col("i")).alias("at"), F.lit("MERGE_NODE").alias("op"), F.array(F.col("i").cast("int"), F.col("ref").cast("int")).alias("args")),
    ]
    if blocks:
        last_rank = F.max("rank").over(Window.partitionBy("graph_id"))
        ends = rows.select("graph_id", "rank", last_rank.alias("last"))
        parts.append(ends.where(F.col("rank") % block_size == 0).select("graph_id", place(0, zero).alias("at"), F.lit("BEGIN_BLOCK").alias("op"), none.alias("args")))
        parts.append(ends.where((F.col("rank") % block_size == block_size - 1) | (F.col("rank") == F.col("last"))).select("graph_id", place(3, zero).alias("at"), F.lit("END_BLOCK").alias("op"), none.alias("args")))
    every = patches.select("graph_id").distinct()
    big = 1 << 60
    for r, op in ((-1, "BEGIN_GRAPH"), (big, "END_GRAPH"), (big + 1, "STOP")):
        parts.append(every.select("graph_id", F.struct(F.lit(r).cast("long").alias("r"), F.lit(0).alias("k"), F.lit(0).cast("int").alias("i")).alias("at"), F.lit(op).alias("op"), none.alias("args")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("graph_id", (F.row_number().over(Window.partitionBy("graph_id").orderBy("at")) - 1).alias("pos"), "op", "args")


def compile_edge_cover(edges: DataFrame, ref_window: int = 20_000, block_size: int = 64, most: int | None = None) -> DataFrame:
    """The program of a graph's edges in order; each patch has code 0."""
    from .patches import edge_cover

    cover = edge_cover(edges, most).select("graph_id", "pos", F.array("u", "v").alias("nodes"), F.lit(0).alias("code"))
    return compile_patches(cover, ref_window, block_size)


def tokens(actions: DataFrame) -> DataFrame:
    """(graph_id, pos, tok)."""
    return actions.select("graph_id", "pos", render(F.col("op"), F.col("args")).alias("tok"))


def sequences(actions: DataFrame) -> DataFrame:
    """(graph_id, tokens): a program's tokens as an array."""
    pairs = F.array_sort(F.collect_list(F.struct("pos", "tok")))
    return tokens(actions).groupBy("graph_id").agg(F.transform(pairs, lambda x: x["tok"]).alias("tokens"))


def action_bits(codebook_size: int, ref_window: int, length: Column, base: float = 0.0, interface: int | None = None) -> Column:
    """The cost of an action in bits by its op; `length` is the program's number of actions."""
    import math

    code, ref = math.log2(max(2, codebook_size)), math.log2(max(2, ref_window))
    cost = F.when(F.col("op") == "EMIT", code).when(F.col("op") == "INTERFACE", math.log2(max(2, interface)) if interface else code)
    cost = cost.when(F.col("op").isin("ATTACH", "CLOSE_CYCLE", "MERGE_NODE", "MERGE_EDGE"), ref + 4.0).when(F.col("op") == "GLOBAL_LINK", 2 * F.log2(F.greatest(F.lit(2), length)))
    return F.lit(base) + cost.otherwise(F.lit(0.0 if base else 1.0))


def program_bits(actions: DataFrame, codebook_size: int, ref_window: int) -> DataFrame:
    """(graph_id, n_tokens, bits): 1.5 bits for each token and what its arguments cost."""
    n = F.count("*").over(Window.partitionBy("graph_id"))
    return actions.withColumn("bits", action_bits(codebook_size, ref_window, n, 1.5)).groupBy("graph_id").agg(F.count("*").alias("n_tokens"), F.sum("bits").alias("bits"))


def compression(actions: DataFrame, codebook_size: int, ref_window: int) -> DataFrame:
    """(graph_id, n_actions, bits, share of each op): arguments only, other actions cost one bit."""
    n = F.count("*").over(Window.partitionBy("graph_id"))
    rows = actions.withColumn("bits", action_bits(codebook_size, ref_window, n, 0.0, ref_window))
    share = [(F.count(F.when(F.col("op") == op, 1)) / F.count("*")).alias(f"{op.lower()}_rate") for op in ("EMIT", "INTERFACE", "ATTACH", "CLOSE_CYCLE", "MERGE_NODE", "MERGE_EDGE", "GLOBAL_LINK")]
    return rows.groupBy("graph_id").agg(F.count("*").alias("n_actions"), F.sum("bits").alias("bits"), *share)


def decode(actions: DataFrame, codes: DataFrame) -> DataFrame:
    """The edges (graph_id, u, v) that EMIT and MERGE_NODE actions build; nodes are numbered by first anchor from 0.

    codes: (code, n, edges array<array<int>>), small. A merge joins an anchor with one `ref` before its patch: components of anchors.
    """
    size = F.broadcast(codes.select(F.col("code").cast("int").alias("code"), "n", F.col("edges").alias("shape")))
    acts = actions.where(F.col("op").isin("EMIT", "MERGE_NODE"))
    emits = acts.where("op = 'EMIT'").select("graph_id", "pos", F.col("args")[0].alias("code")).join(size, "code")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("graph_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    emits = emits.select("graph_id", "pos", before.cast("int").alias("base"), "n", "shape")
    # The patch of a merge is the latest EMIT before it.
    both = emits.select("graph_id", "pos", "base", F.lit(None).cast("array<int>").alias("args")).unionByName(acts.where("op = 'MERGE_NODE'").select("graph_id", "pos", F.lit(None).cast("int").alias("base"), "args"))
    base = F.last("base", ignorenulls=True).over(Window.partitionBy("graph_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    links = both.withColumn("base", base).where("args IS NOT NULL").select("graph_id", (F.col("base") + F.col("args")[0]).alias("u"), (F.col("base") - F.col("args")[1]).alias("v"))
    anchors = emits.select("graph_id", F.explode(F.sequence(F.col("base"), F.col("base") + F.col("n") - 1)).alias("node"))
    part = G.components(G.canonical_edges(links), anchors)
    number = part.withColumn("id", F.dense_rank().over(Window.partitionBy("graph_id").orderBy("component")) - 1).select("graph_id", "node", "id")
    inner = emits.select("graph_id", "base", F.explode("shape").alias("x")).select("graph_id", (F.col("base") + F.col("x")[0]).alias("a"), (F.col("base") + F.col("x")[1]).alias("b"))
    ends = inner.join(number.select("graph_id", F.col("node").alias("a"), F.col("id").alias("u")), ["graph_id", "a"]).join(number.select("graph_id", F.col("node").alias("b"), F.col("id").alias("v")), ["graph_id", "b"])
    return G.canonical_edges(ends.select("graph_id", "u", "v"))


class Machine:
    """The state of a program with ports, anchors, interfaces and links, for one graph."""

    PAIRS = ("ATTACH", "CLOSE_CYCLE", "MERGE_NODE", "MERGE_EDGE", "GLOBAL_LINK")

    def __init__(self, codes: dict[int, dict], interfaces: dict[int, dict] | None = None, ref_window: int = 16, close_consumes_all: bool = False):
        self.codes, self.interfaces, self.window, self.close_all = codes, interfaces or {}, ref_window, close_consumes_all
        self.parent: list[int] = []
        self.edges: set[tuple[int, int]] = set()
        self.ports: list[dict] = []
        self.anchors: dict[str, list[dict]] = {"node": [], "edge": []}
        self.current: dict[str, list[int]] = {"port": [], "node": [], "edge": []}
        self.started = self.ended = self.stopped = False
        self.depth = 0
        self.n: Counter = Counter()

    def find(self, v: int) -> int:
        while self.parent[v] != v:
            self.parent[v] = self.parent[self.parent[v]]
            v = self.parent[v]
        return v

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)

    def link(self, a: int, b: int) -> bool:
        a, b = sorted((self.find(a), self.find(b)))
        if a == b or (a, b) in {tuple(sorted((self.find(x), self.find(y)))) for x, y in self.edges}:
            self.n["duplicate_edges"] += 1
            return False
        self.edges.add((a, b))
        return True

    def recent(self, kind: str, open_only: bool = False, everywhere: bool = False) -> list[int]:
        """Indexes, newest first, of ports or anchors outside the current patch and inside the window."""
        rows = self.ports if kind == "port" else self.anchors[kind]
        now = set() if everywhere else set(self.current[kind])
        out = [k for k in range(len(rows) - 1, -1, -1) if k not in now and not (open_only and rows[k]["used"] >= rows[k]["capacity"])]
        return out if everywhere else out[: self.window]

    def install(self, base: int, n: int, shape: Iterable, ports: Iterable, anchors: Iterable, edge_anchors: Iterable) -> None:
        self.current = {"port": [], "node": [], "edge": []}
        ports, anchors, edge_anchors = list(ports), list(anchors), list(edge_anchors)
        if not (ports or anchors or edge_anchors):
            anchors = [{"nodes": [i], "role": "generic-port"} for i in range(n)]
            edge_anchors = [{"nodes": list(e), "role": "generic-port"} for e in shape]
        for p in ports:
            self.current["port"].append(len(self.ports))
            self.ports.append({"node": base + p["anchor"], "capacity": p["capacity"], "used": 0, "role": p.get("role", "generic-port")})
        for kind, rows in (("node", anchors), ("edge", edge_anchors)):
            for a in rows:
                self.current[kind].append(len(self.anchors[kind]))
                self.anchors[kind].append({"nodes": [base + v for v in a["nodes"]], "role": a["role"]})

    def legal(self, op: str, args: list[int]) -> bool:
        """Whether an action would run without an error or a bad reference."""
        body = self.started and not self.ended and not self.stopped
        if op == "BEGIN_GRAPH":
            return not self.started
        if op == "END_GRAPH":
            return body and self.depth == 0
        if op == "STOP":
            return self.ended and not self.stopped
        if op == "END_BLOCK":
            return body and self.depth > 0
        if not body or any(a < 0 for a in args):
            return False
        if op == "BEGIN_BLOCK":
            return True
        if op in ("EMIT", "INTERFACE"):
            return len(args) == 1 and args[0] in (self.codes if op == "EMIT" else self.interfaces) and (op == "EMIT" or bool(self.parent))
        if op not in self.PAIRS or len(args) != 2:
            return False
        if op == "GLOBAL_LINK":
            n = len(self.ports)
            return 1 <= args[0] <= n and 1 <= args[1] <= n and args[0] != args[1]
        kind = {"ATTACH": "port", "CLOSE_CYCLE": "port", "MERGE_NODE": "node", "MERGE_EDGE": "edge"}[op]
        here = self.current[kind]
        if args[0] >= len(here) or not 1 <= args[1] <= len(self.recent(kind, kind == "port")):
            return False
        return kind != "port" or self.ports[here[args[0]]]["used"] < self.ports[here[args[0]]]["capacity"]

    def step(self, op: str, args: list[int]) -> None:
        self.n["executed"] += 1
        body = op in OPS and op not in ("BEGIN_GRAPH", "STOP")
        if self.stopped or (body and (not self.started or self.ended)):
            self.n["illegal"] += 1
            return
        try:
            getattr(self, f"do_{op.lower()}")(*args)
        except (TypeError, ValueError, IndexError, KeyError, AttributeError):
            self.n["runtime_errors"] += 1
            self.n["illegal"] += 1

    def mark(self, good: bool) -> bool:
        self.n["illegal"] += not good
        return good

    def do_begin_graph(self) -> None:
        if self.mark(not self.started):
            self.started = True

    def do_end_graph(self) -> None:
        if self.mark(self.depth == 0):
            self.ended = True

    def do_stop(self) -> None:
        if self.mark(self.ended):
            self.stopped = True

    def do_begin_block(self) -> None:
        self.depth += 1

    def do_end_block(self) -> None:
        if self.mark(self.depth > 0):
            self.depth -= 1

    def do_emit(self, code: int) -> None:
        c = self.codes[code]
        base = len(self.parent)
        self.parent += range(base, base + c["n"])
        self.edges |= {(base + u, base + v) for u, v in c["edges"]}
        self.base, self.size = base, c["n"]
        self.install(base, c["n"], c["edges"], c.get("ports", ()), c.get("anchors", ()), c.get("edge_anchors", ()))

    def do_interface(self, number: int) -> None:
        i = self.interfaces[number]
        self.install(self.base, self.size, (), i["ports"], i["anchors"], i["edge_anchors"])

    def reference(self, kind: str, ref: int, rows: list[int]) -> int | None:
        if not 1 <= ref <= len(rows):
            self.n["invalid_refs"] += 1
            return None
        return rows[ref - 1]

    def do_attach(self, port: int, ref: int, close: bool = False) -> None:
        other = self.reference("port", ref, self.recent("port", True))
        if port >= len(self.current["port"]):
            self.n["invalid_refs"] += 1
            return
        if other is None:
            return
        mine, its = self.ports[self.current["port"][port]], self.ports[other]
        if mine["used"] >= mine["capacity"]:
            self.n["capacity_violations"] += 1
        self.link(mine["node"], its["node"])
        for p in (mine, its):
            p["used"] = p["capacity"] if close and self.close_all else p["used"] + 1
        self.n["attached"] += 1

    def do_close_cycle(self, port: int, ref: int) -> None:
        self.do_attach(port, ref, True)

    def merge(self, kind: str, anchor: int, ref: int) -> None:
        other = self.reference(kind, ref, self.recent(kind))
        if anchor >= len(self.current[kind]):
            self.n["invalid_refs"] += 1
            return
        if other is None:
            return
        mine, its = self.anchors[kind][self.current[kind][anchor]], self.anchors[kind][other]
        self.n["merges"] += 1
        self.n["type_mismatches"] += mine["role"] != its["role"] and "generic-port" not in (mine["role"], its["role"])
        for a, b in zip(mine["nodes"], its["nodes"], strict=True):
            self.union(a, b)

    def do_merge_node(self, anchor: int, ref: int) -> None:
        self.merge("node", anchor, ref)

    def do_merge_edge(self, anchor: int, ref: int) -> None:
        self.merge("edge", anchor, ref)

    def do_global_link(self, a: int, b: int) -> None:
        rows = self.recent("port", everywhere=True)
        x, y = self.reference("port", a, rows), self.reference("port", b, rows)
        if x is None or y is None or x == y:
            self.n["invalid_refs"] += x is not None and x == y
            return
        self.link(self.ports[x]["node"], self.ports[y]["node"])
        for k in (x, y):
            self.ports[k]["used"] += self.ports[k]["used"] < self.ports[k]["capacity"]

    def legal_tokens(self) -> list[str]:
        """All tokens that are legal now: the mask for constrained generation."""
        out = [op for op in ("BEGIN_GRAPH", "END_GRAPH", "STOP", "BEGIN_BLOCK", "END_BLOCK") if self.legal(op, [])]
        out += [f"EMIT({c})" for c in sorted(self.codes) if self.legal("EMIT", [c])]
        out += [f"INTERFACE({c})" for c in sorted(self.interfaces) if self.legal("INTERFACE", [c])]
        for op, kind in (("ATTACH", "port"), ("CLOSE_CYCLE", "port"), ("MERGE_NODE", "node"), ("MERGE_EDGE", "edge")):
            for i in range(len(self.current[kind])):
                for ref in range(1, len(self.recent(kind, kind == "port")) + 1):
                    if self.legal(op, [i, ref]):
                        out.append(f"{op}({i},{ref})")
        if self.legal("GLOBAL_LINK", [1, 2]):
            n = min(self.window, len(self.ports))
            out += [f"GLOBAL_LINK({a},{b})" for a in range(1, n + 1) for b in range(1, n + 1) if a != b]
        return out

    def graph(self) -> tuple[int, list[tuple[int, int]]]:
        roots = {r: k for k, r in enumerate(sorted({self.find(v) for v in range(len(self.parent))}))}
        ends = {tuple(sorted((roots[self.find(u)], roots[self.find(v)]))) for u, v in self.edges}
        return len(roots), sorted((u, v) for u, v in ends if u != v)

    def executability(self) -> dict[str, float]:
        n = max(1, self.n["executed"])
        whole = self.started and self.ended and self.stopped and self.depth == 0
        rates = {k: self.n[k] / n for k in ("illegal", "runtime_errors", "invalid_refs", "capacity_violations", "duplicate_edges", "type_mismatches")}
        dangling = sum(p["used"] < p["capacity"] for p in self.ports) / max(1, len(self.ports))
        return {"executable": float(whole and not self.n["illegal"]), **{f"{k}_rate": v for k, v in rates.items()}, "dangling_rate": dangling, "n_executed": float(self.n["executed"])}


def parse(token: str) -> tuple[str, list[int]]:
    op, _, rest = token.partition("(")
    rest = rest.rstrip(")")
    return op, [int(x) for x in rest.split(",")] if rest else []


def run_tokens(tokens: Iterable[str], codes: dict[int, dict], interfaces: dict[int, dict] | None = None, ref_window: int = 768) -> Machine:
    m = Machine(codes, interfaces, ref_window)
    for t in tokens:
        try:
            m.step(*parse(t))
        except ValueError:
            m.n["executed"] += 1
            m.n["runtime_errors"] += 1
            m.n["illegal"] += 1
    return m


EXECUTED = "graph_id string, num_nodes int, edges array<array<int>>, executable double, illegal_rate double, runtime_errors_rate double, invalid_refs_rate double, capacity_violations_rate double, duplicate_edges_rate double, type_mismatches_rate double, dangling_rate double, n_executed double"


def execute(programs: DataFrame, codes: dict[int, dict], interfaces: dict[int, dict] | None = None, ref_window: int = 768) -> DataFrame:
    """Runs programs (graph_id, tokens array<string>), one a row: the graph and its rates."""

    def run(batches):
        for own in batches:
            rows = []
            for name, toks in zip(own["graph_id"], own["tokens"], strict=True):
                m = run_tokens(toks, codes, interfaces, ref_window)
                n, e = m.graph()
                rows.append({"graph_id": str(name), "num_nodes": n, "edges": [list(x) for x in e], **m.executability()})
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in EXECUTED.split(", ")])

    return programs.select(F.col("graph_id").cast("string").alias("graph_id"), "tokens").mapInPandas(run, EXECUTED)


def lifecycle(actions: DataFrame) -> DataFrame:
    """(graph_id, n_actions, well_formed): one BEGIN_GRAPH first, END_GRAPH and STOP last, blocks balanced and never below zero."""
    w = Window.partitionBy("graph_id").orderBy("pos")
    depth = F.sum(F.when(F.col("op") == "BEGIN_BLOCK", 1).when(F.col("op") == "END_BLOCK", -1).otherwise(0)).over(w)
    rows = actions.withColumn("depth", depth).withColumn("last", F.max("pos").over(Window.partitionBy("graph_id")))
    good = F.when(F.col("op") == "BEGIN_GRAPH", F.col("pos") == 0).when(F.col("op") == "STOP", F.col("pos") == F.col("last")).when(F.col("op") == "END_GRAPH", (F.col("pos") == F.col("last") - 1) & (F.col("depth") == 0)).otherwise(F.col("depth") >= 0)
    ends = F.count(F.when(F.col("op").isin("BEGIN_GRAPH", "END_GRAPH", "STOP"), 1)) == 3
    return rows.groupBy("graph_id").agg(F.count("*").alias("n_actions"), (F.every(good) & ends & F.every(F.col("op").isin(*OPS))).alias("well_formed"))


def op_histogram(sequences: DataFrame) -> DataFrame:
    """(op, n) over token sequences (tokens)."""
    return sequences.select(F.explode("tokens").alias("tok")).groupBy(op_of(F.col("tok")).alias("op")).agg(F.count("*").alias("n"))


def group_name(op: Column) -> Column:
    out = F.lit(None)
    for k, v in GROUPS.items():
        out = F.when(op == k, v).otherwise(out)
    return out
