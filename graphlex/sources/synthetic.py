"""Generated graphs by family, each graph from its own seed, as a Python data source and as a function."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.tokens import FAMILIES
from ..operators.kernels import adjacency, component_sets

SCHEMA = "graph_id string, family string, num_nodes int, edges array<array<int>>, y double"


def chain_components(n: int, edges: set[tuple[int, int]]) -> set[tuple[int, int]]:
    """Joins the smallest nodes of neighbouring components."""
    heads = [c[0] for c in component_sets(adjacency(edges, range(n)))]
    return edges | set(zip(heads, heads[1:], strict=False))


def segments(n: int, r: random.Random, sizes: tuple[int, int], make: Callable[[int, int], set]) -> set[tuple[int, int]]:
    """Blocks of consecutive nodes, each bridged to the next from its end to that one's start."""
    out: set[tuple[int, int]] = set()
    at = 0
    while at < n:
        size = min(n - at, r.randint(*sizes))
        out |= make(at, size)
        if at:
            out.add((at - 1, at))
        at += size
    return out


def ring(at: int, n: int) -> set[tuple[int, int]]:
    return {(at + i, at + i + 1) for i in range(n - 1)} | ({(at, at + n - 1)} if n > 2 else set())


def clique(at: int, n: int) -> set[tuple[int, int]]:
    return {(at + i, at + j) for i in range(n) for j in range(i + 1, n)}


def path(at: int, n: int) -> set[tuple[int, int]]:
    return {(at + i, at + i + 1) for i in range(n - 1)}


def star(at: int, n: int) -> set[tuple[int, int]]:
    return {(at, at + i) for i in range(1, n)}


def make_graph(family: str, n: int, p: float, seed: int) -> list[tuple[int, int]]:
    r = random.Random(seed)
    if family == "ba":
        m, ends, edges = min(4, n - 1), list(range(min(4, n - 1))), set()
        for v in range(m, n):
            to: set[int] = set()
            while len(to) < m:
                to.add(r.choice(ends))
            edges |= {(w, v) for w in to}
            ends += [*to, *[v] * m]
    elif family == "grid":
        w = max(1, int(n**0.5))
        edges = {(i, i + 1) for i in range(n - 1) if (i + 1) % w} | {(i, i + w) for i in range(n - w)}
    elif family == "tree":
        edges = {(r.randrange(v), v) for v in range(1, n)}
    elif family == "cycle":
        edges = ring(0, n) | {tuple(sorted(r.sample(range(n), 2))) for _ in range(n // 6) if n > 3}
    elif family == "star":
        edges = segments(n, r, (4, 7), star)
    elif family == "clique_chain":
        edges = segments(n, r, (3, 5), clique)
    elif family == "motif_mix":
        edges = segments(n, r, (3, 6), lambda at, size: r.choice((path, ring, star, clique))(at, size))
    else:
        edges = {(u, v) for u in range(n) for v in range(u + 1, n) if r.random() < p}
    return sorted((min(e), max(e)) for e in chain_components(n, {e for e in edges if e[0] != e[1]}))


def make_rows(start: int, stop: int, families: tuple[str, ...], smallest: int, largest: int, p: float, seed: int, prefix: str) -> Iterator[tuple]:
    for i in range(start, stop):
        own = seed * 1_000_003 + i
        family = families[i % len(families)]
        n = random.Random(own).randint(smallest, largest)
        yield f"{prefix}{i:05d}", family, n, [list(e) for e in make_graph(family, n, p, own)], float(FAMILIES.index(family) if family in FAMILIES else 0)


class _Range(InputPartition):
    def __init__(self, start: int, stop: int):
        super().__init__((start, stop))
        self.start, self.stop = start, stop


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        o = {k.lower(): v for k, v in options.items()}
        self.n, self.parts = int(o.get("graphs", 120)), int(o.get("partitions", 8))
        self.args = (tuple(o.get("families", ",".join(FAMILIES)).split(",")), int(o.get("min_nodes", 12)), int(o.get("max_nodes", 48)), float(o.get("p", 0.08)), int(o.get("seed", 42)), o.get("prefix", "g_"))

    def partitions(self) -> list[_Range]:
        step = max(1, -(-self.n // self.parts))
        return [_Range(a, min(self.n, a + step)) for a in range(0, self.n, step)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        rows = list(make_rows(partition.start, partition.stop, *self.args))
        kinds = (pa.string(), pa.string(), pa.int32(), pa.list_(pa.list_(pa.int32())), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["graph_id", "family", "num_nodes", "edges", "y"])


class SyntheticGraphs(DataSource):
    """spark.read.format("synthetic_graphs").option("graphs", 1000).load()"""

    @classmethod
    def name(cls) -> str:
        return "synthetic_graphs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def synthetic_graphs(spark: SparkSession, graphs: int = 120, ood: bool = False, **options) -> DataFrame:
    """A table of generated graphs; the out-of-distribution variant is larger and denser."""
    o = {"min_nodes": 12, "max_nodes": 48, "p": 0.08, "seed": 42, **options}
    if ood:
        o |= {"min_nodes": o["max_nodes"], "max_nodes": 2 * o["max_nodes"], "p": 1.6 * o["p"], "prefix": "ood_"}
    spark.dataSource.register(SyntheticGraphs)
    reader = spark.read.format("synthetic_graphs").option("graphs", graphs)
    for k, v in o.items():
        reader = reader.option(k, ",".join(v) if isinstance(v, (list, tuple)) else v)
    return reader.load()
