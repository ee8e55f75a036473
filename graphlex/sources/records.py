"""Readers and writers of graph records, token examples and reports."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tokens import FORBIDDEN_KEYS, forbidden_keys
from ..schemas import GRAPH_RECORD, PROGRAM, TOKEN_EXAMPLE


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line; a path that does not exist gives an empty table."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def canonical_record(rows: DataFrame) -> DataFrame:
    """Edges sorted and distinct without loops, ends sorted unless directed. Targets stay fractions; types and attributes of edges stay."""
    ends = F.transform("edges", lambda e: F.when(F.coalesce(F.col("directed"), F.lit(False)), e).otherwise(F.array_sort(e)))
    edges = F.array_sort(F.array_distinct(F.filter(ends, lambda e: e[0] != e[1])))
    return rows.withColumn("edges", F.coalesce(edges, F.array().cast("array<array<int>>"))).withColumn("directed", F.coalesce("directed", F.lit(False)))


def read_graphs(spark: SparkSession, path: str) -> DataFrame:
    return canonical_record(read_jsonl(spark, path, GRAPH_RECORD))


def write_graphs(rows: DataFrame, path: str) -> None:
    write_jsonl(rows, path)


def edges_of(records: DataFrame) -> DataFrame:
    """(graph_id, u, v) of records."""
    return records.select("graph_id", F.explode("edges").alias("e")).select("graph_id", F.col("e")[0].alias("u"), F.col("e")[1].alias("v"))


def records_of(edges: DataFrame, graphs: DataFrame) -> DataFrame:
    """Records of long edges and (graph_id, num_nodes, ...); graphs without edges stay."""
    own = edges.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.array("u", "v"))).alias("edges"))
    return graphs.join(own, "graph_id", "left").withColumn("edges", F.coalesce("edges", F.array().cast("array<array<int>>")))


def assert_no_leak(rows: DataFrame) -> None:
    """Raises if a field of the schema, at any depth, names part of the graph that a program must not give away."""
    found = []

    def walk(t, path: str) -> None:
        for f in getattr(t, "fields", ()):
            if f.name in FORBIDDEN_KEYS:
                found.append(f"{path}{f.name}")
            walk(f.dataType, f"{path}{f.name}.")
        if hasattr(t, "elementType"):
            walk(t.elementType, path)
        if hasattr(t, "valueType"):
            walk(t.valueType, path)

    walk(rows.schema, "")
    if found:
        raise ValueError("fields that give the graph away: " + ", ".join(found[:20]))


def leaking_rows(rows: DataFrame, json_column: str) -> DataFrame:
    """Rows whose free-form JSON has such a key."""
    return rows.withColumn("leaks", forbidden_keys(F.col(json_column))).where(F.size("leaks") > 0)


def write_programs(actions: DataFrame, path: str) -> None:
    """Programs as JSON lines, after the audit."""
    rows = actions.groupBy("graph_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "op", "args"))), lambda x: F.struct(x["op"].alias("op"), x["args"].alias("args"))).alias("actions"))
    assert_no_leak(rows)
    write_jsonl(rows, path)


def read_programs(spark: SparkSession, path: str) -> DataFrame:
    """(graph_id, pos, op, args)."""
    rows = read_jsonl(spark, path, PROGRAM)
    return rows.select("graph_id", F.posexplode("actions").alias("pos", "a")).select("graph_id", "pos", "a.op", "a.args")


def write_examples(rows: DataFrame, path: str) -> None:
    write_jsonl(rows, path)


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    rows = read_jsonl(spark, path, TOKEN_EXAMPLE)
    return rows.withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>"))).withColumn("split", F.coalesce("split", F.lit("train")))


def write_report(rows: list[DataFrame], path: str) -> None:
    """Reports with different columns as one CSV folder; the header is the sorted union of the columns."""
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    out.select(*sorted(out.columns)).write.mode("overwrite").csv(path, header=True)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True)


def write_document(path: str, content: dict) -> None:
    """A small JSON document, on the driver."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(content, indent=2, sort_keys=True), encoding="utf-8")


def read_document(path: str) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def read_config(path: str) -> dict:
    """Options in YAML, on the driver."""
    import yaml

    return yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}


def merge_options(base: dict, more: dict | None) -> dict:
    """base with more laid over it, dict by dict."""
    out = dict(base)
    for k, v in (more or {}).items():
        out[k] = merge_options(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line from 1, value) of a text file. Lines are numbered within files by their place, files by name."""
    from ..operators.graph import running_sum

    rows = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
    return running_sum(rows, [F.col("file"), F.col("at")], F.lit(1), "line").select((F.col("line") + 1).cast("int").alias("line"), "value")


def read_tu(spark: SparkSession, folder: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(graphs, edges) of a folder with NAME_A.txt, NAME_graph_indicator.txt and NAME_graph_labels.txt.

    Nodes are numbered from 0 within each graph; edges across graphs are dropped; labels become classes from 0, in order.
    """
    of_node = numbered_lines(spark, f"{folder}/{name}_graph_indicator.txt").select(F.col("line").alias("id"), F.trim("value").cast("int").alias("graph_id"))
    nodes = of_node.withColumn("node", F.row_number().over(Window.partitionBy("graph_id").orderBy("id")) - 1)
    pairs = spark.read.text(f"{folder}/{name}_A.txt").select(F.split("value", ",").alias("x")).select(F.trim(F.col("x")[0]).cast("int").alias("a"), F.trim(F.col("x")[1]).cast("int").alias("b"))
    a = nodes.select(F.col("id").alias("a"), F.col("graph_id").alias("ga"), F.col("node").alias("u"))
    b = nodes.select(F.col("id").alias("b"), F.col("graph_id").alias("gb"), F.col("node").alias("v"))
    edges = pairs.join(a, "a").join(b, "b").where("ga = gb AND u <> v").select(F.col("ga").alias("graph_id"), F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    labels = numbered_lines(spark, f"{folder}/{name}_graph_labels.txt").select(F.col("line").alias("graph_id"), F.trim("value").cast("int").alias("label"))
    classes = labels.withColumn("y", F.dense_rank().over(Window.orderBy("label")) - 1)
    graphs = nodes.groupBy("graph_id").agg(F.count("*").cast("int").alias("num_nodes")).join(classes.select("graph_id", "y"), "graph_id", "left")
    return graphs, edges


def read_sliced(values: DataFrame, slices: DataFrame, max_nodes: int) -> DataFrame:
    """Graphs stored as slices of one long edge column: values (pos, u, v), slices (graph_id, start, stop, num_nodes).

    Rows of a graph are those with start <= pos < stop, found by joining on the slice's number of each position.
    """
    some = slices.where(F.col("num_nodes").between(1, max_nodes))
    at = some.where("stop > start").select("graph_id", F.explode(F.sequence("start", F.col("stop") - 1)).alias("pos"))
    return values.join(at, "pos").select("graph_id", "u", "v")


def derive_nodes(edges: DataFrame, graphs: DataFrame, types: int = 8) -> DataFrame:
    """(graph_id, node, node_type, node_attr): type (degree + id) mod types; relative degree, clustering, relative id, 1."""
    from ..operators.graph import clustering, with_nodes

    c = clustering(edges, with_nodes(graphs)).join(graphs.select("graph_id", "num_nodes"), "graph_id")
    top = F.greatest(F.lit(1), F.max("degree").over(Window.partitionBy("graph_id")))
    attr = F.array(F.col("degree") / top, F.col("clustering"), F.col("node") / F.greatest(F.lit(1), F.col("num_nodes") - 1), F.lit(1.0))
    return c.select("graph_id", "node", ((F.col("degree") + F.col("node")) % types).cast("int").alias("node_type"), attr.alias("node_attr"))
