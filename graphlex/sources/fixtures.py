"""Graphs and token sequences as views over the driver's tables.

Ids are integers here so that every query has a plain SQL counterpart; the operators take any id type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The event types in node order.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: many small graphs, one for each user and week; an edge joins event types that follow each other."""
    week = F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 7)
    node = F.array_position(F.array(*map(F.lit, EVENT_TYPES)), F.col("event_type")).cast("int") - 1
    rows = table(spark, sf_dir, "events").select((F.col("user_id") * 1000 + week).cast("long").alias("graph_id"), "ts", "event_id", node.alias("node"))
    nxt = F.lead("node").over(Window.partitionBy("graph_id").orderBy("ts", "event_id"))
    pairs = rows.select("graph_id", "node", nxt.alias("nxt")).where("node <> nxt")
    return pairs.select("graph_id", F.least("node", "nxt").alias("u"), F.greatest("node", "nxt").alias("v")).distinct()


EVENT_EDGES_SQL = """g1 AS (
  SELECT DISTINCT graph_id, least(node, nxt) AS u, greatest(node, nxt) AS v FROM (
    SELECT graph_id, node, lead(node) OVER (PARTITION BY graph_id ORDER BY ts, event_id) AS nxt FROM (
      SELECT CAST(user_id * 1000 + date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 7 AS BIGINT) AS graph_id, ts, event_id,
        CAST(list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) AS INTEGER) - 1 AS node FROM events))
  WHERE node <> nxt)"""


def brand_edges(spark: SparkSession, sf_dir: str, least_weight: int = 1) -> DataFrame:
    """G3: a dense weighted graph for each nation; an edge joins two brands that stand in one order."""
    line, orders, customer, part = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "part"))
    brand = part.select(F.col("p_partkey").alias("l_partkey"), F.regexp_replace("p_brand", "[^0-9]", "").cast("int").alias("brand"))
    rows = line.select("l_orderkey", "l_partkey").join(brand, "l_partkey").select("l_orderkey", "brand").distinct()
    nation = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")).join(customer.select("c_custkey", F.col("c_nationkey").cast("long").alias("graph_id")), "c_custkey").select("l_orderkey", "graph_id")
    a, b = rows.withColumnRenamed("brand", "u"), rows.withColumnRenamed("brand", "v")
    pairs = a.join(b, "l_orderkey").where("u < v").join(nation, "l_orderkey")
    return pairs.groupBy("graph_id", "u", "v").agg(F.count("*").alias("w")).where(F.col("w") >= least_weight)


BRAND_EDGES_SQL = """b AS (
  SELECT DISTINCT l_orderkey, CAST(regexp_replace(p_brand, '[^0-9]', '', 'g') AS INTEGER) AS brand FROM lineitem JOIN part ON l_partkey = p_partkey
), g3 AS (
  SELECT CAST(c_nationkey AS BIGINT) AS graph_id, x.brand AS u, y.brand AS v, count(*) AS w
  FROM b x JOIN b y ON x.l_orderkey = y.l_orderkey AND x.brand < y.brand JOIN orders ON o_orderkey = x.l_orderkey JOIN customer ON c_custkey = o_custkey
  GROUP BY ALL)"""


def forest_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2: a tree for each region: region, its nations, their customers. Node ids are offset by kind."""
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    upper = nation.select(F.col("n_regionkey").cast("long").alias("graph_id"), F.col("n_regionkey").cast("int").alias("u"), (F.col("n_nationkey") + 100).cast("int").alias("v"))
    lower = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").cast("long").alias("graph_id"), (F.col("n_nationkey") + 100).cast("int").alias("u"), (F.col("c_custkey") + 1000).cast("int").alias("v"))
    return upper.unionByName(lower)


FOREST_EDGES_SQL = """g2 AS (
  SELECT CAST(n_regionkey AS BIGINT) AS graph_id, CAST(n_regionkey AS INTEGER) AS u, CAST(n_nationkey + 100 AS INTEGER) AS v FROM nation
  UNION ALL SELECT CAST(n_regionkey AS BIGINT), CAST(n_nationkey + 100 AS INTEGER), CAST(c_custkey + 1000 AS INTEGER) FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def event_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1: a token sequence for each user: event types in order of time. Columns seq_id, pos (from 0), tok."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("seq_id"), "ts", "event_id", F.col("event_type").alias("tok"))
    return rows.select("seq_id", (F.row_number().over(Window.partitionBy("seq_id").orderBy("ts", "event_id")) - 1).alias("pos"), "tok")


EVENT_TOKENS_SQL = """t1 AS (
  SELECT user_id AS seq_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS pos, event_type AS tok FROM events)"""


def line_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2: a short token sequence for each order: flag and status of its lines."""
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_returnflag", "l_linestatus")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", *order)
    return rows.select(F.col("l_orderkey").alias("seq_id"), (F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)) - 1).alias("pos"), F.concat("l_returnflag", "l_linestatus").alias("tok"))


LINE_TOKENS_SQL = """t2 AS (
  SELECT l_orderkey AS seq_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_returnflag, l_linestatus) - 1 AS INTEGER) AS pos,
    l_returnflag || l_linestatus AS tok FROM lineitem)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: feature vectors in long form: vec_id, label, dim (from 0), value."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("dim", "value")).withColumn("value", F.col("value").cast("double"))


VECTORS_SQL = """v1 AS (
  SELECT vec_id, label, CAST(i - 1 AS INTEGER) AS dim, CAST(embedding[i] AS DOUBLE) AS value FROM embeddings, unnest(range(1, len(embedding) + 1)) AS t(i))"""
