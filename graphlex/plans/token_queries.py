"""Program, token, frequency, codebook and metric queries over the views of the driver's tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tokens as T
from ..operators import codebook as C
from ..operators import compact as CC
from ..operators import entropy as E
from ..operators import program as R
from ..operators import views as V
from ..sources.fixtures import EVENT_EDGES_SQL, EVENT_TOKENS_SQL, LINE_TOKENS_SQL, VECTORS_SQL, event_edges, event_tokens, line_tokens, table, vectors
from .registry import query

WINDOW, BLOCK = 768, 4
#: The edge-cover program of G1 as SQL: actions with their place, op and arguments.
PROGRAM_SQL = f"""{EVENT_EDGES_SQL},
  cover AS (SELECT graph_id, row_number() OVER (PARTITION BY graph_id ORDER BY u, v) - 1 AS r, u, v, count(*) OVER (PARTITION BY graph_id) - 1 AS last FROM g1),
  anchors AS (SELECT graph_id, r, i, CASE i WHEN 0 THEN u ELSE v END AS node, 2 * r + i AS a FROM cover, unnest([0, 1]) AS t(i)),
  merges AS (SELECT graph_id, r, i, 2 * r - lag(a) OVER (PARTITION BY graph_id, node ORDER BY r, i) AS ref FROM anchors),
  acts AS (
    SELECT graph_id, r, 1 AS k, 0 AS i, 'EMIT' AS op, [0] AS args FROM cover
    UNION ALL SELECT graph_id, r, 2, i, 'MERGE_NODE', [i, ref] FROM merges WHERE ref <= {WINDOW}
    UNION ALL SELECT graph_id, r, 0, 0, 'BEGIN_BLOCK', [] FROM cover WHERE r % {BLOCK} = 0
    UNION ALL SELECT graph_id, r, 3, 0, 'END_BLOCK', [] FROM cover WHERE r % {BLOCK} = {BLOCK - 1} OR r = last
    UNION ALL SELECT graph_id, x, 0, 0, o, [] FROM (SELECT DISTINCT graph_id FROM g1), (VALUES (-1, 'BEGIN_GRAPH'), (1000000000, 'END_GRAPH'), (1000000001, 'STOP')) AS m(x, o)),
  prog AS (SELECT graph_id, CAST(row_number() OVER (PARTITION BY graph_id ORDER BY r, k, i) - 1 AS BIGINT) AS pos, op, args,
    CASE WHEN len(args) = 0 THEN op ELSE op || '(' || array_to_string(args, ',') || ')' END AS tok FROM acts)"""
W1, W2 = f"WITH {EVENT_TOKENS_SQL}", f"WITH {LINE_TOKENS_SQL}"


def _program(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.compile_edge_cover(event_edges(spark, sf_dir), WINDOW, BLOCK)


@query(f"WITH {PROGRAM_SQL} SELECT graph_id, CAST(r AS BIGINT) AS patch, CAST(i AS BIGINT) AS anchor, CAST(ref AS BIGINT) AS ref FROM merges WHERE ref <= {WINDOW}")
def merge_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    acts = _program(spark, sf_dir)
    patch = F.count(F.when(F.col("op") == "EMIT", 1)).over(Window.partitionBy("graph_id").orderBy("pos")) - 1
    return acts.withColumn("patch", patch).where("op = 'MERGE_NODE'").select("graph_id", "patch", F.col("args")[0].alias("anchor"), F.col("args")[1].alias("ref"))


@query(f"WITH {PROGRAM_SQL} SELECT graph_id, pos, tok FROM prog")
def program_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.tokens(_program(spark, sf_dir))


@query(f"WITH {PROGRAM_SQL} SELECT graph_id, CAST(count(*) AS BIGINT) AS n_tokens, round(sum(1.5 + CASE WHEN op = 'EMIT' THEN 1 WHEN op = 'MERGE_NODE' THEN log2({WINDOW}) + 4 ELSE 0 END), 6) AS bits FROM prog GROUP BY graph_id")
def program_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.program_bits(_program(spark, sf_dir), 1, WINDOW)


@query(
    f"""WITH {PROGRAM_SQL} SELECT graph_id, CAST(count(*) AS BIGINT) AS n_actions, round(sum(CASE op WHEN 'EMIT' THEN 1.0 WHEN 'MERGE_NODE' THEN log2({WINDOW}) + 4 ELSE 1.0 END), 6) AS bits,
  {', '.join(f"round(count(*) FILTER (op = '{op}') * 1.0 / count(*), 6) AS {op.lower()}_rate" for op in ('EMIT', 'INTERFACE', 'ATTACH', 'CLOSE_CYCLE', 'MERGE_NODE', 'MERGE_EDGE', 'GLOBAL_LINK'))} FROM prog GROUP BY graph_id"""
)
def compression_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.compression(_program(spark, sf_dir), 1, WINDOW)


@query(f"WITH {EVENT_EDGES_SQL} SELECT graph_id, CAST(count(*) AS BIGINT) AS e, CAST(count(DISTINCT node) AS BIGINT) AS n FROM (SELECT graph_id, u, v, unnest([u, v]) AS node FROM g1) GROUP BY graph_id".replace("count(*)", "count(DISTINCT (u, v))"))
def decode_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges and nodes of the graphs that the programs build; the SQL counts those of the graphs they were made of."""
    codes = spark.createDataFrame([(0, 2, [[0, 1]])], "code int, n int, edges array<array<int>>")
    back = R.decode(_program(spark, sf_dir), codes)
    return back.groupBy("graph_id").agg(F.count_distinct("u", "v").alias("e"), F.count_distinct(F.col("u")).alias("a"), F.max("v").alias("top")).select("graph_id", "e", (F.col("top") + 1).alias("n"))


@query(f"WITH {PROGRAM_SQL} SELECT graph_id, CAST(count(*) AS BIGINT) AS n_actions, true AS well_formed FROM prog GROUP BY graph_id")
def program_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.lifecycle(_program(spark, sf_dir))


@query(f"WITH {PROGRAM_SQL} SELECT op, CAST(count(*) AS BIGINT) AS n FROM prog GROUP BY op")
def op_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.op_histogram(R.sequences(_program(spark, sf_dir)))


GROUPED_SQL = f"""{PROGRAM_SQL},
  isl AS (SELECT *, sum(CASE WHEN op = 'MERGE_NODE' AND before = 'MERGE_NODE' THEN 0 ELSE 1 END) OVER (PARTITION BY graph_id ORDER BY pos) AS island FROM (SELECT *, lag(op) OVER (PARTITION BY graph_id ORDER BY pos) AS before FROM prog)),
  grp AS (SELECT graph_id, island, min(pos) AS first, any_value(op) AS op, CASE any_value(op) WHEN 'MERGE_NODE' THEN 'MERGE_NODE_PATTERN(' || string_agg(args[1] || ':' || args[2], ';' ORDER BY pos) || ')' WHEN 'EMIT' THEN 'EMIT_CODE(' || any_value(args[1]) || ')' ELSE any_value(tok) END AS tok FROM isl GROUP BY graph_id, island),
  base AS (SELECT graph_id AS seq_id, CAST(row_number() OVER (PARTITION BY graph_id ORDER BY first) - 1 AS BIGINT) AS pos, op, tok FROM grp)"""


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CC.group_runs_table(R.tokens(_program(spark, sf_dir)).withColumnRenamed("graph_id", "seq_id"))


@query(f"WITH {GROUPED_SQL} SELECT seq_id, pos, tok FROM base")
def grouped_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped(spark, sf_dir)


#: What the compact model counts of grouped tokens.
COMPONENTS_SQL = f"""{GROUPED_SQL},
  prs AS (SELECT seq_id, pos, tok, i, string_split(x[i], ':') AS p FROM (SELECT *, string_split(regexp_extract(tok, '\\((.*)\\)', 1), ';') AS x FROM base WHERE op = 'MERGE_NODE'), unnest(range(1, len(x) + 1)) AS t(i)),
  items AS (
    SELECT seq_id, pos, tok, 'token' AS counter, tok AS key FROM base UNION ALL SELECT seq_id, pos, tok, 'op', split_part(tok, '(', 1) FROM base
    UNION ALL SELECT seq_id, pos, tok, 'code', '0' FROM base WHERE op = 'EMIT' UNION ALL SELECT seq_id, pos, tok, 'local', p[1] FROM prs
    UNION ALL SELECT seq_id, pos, tok, 'ref_delta', CAST(CAST(p[2] AS BIGINT) - coalesce(lag(CAST(p[2] AS BIGINT)) OVER (PARTITION BY seq_id, pos ORDER BY i), 0) AS VARCHAR) FROM prs),
  cnt AS (SELECT counter, key, count(*) AS n FROM items GROUP BY ALL)"""


@query(f"WITH {COMPONENTS_SQL} SELECT counter, key, CAST(n AS BIGINT) AS n FROM cnt")
def counter_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.counts(E.components_of(_grouped(spark, sf_dir)))


@query(
    f"""WITH {COMPONENTS_SQL}, tot AS (SELECT counter, sum(n) AS total, count(*) AS d FROM cnt GROUP BY counter), price AS (SELECT counter, key, -log2((n + 1.0) / (total + d + 1.0)) AS b FROM cnt JOIN tot USING (counter)),
  tb AS (SELECT seq_id, pos, least(sum(b) FILTER (counter = 'token'), sum(b) FILTER (counter <> 'token')) AS bits FROM items JOIN price USING (counter, key) GROUP BY ALL)
  SELECT seq_id, CAST(count(*) AS BIGINT) AS n_tokens, round(sum(bits), 6) AS bits FROM tb GROUP BY seq_id"""
)
def entropy_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _grouped(spark, sf_dir)
    return E.sequence_bits(rows, E.counts(E.components_of(rows)))


@query(f"{W1}, n AS (SELECT tok, count(*) AS n FROM t1 GROUP BY tok), s AS (SELECT sum(n) AS total, count(*) AS d FROM n) SELECT seq_id, CAST(count(*) AS BIGINT) AS n_tokens, round(sum(-log2((n + 1.0) / (total + d + 1.0))), 6) AS bits FROM t1 JOIN n USING (tok), s GROUP BY seq_id")
def smoothed_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.flat_bits(event_tokens(spark, sf_dir))


@query(f"{W1}, p AS (SELECT tok, lead(tok) OVER (PARTITION BY seq_id ORDER BY pos) AS nxt FROM t1) SELECT tok || ' ' || nxt AS gram, CAST(count(*) AS BIGINT) AS n FROM p WHERE nxt IS NOT NULL GROUP BY ALL")
def bigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CC.pair_counts(CC.wide(event_tokens(spark, sf_dir))).select(F.array_join("gram", " ").alias("gram"), "n")



@query(
    f"""{W2}, g AS ({' UNION ALL '.join("SELECT " + str(k) + " AS len, seq_id, pos, " + " || ' ' || ".join(f"lead(tok, {j}) OVER w" for j in range(k)) + " AS gram FROM t2 WINDOW w AS (PARTITION BY seq_id ORDER BY pos)" for k in (3, 4, 5))}),
  c AS (SELECT gram, len, count(*) AS n FROM g WHERE gram IS NOT NULL GROUP BY ALL) SELECT gram, CAST(n AS BIGINT) AS n, CAST((len - 1) * (n - 1) AS BIGINT) AS saved FROM c ORDER BY (len - 1) * (n - 1) DESC, n DESC, len DESC, gram LIMIT 20"""
)
def ngram_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = CC.gram_counts(CC.wide(line_tokens(spark, sf_dir)), (3, 4, 5)).withColumn("len", F.size("gram"))
    saved = ((F.col("len") - 1) * (F.col("n") - 1)).alias("saved")
    return g.select(F.array_join("gram", " ").alias("gram"), "n", saved, "len").orderBy(F.desc("saved"), F.desc("n"), F.desc("len"), "gram").limit(20).drop("len")


@query(f"{W1}, p AS (SELECT seq_id, pos, tok, lead(tok) OVER (PARTITION BY seq_id ORDER BY pos) AS nxt FROM t1), c AS (SELECT tok, nxt, count(*) AS n, min((seq_id, pos)) AS f FROM p WHERE nxt IS NOT NULL GROUP BY ALL) SELECT tok AS a, nxt AS b, CAST(n AS BIGINT) AS n FROM c ORDER BY n DESC, f LIMIT 1")
def merge_best_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = CC.pair_counts(CC.wide(event_tokens(spark, sf_dir))).orderBy(F.desc("n"), "first").limit(1)
    return best.select(F.col("gram")[0].alias("a"), F.col("gram")[1].alias("b"), "n")


@query()
def merge_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight pair merges over the user sequences, and each sequence's length before and after."""
    rows = CC.wide(event_tokens(spark, sf_dir))
    _, now = CC.learn_merges(rows, 8, 2)
    return now.select("seq_id", F.size("tokens").alias("after")).join(rows.select("seq_id", F.size("tokens").alias("before")), "seq_id")


RUNS = f"""{W1}, r AS (SELECT *, sum(CASE WHEN tok = before THEN 0 ELSE 1 END) OVER (PARTITION BY seq_id ORDER BY pos) AS island FROM (SELECT *, lag(tok) OVER (PARTITION BY seq_id ORDER BY pos) AS before FROM t1))
  SELECT seq_id, CAST(min(pos) AS BIGINT) AS start, any_value(tok) AS tok, CAST(count(*) AS BIGINT) AS length FROM r GROUP BY seq_id, island"""


@query(RUNS)
def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal runs of one token."""
    w = Window.partitionBy("seq_id").orderBy("pos")
    new = (F.coalesce(F.lag("tok").over(w) != F.col("tok"), F.lit(True))).cast("int")
    return event_tokens(spark, sf_dir).withColumn("island", F.sum(new).over(w)) .groupBy("seq_id", "island").agg(F.min("pos").alias("start"), F.min("tok").alias("tok"), F.count("*").alias("length")).drop("island")


@query(f"{W2}, n AS (SELECT tok, count(*) AS n, min((seq_id, pos)) AS f FROM t2 GROUP BY tok) SELECT tok, CAST(row_number() OVER (ORDER BY n DESC, f) + 3 AS BIGINT) AS id, CAST(n AS BIGINT) AS n FROM n")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.vocabulary(line_tokens(spark, sf_dir))


@query(
    f"""{W2}, n AS (SELECT tok, count(*) AS n, min((seq_id, pos)) AS f FROM t2 GROUP BY tok), v AS (SELECT tok, row_number() OVER (ORDER BY n DESC, f) + 3 AS id FROM n ORDER BY n DESC, f LIMIT 2),
  s AS (SELECT seq_id, list_resize(list_concat([1], list(coalesce(id, 3) ORDER BY pos), [2])[1:8], 8, 0) AS ids FROM t2 LEFT JOIN v USING (tok) GROUP BY seq_id) SELECT seq_id, array_to_string(ids, ' ') AS ids FROM s"""
)
def vocabulary_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_tokens(spark, sf_dir)
    ids = V.encode_ids(rows, V.vocabulary(rows, 6), 8)
    return ids.select("seq_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


#: Tokens of every kind, for the classifier.
SAMPLES = ("EMIT(3)", "EMIT_CODE(3)", "INTERFACE_CODE(2)", "EMIT_CHAIN_BLOCK(0001)", "EMIT_MOTIF_BLOCK(0000)", "ACTION_BPE_0001", "MOTIF_MACRO_0002", "MERGE_NODE(0,3)", "ATTACH_PATTERN(0:1;1:2)", "REPEAT_EMIT_MERGE(3|0:1|4)", "E(1,2)", "N(0):1,2", "NODES_BIN(3)", "TRIANGLES_BIN(1)", "WL0(3)x2", "STOP", "<pad>")
KIND_SQL = """CASE WHEN tok IN ('<pad>', '<bos>', '<eos>', '<unk>') THEN 'special' WHEN regexp_matches(upper(tok), '^(MOTIF|MACRO|BPE)') OR contains(upper(tok), 'MOTIF') OR contains(upper(tok), 'MACRO') THEN 'rps_macro'
  WHEN regexp_matches(upper(tok), '^(CODE|SHAPE|INTERFACE)') OR contains(upper(tok), 'CODE') THEN 'rps_shape' WHEN regexp_matches(upper(tok), '^(PATCH|BEGIN|END|MERGE|EMIT)') THEN 'rps_patch'
  WHEN regexp_matches(upper(tok), '^(ADD_NODE|ADD_EDGE|NODE|EDGE)') THEN 'rps_primitive' WHEN regexp_matches(upper(tok), '^(STRUCT|DEG|TRI|WL|LEN_BIN)') THEN 'struct' WHEN regexp_matches(upper(tok), '^(E\\(|EDGE)') THEN 'edge' ELSE 'other' END"""


@query(
    f"""WITH {PROGRAM_SQL}, a AS (SELECT DISTINCT tok FROM prog UNION SELECT unnest([{', '.join(f"'{s}'" for s in SAMPLES)}])), k AS (SELECT tok, {KIND_SQL} AS kind, list_transform(regexp_extract_all(tok, '-?\\d+'), lambda x: CAST(x AS BIGINT)) AS n FROM a)
  SELECT tok, kind, CASE kind WHEN 'special' THEN 'other' WHEN 'struct' THEN 'struct' WHEN 'edge' THEN 'edge' ELSE 'program' END AS segment,
  CASE WHEN len(n) = 0 THEN 'none' WHEN kind = 'rps_macro' THEN 'shape' WHEN kind = 'rps_shape' THEN CASE WHEN contains(upper(tok), 'INTERFACE') THEN 'interface' ELSE 'shape' END WHEN kind = 'rps_patch' THEN 'patch'
    WHEN kind = 'rps_primitive' THEN CASE WHEN contains(upper(tok), 'EDGE') THEN 'edge' ELSE 'numeric' END WHEN kind = 'edge' THEN 'edge' ELSE 'none' END AS ref_role,
  CASE WHEN len(n) > 0 THEN abs(n[1]) ELSE 0 END AS token_id, CASE WHEN len(n) > 0 THEN list_max(n) - list_min(n) ELSE 0 END AS span, CAST(length(regexp_replace(tok, '[^|,]', '', 'g')) AS BIGINT) AS arity, CAST(len(list_distinct(n)) AS BIGINT) AS ref_count FROM k"""
)
def token_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    toks = program_tokens(spark, sf_dir).select("tok").union(spark.createDataFrame([(s,) for s in SAMPLES], "tok string")).distinct()
    return toks.select("tok", *[c.alias(k) for k, c in T.token_features(F.col("tok")).items()])


@query(f"WITH {PROGRAM_SQL} SELECT DISTINCT tok, array_to_string(list_transform(regexp_extract_all(tok, '-?\\d+')[1:16], lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ' ') AS refs FROM prog")
def node_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return program_tokens(spark, sf_dir).select("tok").distinct().select("tok", F.array_join(T.node_refs(F.col("tok")), " ").alias("refs"))


@query("SELECT DISTINCT event_type, CAST(('0x' || right(sha1(event_type), 1))::INTEGER % 16 AS BIGINT) AS subtype, left(sha1(event_type), 10) AS short FROM events")
def stable_subtype(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").select("event_type").distinct()
    return t.select("event_type", T.hash_modulo(F.col("event_type"), 16).alias("subtype"), T.hash_prefix(F.col("event_type")).alias("short"))


@query("SELECT o_orderkey, CAST(CASE WHEN floor(o_totalprice) <= 0 THEN 0 ELSE least(20, length(bin(CAST(floor(o_totalprice) AS BIGINT)))) END AS BIGINT) AS bin_value, CAST(CASE WHEN floor(abs(o_totalprice)) <= 0 THEN 0 ELSE least(10, length(bin(CAST(floor(abs(o_totalprice)) AS BIGINT)))) END AS BIGINT) AS bin_int FROM orders")
def bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", T.bin_value(F.col("o_totalprice")).alias("bin_value"), T.bin_int(F.col("o_totalprice")).alias("bin_int"))


@query(f"WITH {EVENT_EDGES_SQL}, {'''k AS (SELECT graph_id, string_agg(u || '-' || v, ';' ORDER BY u, v) AS shape, min(graph_id) AS f FROM g1 GROUP BY graph_id)'''} SELECT shape, CAST(count(*) AS BIGINT) AS usage, CAST(row_number() OVER (ORDER BY min(graph_id)) - 1 AS BIGINT) AS code FROM k GROUP BY shape")
def visual_codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole graphs as patches, coded by labelled shape in order of first appearance."""
    e = event_edges(spark, sf_dir)
    pairs = F.array_sort(F.collect_list(F.array("u", "v")))
    p = e.groupBy("graph_id").agg(pairs.alias("edges"), F.count("*").alias("e")).withColumn("nodes", F.sequence(F.lit(0), F.lit(4))).withColumn("n", F.lit(5)).withColumn("pos", F.lit(0))
    p = p.withColumn("visual_key", F.array_join(F.transform("edges", lambda x: F.concat(x[0].cast("string"), F.lit("-"), x[1].cast("string"))), ";"))
    return C.shape_codes(p).select(F.col("visual_key").alias("shape"), "usage", "code")


@query("SELECT event_type AS tok, CAST(count(*) AS BIGINT) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS share, CAST(row_number() OVER (ORDER BY count(*) DESC, event_type) AS BIGINT) AS rank FROM events GROUP BY event_type")
def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.usage(event_tokens(spark, sf_dir).select("tok"), "tok")


@query("WITH n AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY ALL), p AS (SELECT n, n * 1.0 / sum(n) OVER () AS p FROM n) SELECT CAST(count(*) AS BIGINT) AS used, CAST(sum(n) AS BIGINT) AS total, round(sum(-p * ln(p + 1e-12)), 6) AS entropy, round(exp(sum(-p * ln(p + 1e-12))), 4) AS perplexity FROM p")
def usage_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    return C.usage_stats(n).withColumn("perplexity", F.round("perplexity", 4))


@query("WITH n AS (SELECT p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), k AS (SELECT n, row_number() OVER (ORDER BY n DESC, p_brand) AS k FROM n) SELECT round(sum(n) FILTER (k <= 1) * 1.0 / sum(n), 6) AS top1_share, round(sum(n) FILTER (k <= 10) * 1.0 / sum(n), 6) AS top10_share FROM k")
def topk_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("code"), F.lit(0.0).alias("distance"))
    return C.code_quality(rows).select("top1_share", "top10_share")


@query(f"WITH {VECTORS_SQL} SELECT CAST(label AS BIGINT) AS label, CAST(dim AS BIGINT) AS dim, round(avg(value), 6) AS mean FROM v1 GROUP BY ALL")
def feature_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.means(vectors(spark, sf_dir), "label")


MEANS = f"{VECTORS_SQL}, m AS (SELECT label AS code, dim, avg(value) AS mean FROM v1 GROUP BY ALL)"
NEAREST = f"{MEANS}, d AS (SELECT vec_id, code, round(sum(abs(value - mean)), 6) AS distance FROM v1 JOIN m USING (dim) GROUP BY ALL), b AS (SELECT vec_id, min((distance, code)) AS b FROM d GROUP BY vec_id)"


@query(f"WITH {MEANS}, d AS (SELECT label, vec_id, round(sum(abs(value - mean)), 6) AS distance FROM v1 JOIN m ON v1.dim = m.dim AND label = code GROUP BY ALL) SELECT CAST(label AS BIGINT) AS label, vec_id, distance FROM d QUALIFY row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) = 1")
def medoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.medoids(vectors(spark, sf_dir), "label", "vec_id")


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return C.nearest(v, C.means(v, "label").withColumnRenamed("label", "code"), "vec_id", "code")


@query(f"WITH {NEAREST} SELECT vec_id, CAST(b[2] AS BIGINT) AS code, b[1] AS distance FROM b".replace("b[2]", "struct_extract_at(b, 2)").replace("b[1]", "struct_extract_at(b, 1)"))
def assign_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir)


@query(
    f"""WITH {NEAREST}, r AS (SELECT DISTINCT v1.vec_id, label AS t, struct_extract_at(b, 2) AS g FROM b JOIN v1 ON b.vec_id = v1.vec_id), c AS (SELECT DISTINCT t AS c FROM r UNION SELECT g FROM r),
  f AS (SELECT c, (SELECT count(*) FROM r WHERE t = c AND g = c) AS h, (SELECT count(*) FROM r WHERE t = c) AS nt, (SELECT count(*) FROM r WHERE g = c) AS ng FROM c)
  SELECT round(sum(h) * 1.0 / sum(nt), 6) AS accuracy, round(avg(2.0 * h / (nt + ng)), 6) AS macro_f1 FROM f"""
)
def confusion_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return V.macro_f1(_nearest(spark, sf_dir).join(truth, "vec_id"), "label", "code")


@query(
    """WITH r AS (SELECT quality, n_chars, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS k FROM labels JOIN documents USING (doc_id))
  SELECT round((sum(k) FILTER (quality = 1) - sum(quality) * (sum(quality) + 1) / 2.0) / (sum(quality) * (count(*) - sum(quality))), 6) AS auc FROM r"""
)
def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.roc_auc(table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id"), "quality", "n_chars")


@query("SELECT round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS std FROM orders")
def regression_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").agg(F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.stddev_pop("o_totalprice"), 4).alias("std"))


@query("WITH k AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS k, count(*) OVER () AS n FROM customer) SELECT c_custkey, CASE WHEN k <= round_even(0.7 * n, 0) THEN 'train' WHEN k <= round_even(0.7 * n, 0) + round_even(0.1 * n, 0) THEN 'val' ELSE 'test' END AS split FROM k")
def split_half_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.ratio_split(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 0.7, 0.1)


@query("SELECT c_custkey, c_mktsegment FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha1('7|' || c_custkey), c_custkey) <= 5")
def hash_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.hash_cap(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", 5, 7, "c_mktsegment")


@query(f"WITH {EVENT_EDGES_SQL} SELECT graph_id, CAST(row_number() OVER (PARTITION BY graph_id ORDER BY u, v) - 1 AS BIGINT) AS pos, 'E(' || u || ',' || v || ')' AS tok FROM g1")
def edge_list_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.edge_list_view(event_edges(spark, sf_dir))


ADJ = "(SELECT graph_id, node, 'N(' || node || '):' || string_agg(other, ',' ORDER BY other) AS tok FROM (SELECT graph_id, u AS node, v AS other FROM g1 UNION ALL SELECT graph_id, v, u FROM g1) GROUP BY graph_id, node)"


@query(f"WITH {EVENT_EDGES_SQL} SELECT graph_id, CAST(row_number() OVER (PARTITION BY graph_id ORDER BY node) - 1 AS BIGINT) AS pos, tok FROM {ADJ}")
def adjacency_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.adjacency_view(event_edges(spark, sf_dir))


SUMMARY = """s AS (SELECT n.graph_id, n, e, coalesce(t, 0) AS t, CASE WHEN n > 1 THEN 2.0 * e / (n * (n - 1)) ELSE 0 END AS d FROM (SELECT graph_id, count(DISTINCT node) AS n FROM (SELECT graph_id, unnest([u, v]) AS node FROM g1) GROUP BY 1) n
  JOIN (SELECT graph_id, count(*) AS e FROM g1 GROUP BY 1) USING (graph_id) LEFT JOIN (SELECT x.graph_id, count(*) AS t FROM g1 x JOIN g1 y ON x.graph_id = y.graph_id AND x.v = y.u JOIN g1 z ON z.graph_id = x.graph_id AND z.u = x.u AND z.v = y.v GROUP BY 1) USING (graph_id)),
  sv AS (SELECT graph_id, unnest(['NODES_BIN(' || length(bin(n)) || ')', 'EDGES_BIN(' || length(bin(e)) || ')', 'DENSITY_BIN(' || CAST(floor(d * 10 + 1e-9) AS INTEGER) || ')', 'TRIANGLES_BIN(' || CASE WHEN t = 0 THEN 0 ELSE length(bin(t)) END || ')']) AS tok, unnest([0, 1, 2, 3]) AS pos FROM s)"""


@query(f"WITH {EVENT_EDGES_SQL}, {SUMMARY} SELECT graph_id, CAST(pos AS BIGINT) AS pos, tok FROM sv")
def summary_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.summary_view(event_edges(spark, sf_dir))


@query(
    f"""WITH {EVENT_EDGES_SQL}, {SUMMARY}, x AS (SELECT 'edge_list' AS view, graph_id, row_number() OVER (PARTITION BY graph_id ORDER BY u, v) - 1 AS pos, 'E(' || u || ',' || v || ')' AS tok FROM g1
  UNION ALL SELECT 'adjacency_list', graph_id, row_number() OVER (PARTITION BY graph_id ORDER BY node) - 1, tok FROM {ADJ} UNION ALL SELECT 'statistics_only', graph_id, pos, tok FROM sv) SELECT view, CAST(count(*) AS BIGINT) AS n_tokens, CAST(count(DISTINCT tok) AS BIGINT) AS n_distinct, CAST(count(DISTINCT graph_id) AS BIGINT) AS n_graphs FROM x GROUP BY view"""
)
def view_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_edges(spark, sf_dir)
    rows = V.union_views({k: V.build_view(k, e) for k in ("edge_list", "adjacency_list", "statistics_only")})
    return rows.groupBy("view").agg(F.count("*").alias("n_tokens"), F.count_distinct("tok").alias("n_distinct"), F.count_distinct("graph_id").alias("n_graphs"))


@query(
    f"""{W2}, a AS (SELECT x.seq_id, x.pos AS i, y.pos AS j FROM t2 x JOIN t2 y ON x.seq_id = y.seq_id WHERE abs(x.pos - y.pos) <= 1 OR x.tok = y.tok OR (x.tok = 'NO' AND y.tok = 'RF') OR (x.tok = 'RF' AND y.tok = 'NO'))
  SELECT seq_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(i * 1000 + j) AS BIGINT) AS places FROM a GROUP BY seq_id"""
)
def bias_coo(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_tokens(spark, sf_dir)
    refs = rows.select("seq_id", "pos", F.col("tok").alias("ref"))
    links = rows.select("seq_id").distinct().select("seq_id", F.lit("NO").alias("a"), F.lit("RF").alias("b"))
    return V.bias_pairs(refs, links, 128).groupBy("seq_id").agg(F.count("*").alias("n"), F.sum(F.col("i") * 1000 + F.col("j")).alias("places"))



@query(
    f"""WITH r AS (SELECT o_orderpriority AS dataset, o_orderstatus AS mode, o_totalprice AS x FROM orders), d AS (SELECT DISTINCT dataset FROM r), m AS (SELECT unnest(['F', 'O', 'P', 'X']) AS mode)
  SELECT d.dataset, m.mode, CAST(count(x) AS BIGINT) AS graphs, round(coalesce(avg(x), 0), 4) AS avg_x FROM d CROSS JOIN m LEFT JOIN r ON r.dataset = d.dataset AND r.mode = m.mode GROUP BY ALL"""
)
def eval_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.metrics import summarize

    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("dataset"), F.col("o_orderstatus").alias("mode"), F.col("o_totalprice").alias("x"))
    return summarize(rows, ["dataset"], "mode", ("F", "O", "P", "X"), ["x"]).withColumn("avg_x", F.round("avg_x", 4))


@query("SELECT n_name AS name, CAST(n_regionkey AS BIGINT) AS n_regionkey, NULL::DOUBLE AS s_acctbal FROM nation UNION ALL SELECT s_name, NULL, s_acctbal FROM supplier")
def ragged_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), "n_regionkey")
    return a.unionByName(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), "s_acctbal"), allowMissingColumns=True)


@query("SELECT event_id, CAST(len(list_filter(list_distinct(regexp_extract_all(props, '\"([^\"]+)\"\\s*:', 1)), lambda k: k IN ('src_node', 'dst_node', 'covered_edges', 'residual_edges', 'original_edges', 'edge_list', 'node_ids', 'nodes', 'edges'))) AS BIGINT) AS n_forbidden FROM events")
def leakage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.size(T.forbidden_keys(F.col("props"))).alias("n_forbidden"))


@query(
    f"""WITH {EVENT_EDGES_SQL}, {SUMMARY}, k AS (SELECT DISTINCT n, e FROM s), c AS (SELECT n AS cn, e AS ce, row_number() OVER (ORDER BY n, e) - 1 AS code FROM k)
  SELECT graph_id, CAST(code AS BIGINT) AS code FROM s JOIN c ON s.n - cn IN (-2, -1, 0, 1, 2) AND s.e - ce IN (-4, -2, -1, 0, 1, 2, 4)"""
)
def bucket_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.graph import graph_stats as stats

    s = stats(event_edges(spark, sf_dir), with_components=False).select("graph_id", "n", "e")
    codes = s.select("n", "e").distinct().withColumn("code", F.row_number().over(Window.orderBy("n", "e")) - 1)
    return C.band_candidates(s, codes, ("n", "e")).select("graph_id", "code")


@query(f"SELECT CAST(i AS BIGINT) AS token, round(CAST({math.log2(WINDOW)} AS DOUBLE) * i, 6) AS bits FROM unnest(range(1, 6)) AS t(i)")
def symbol_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1, 6).select(F.col("id").alias("token"), CC.symbol_bits(F.col("id"), WINDOW).alias("bits"))


@query()
def executability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs run on the state machine: every one must be executable."""
    out = R.execute(R.sequences(_program(spark, sf_dir)), {0: {"n": 2, "edges": [(0, 1)]}}, ref_window=WINDOW)
    return out.select("graph_id", "num_nodes", F.size("edges").alias("num_edges"), "executable", "illegal_rate", "n_executed")
