"""Schemas of the tables that the operators exchange, as DDL. Long form for learning, arrays for encoding and decoding."""

GRAPHS = "graph_id string, num_nodes int, directed boolean, y double, metadata map<string,string>"
EDGES = "graph_id string, u int, v int"
#: One graph as a row: a JSON line.
GRAPH_RECORD = "graph_id string, num_nodes int, edges array<array<int>>, node_type array<int>, node_attr array<array<double>>, edge_type array<int>, edge_attr array<array<double>>, y double, metadata map<string,string>, directed boolean"
PORT = "struct<local_index:int,anchor:int,role:string,mode:string,capacity:int,subtype:int>"
ANCHOR = "struct<local_index:int,kind:string,role:string,subtype:int,nodes:array<int>>"
PATCHES = (
    "graph_id string, patch_id string, pos int, nodes array<int>, edges array<array<int>>, n int, e int, "
    f"ports array<{PORT}>, anchors array<{ANCHOR}>, edge_anchors array<{ANCHOR}>, score double, structural_hash string, visual_key string, features map<string,double>"
)
ACTIONS = "graph_id string, pos int, op string, args array<int>"
PROGRAM = "graph_id string, actions array<struct<op:string,args:array<int>>>, metadata map<string,string>"
TOKENS = "seq_id string, pos int, tok string"
RULES = "kind string, rule_idx int, token string, parts array<string>, category string"
COUNTS = "model string, counter string, key string, n bigint"
ENCODED = "graph_id string, mode string, tokens array<string>, bits double, bits_per_edge double, original_token_count int, token_count int, lossless_expand_match double"
TOKEN_EXAMPLE = "graph_id string, dataset string, split string, view string, tokens array<string>, y array<double>, task_type string, num_nodes int, num_edges int, node_refs array<array<string>>, edge_pairs array<array<string>>"
