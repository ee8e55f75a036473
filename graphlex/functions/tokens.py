"""Token functions as Spark columns: rendering, parsing, classification, binning and hashing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The operations of a program.
OPS = ("BEGIN_GRAPH", "END_GRAPH", "STOP", "BEGIN_BLOCK", "END_BLOCK", "EMIT", "INTERFACE", "ATTACH", "CLOSE_CYCLE", "MERGE_NODE", "MERGE_EDGE", "GLOBAL_LINK")
#: Operations on pairs, and what a run of each is grouped into.
GROUPS = {"ATTACH": "ATTACH_PATTERN", "MERGE_NODE": "MERGE_NODE_PATTERN", "MERGE_EDGE": "MERGE_EDGE_PATTERN", "CLOSE_CYCLE": "CLOSE_CYCLE_PATTERN", "GLOBAL_LINK": "GLOBAL_LINK_GROUP"}
#: Operations that are renamed.
RENAMED = {"EMIT": "EMIT_CODE", "INTERFACE": "INTERFACE_CODE"}
#: Keys that must not leave with a program, for they give away the graph.
FORBIDDEN_KEYS = ("src_node", "dst_node", "covered_edges", "residual_edges", "original_edges", "edge_list", "node_ids", "nodes", "edges")
#: Ids 0 to 3 of a vocabulary.
SPECIALS = ("<pad>", "<bos>", "<eos>", "<unk>")
#: Graph families in label order.
FAMILIES = ("er", "ba", "grid", "tree", "cycle", "star", "clique_chain", "motif_mix")


def render(op: Column, args: Column) -> Column:
    """OP or OP(a,b)."""
    return F.when(F.size(args) > 0, F.concat(op, F.lit("("), F.array_join(args.cast("array<string>"), ","), F.lit(")"))).otherwise(op)


def op_of(token: Column) -> Column:
    return F.substring_index(token, "(", 1)


def payload_of(token: Column) -> Column:
    """What stands after the first parenthesis, without any closing ones at the end."""
    rest = F.substring(token, F.length(op_of(token)) + 2, F.length(token))
    return F.when(F.instr(token, "(") > 0, F.regexp_replace(rest, r"\)+$", "")).otherwise("")


def args_of(token: Column) -> Column:
    """The payload's items as whole numbers, null where one is none."""
    return F.when(payload_of(token) == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(payload_of(token), ","), lambda x: x.try_cast("int")))


def int_pairs(payload: Column) -> Column:
    """`a:b;c:d` as an array of (a, b); empty if any item is not a pair."""
    items = F.transform(F.split(payload, ";"), lambda x: F.split(x, ":"))
    good = F.forall(items, lambda x: (F.size(x) == 2) & x[0].rlike(r"^-?\d+$") & x[1].rlike(r"^-?\d+$"))
    pairs = F.transform(items, lambda x: F.struct(x[0].try_cast("int").alias("a"), x[1].try_cast("int").alias("b")))
    return F.when(good, pairs).otherwise(F.array().cast("array<struct<a:int,b:int>>"))


def ints_in(token: Column) -> Column:
    return F.transform(F.regexp_extract_all(token, F.lit(r"-?\d+"), F.lit(0)), lambda x: x.try_cast("long"))


def node_refs(token: Column, most: int = 16) -> Column:
    """The first numbers of a token, as canonical strings."""
    return F.transform(F.slice(ints_in(token), 1, most), lambda x: x.cast("string"))


def kind(token: Column) -> Column:
    """The token's kind; the first condition that holds decides."""
    t = F.upper(token)
    starts = lambda *words: t.rlike("^(" + "|".join(words) + ")")
    return (
        F.when(token.isin(*SPECIALS), "special")
        .when(starts("MOTIF", "MACRO", "BPE") | t.contains("MOTIF") | t.contains("MACRO"), "rps_macro")
        .when(starts("CODE", "SHAPE", "INTERFACE") | t.contains("CODE"), "rps_shape")
        .when(starts("PATCH", "BEGIN", "END", "MERGE", "EMIT"), "rps_patch")
        .when(starts("ADD_NODE", "ADD_EDGE", "NODE", "EDGE"), "rps_primitive")
        .when(starts("STRUCT", "DEG", "TRI", "WL", "LEN_BIN"), "struct")
        .when(starts(r"E\(", "EDGE"), "edge")
        .otherwise("other")
    )


def segment(token: Column) -> Column:
    k = kind(token)
    return F.when(k == "special", "other").when(k.isin("struct", "edge"), k).otherwise("program")


def ref_role(token: Column) -> Column:
    k, t = kind(token), F.upper(token)
    role = (
        F.when(k == "rps_macro", "shape")
        .when(k == "rps_shape", F.when(t.contains("INTERFACE"), "interface").otherwise("shape"))
        .when(k == "rps_patch", "patch")
        .when(k == "rps_primitive", F.when(t.contains("EDGE"), "edge").otherwise("numeric"))
        .when(k == "edge", "edge")
        .otherwise("none")
    )
    return F.when(F.size(ints_in(token)) > 0, role).otherwise("none")


def token_features(token: Column) -> dict[str, Column]:
    """kind, segment, ref_role, token_id, span, arity and ref_count of a token."""
    n = ints_in(token)
    some = F.size(n) > 0
    return {
        "kind": kind(token),
        "segment": segment(token),
        "ref_role": ref_role(token),
        "token_id": F.when(some, F.abs(n[0])).otherwise(0),
        "span": F.when(some, F.array_max(n) - F.array_min(n)).otherwise(0),
        "arity": F.length(F.regexp_replace(token, "[^|,]", "")),
        "ref_count": F.size(F.array_distinct(n)),
    }


def bit_length(value: Column, most: int) -> Column:
    """0 for values up to 0, else the number of binary digits of the whole part, `most` at most."""
    whole = F.floor(value).cast("long")
    return F.when(whole <= 0, 0).otherwise(F.least(F.lit(most), F.length(F.bin(whole)))).cast("int")


def bin_int(value: Column) -> Column:
    return bit_length(F.abs(value), 10)


def bin_value(value: Column) -> Column:
    return bit_length(value, 20)


def hash_modulo(text: Column, modulus: int) -> Column:
    """SHA-1 of a text as a whole number, modulo, by Horner's rule over its hex digits."""
    if modulus <= 1:
        return F.lit(0).cast("long")
    digits = F.split(F.sha1(text.cast("binary")), "")
    return F.aggregate(digits, F.lit(0).cast("long"), lambda s, c: F.when(c == "", s).otherwise((s * 16 + F.conv(c, 16, 10).cast("long")) % modulus))


def hash_prefix(text: Column, digits: int = 10) -> Column:
    return F.substring(F.sha1(text.cast("binary")), 1, digits)


def hash_int(text: Column) -> Column:
    """The first 16 hex digits of SHA-1 as an unsigned whole number."""
    return F.conv(F.substring(F.sha1(text.cast("binary")), 1, 16), 16, 10).cast("decimal(20,0)")


def neglog2(count: Column, total: Column, distinct: Column) -> Column:
    """The cost in bits of a key by add-one smoothing with room for an unseen key."""
    return -F.log2((F.coalesce(count, F.lit(0)) + 1.0) / (total + F.greatest(F.lit(1), distinct) + 1.0))


def ngrams(tokens: Column, n: int) -> Column:
    """All windows of n tokens; none if there are fewer."""
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1))), lambda i: F.slice(tokens, i, n))).otherwise(F.array().cast("array<array<string>>"))


def deltas(values: Column) -> Column:
    n = F.size(values)
    return F.when(n > 1, F.zip_with(F.slice(values, 2, F.greatest(n - 1, F.lit(0))), F.slice(values, 1, F.greatest(n - 1, F.lit(0))), lambda a, b: a - b)).otherwise(F.array().cast("array<int>"))


def undeltas(start: Column, steps: Column) -> Column:
    return F.aggregate(steps, F.array(start), lambda s, d: F.concat(s, F.array(F.element_at(s, -1) + d)))


def pack(items: Column) -> Column:
    """Percent-encoded items joined by dots."""
    return F.array_join(F.transform(items, lambda x: F.url_encode(x)), ".")


def unpack(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(text, r"\."), lambda x: F.url_decode(x)))


def family_label(family: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, FAMILIES)), family), F.lit(0)) - 1, F.lit(0)).cast("int")


def forbidden_keys(json: Column) -> Column:
    """Keys of a JSON text that must not leave with a program, at any depth."""
    keys = F.regexp_extract_all(json, F.lit(r'"([^"]+)"\s*:'), F.lit(1))
    return F.filter(F.array_distinct(keys), lambda k: k.isin(*FORBIDDEN_KEYS))


def dataset_name(name: Column) -> Column:
    return F.replace(F.upper(name), F.lit("_"), F.lit("-"))


def f1(p: Column, r: Column) -> Column:
    return 2 * p * r / F.greatest(F.lit(1e-12), p + r)
