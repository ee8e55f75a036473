"""The motif codec: spans of alternating EMIT_CODE and glue tokens become one token with parameters, frequent structural spans become rules.

A span's token is EMIT_<CATEGORY>_BLOCK(v2|count|codes|glues|close). Codes are a run, a learned schema or a list; glues are the shortest of a
list, a learned schema, an arithmetic family over single pairs, or a list with families inside. All of it is reversible.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .compact import Rules, fit as fit_compact, group_runs, over_arrays, replace, split_token, ungroup

GLUES = ("MERGE_NODE_PATTERN", "MERGE_EDGE_PATTERN", "ATTACH_PATTERN")
CLOSE = "CLOSE_CYCLE_PATTERN"


def q(text: str) -> str:
    return quote(text, safe="").replace(".", "%2E")


def pairs_of(payload: str) -> list[tuple[int, int]] | None:
    try:
        out = [tuple(map(int, x.split(":"))) for x in payload.split(";")]
    except ValueError:
        return None
    return out if all(len(x) == 2 for x in out) and ";".join(f"{a}:{b}" for a, b in out) == payload else None


def steps(values: Sequence[int]) -> set[int]:
    return {b - a for a, b in zip(values, values[1:], strict=False)}


#: How families rebuild (local, reference) pairs from their fields after count, first local and local step.
FAMILIES: dict[str, Callable] = {
    "I": lambda ls: list(ls),
    "O": lambda ls, d: [x + d for x in ls],
    "V": lambda ls, s: [s - x for x in ls],
    "W": lambda ls, r: [r] * len(ls),
    "A": lambda ls, r0, rs: [r0 + rs * i for i in range(len(ls))],
}


def family(pairs: list[tuple[int, int]], both_constant: bool) -> str | None:
    """Fields of the first family that gives these pairs: code, count, first local, local step, and its own numbers."""
    ls, rs = [a for a, _ in pairs], [b for _, b in pairs]
    if len(pairs) < 2 or len(steps(ls)) != 1 or (both_constant and len(steps(rs)) != 1):
        return None
    head = f"{len(pairs)},{ls[0]},{ls[1] - ls[0]}"
    if ls == rs:
        return f"I,{head}"
    if len({b - a for a, b in pairs}) == 1:
        return f"O,{head},{rs[0] - ls[0]}"
    if len({a + b for a, b in pairs}) == 1:
        return f"V,{head},{ls[0] + rs[0]}"
    if len(set(rs)) == 1:
        return f"W,{head},{rs[0]}"
    if len(steps(rs)) == 1:
        return f"A,{head},{rs[0]},{rs[1] - rs[0]}"
    return None


def family_pairs(text: str) -> list[tuple[int, int]]:
    code, n, l0, step, *own = text.split(",")
    ls = [int(l0) + int(step) * i for i in range(int(n))]
    return list(zip(ls, FAMILIES[code](ls, *map(int, own)), strict=True))


def pack_glue(glue: str) -> str:
    """One glue token, by a family inside it if that is shorter."""
    op, payload = split_token(glue)
    pairs = pairs_of(payload) if op == "MERGE_NODE_PATTERN" else None
    if pairs and len(pairs) > 1:
        best = family(pairs, False)
        deltas = lambda v: ";".join(str(b - a) for a, b in zip(v, v[1:], strict=False))
        best = best or f"D,{pairs[0][0]},{pairs[0][1]},{deltas([a for a, _ in pairs])},{deltas([b for _, b in pairs])}"
        if len(best) + 2 < len(glue):
            return f"M:{best}"
    return glue


def unpack_glue(item: str) -> str:
    if not item.startswith("M:"):
        return item
    text = item[2:]
    if text.startswith("D,"):
        _, l0, r0, dl, dr = text.split(",")
        a, b = [int(l0)], [int(r0)]
        for out, ds in ((a, dl), (b, dr)):
            for d in ds.split(";"):
                out.append(out[-1] + int(d))
        pairs = list(zip(a, b, strict=True))
    else:
        pairs = family_pairs(text)
    return "MERGE_NODE_PATTERN(" + ";".join(f"{x}:{y}" for x, y in pairs) + ")"


def pack_glues(glues: list[str], schemas: dict[tuple, str]) -> str:
    """The shortest form; of equally short ones raw, schema, family, packed."""
    if not glues:
        return ""
    forms = [".".join(map(q, glues))]
    if tuple(glues) in schemas:
        forms.append(f"S:{schemas[tuple(glues)]}")
    single = [pairs_of(split_token(g)[1]) if g.startswith("MERGE_NODE_PATTERN(") else None for g in glues]
    if len(glues) > 1 and len(set(glues)) == 1:
        forms.append(f"F:R,{len(glues)},{q(glues[0])}")
    elif len(glues) > 1 and all(p and len(p) == 1 for p in single) and (best := family([p[0] for p in single], True)):
        forms.append(f"F:{best}")
    packed = [pack_glue(g) for g in glues]
    if packed != glues:
        forms.append("P:" + ".".join(map(q, packed)))
    return min(forms, key=len)


def unpack_glues(text: str, schemas: dict[str, tuple]) -> list[str]:
    if not text:
        return []
    if text.startswith("S:"):
        return list(schemas[text[2:]])
    if text.startswith("F:R,"):
        _, n, item = text[2:].split(",", 2)
        return [unquote(item)] * int(n)
    if text.startswith("F:"):
        return [f"MERGE_NODE_PATTERN({a}:{b})" for a, b in family_pairs(text[2:])]
    if text.startswith("P:"):
        return [unpack_glue(unquote(x)) for x in text[2:].split(".")]
    return [unquote(x) for x in text.split(".")]


def star_like(glues: list[str]) -> bool:
    """Three glues or more that all merge into one reference from different locals."""
    pairs = [pairs_of(split_token(g)[1]) if g.startswith("MERGE_NODE_PATTERN(") else None for g in glues]
    if len(glues) < 3 or not all(pairs):
        return False
    flat = [x for p in pairs for x in p]
    return len({b for _, b in flat}) == 1 and len({a for a, _ in flat}) >= 2


def find_span(tokens: list[str], start: int, least: int, longest: int) -> tuple[list[str], list[str], str, int] | None:
    """(codes, glues, close, end) of the span EMIT_CODE (glue EMIT_CODE)* [glue] [close] at start, if it has `least` emits."""
    if not tokens[start].startswith("EMIT_CODE("):
        return None
    codes, glues, i = [split_token(tokens[start])[1]], [], start + 1
    while i < len(tokens) and i - start < longest and split_token(tokens[i])[0] in GLUES:
        if i + 1 < len(tokens) and tokens[i + 1].startswith("EMIT_CODE(") and i + 2 - start <= longest:
            glues.append(tokens[i])
            codes.append(split_token(tokens[i + 1])[1])
            i += 2
        else:
            glues.append(tokens[i])
            i += 1
            break
    close = ""
    if i < len(tokens) and tokens[i].startswith(f"{CLOSE}(") and i - start < longest:
        close = tokens[i]
        i += 1
    return (codes, glues, close, i) if len(codes) >= least else None


@dataclass
class Motifs:
    """What the motif codec has learned, with the compact rules beneath it."""

    rules: Rules = field(default_factory=Rules)
    glue_schemas: dict[str, tuple] = field(default_factory=dict)
    code_schemas: dict[str, tuple] = field(default_factory=dict)
    structural: dict[str, tuple] = field(default_factory=dict)
    categories: dict[str, str] = field(default_factory=dict)
    least_emits: int = 3
    longest: int = 96

    def category(self, codes: list[str], glues: list[str], close: str) -> str:
        kinds = {self.categories.get(c, "motif") for c in codes}
        if close:
            return "CYCLE"
        if kinds == {"clique"}:
            return "CLIQUE"
        if star_like(glues):
            return "STAR"
        if kinds <= {"edge", "chain", "treelet"}:
            return "CHAIN"
        return "CYCLE" if kinds == {"cycle"} else "MOTIF"

    def make(self, codes: list[str], glues: list[str], close: str) -> str:
        by_codes = {v: k for k, v in self.code_schemas.items()}
        packed = f"R:{q(codes[0])}" if len(set(codes)) == 1 else f"C:{by_codes[tuple(codes)]}" if tuple(codes) in by_codes else ".".join(map(q, codes))
        glue = pack_glues(glues, {v: k for k, v in self.glue_schemas.items()})
        return f"EMIT_{self.category(codes, glues, close)}_BLOCK(v2|{len(codes)}|{packed}|{glue}|{q(close)})"

    def expand(self, token: str) -> list[str]:
        _, count, codes, glues, close = split_token(token)[1].split("|", 4)
        n = int(count)
        own = [unquote(codes[2:])] * n if codes.startswith("R:") else list(self.code_schemas[codes[2:]]) if codes.startswith("C:") else [unquote(x) for x in codes.split(".")]
        between = unpack_glues(glues, self.glue_schemas)
        if len(own) != n or len(between) not in (n - 1, n):
            raise ValueError(f"{len(own)} codes and {len(between)} glues for a count of {n}")
        out = []
        for k, c in enumerate(own):
            out.append(f"EMIT_CODE({c})")
            out += between[k : k + 1]
        return out + ([unquote(close)] if close else [])

    def parameterized(self, tokens: list[str], cost: Callable[[list[str]], float] | None = None) -> list[str]:
        """Spans become parameterised tokens; with a cost only where the token costs less than what the compact rules make of the span."""
        out, i = [], 0
        while i < len(tokens):
            span = find_span(tokens, i, self.least_emits, self.longest)
            if span is None:
                out.append(tokens[i])
                i += 1
                continue
            *parts, end = span
            token = self.make(*parts)
            plain = self.rules.apply(tokens[i:end])
            out += [token] if cost is None or cost([token]) < cost(plain) else plain
            i = end
        return out

    def structure(self, tokens: list[str]) -> list[str]:
        for name, parts in self.structural.items():
            tokens = replace(tokens, parts, name)
        return tokens

    def motif_only(self, tokens: list[str]) -> list[str]:
        return self.rules.apply(self.structure(self.parameterized(group_runs(tokens))))

    def encode(self, tokens: list[str]) -> list[str]:
        """The motif form if it is shorter than the compact form, else that."""
        a, b = self.motif_only(tokens), self.rules.encode(tokens)
        return a if len(a) < len(b) else b

    def encode_hybrid(self, tokens: list[str], compact_cost: Callable[[list[str]], float] | None = None, motif_cost: Callable[[list[str]], float] | None = None) -> list[str]:
        """Per span and then per sequence whichever costs fewer bits; without costs, fewer tokens."""
        own, plain = motif_cost or len, compact_cost or len
        a, b = self.rules.apply(self.structure(self.parameterized(group_runs(tokens), own))), self.rules.encode(tokens)
        return a if own(a) <= plain(b) else b

    def decode(self, tokens: list[str]) -> list[str]:
        full, out = self.rules.closure(), []
        for name, parts in self.structural.items():
            full[name] = [x for p in parts for x in full.get(p, [p])]
        todo = list(reversed(tokens))
        while todo:
            t = todo.pop()
            if t in full:
                todo += reversed(full[t])
            elif "_BLOCK(v2|" in t:
                out += self.expand(t)
            else:
                out.append(t)
        return ungroup(out)

    def usage(self, sequences: Sequence[list[str]]) -> dict[str, int]:
        out: dict[str, int] = {}
        for s in sequences:
            for t in s:
                op = split_token(t)[0]
                out[op] = out.get(op, 0) + 1
        return out


def _schemas(rows: DataFrame, column: str, prefix: str, most: int, least_count: int) -> dict[str, tuple]:
    """The most saving tuples: (size - 1)(count - 1), then count, size and content. `most` rows reach the driver."""
    counts = rows.where(F.size(column) > 1).groupBy(column).agg(F.count("*").alias("n")).where(F.col("n") >= least_count)
    saved = (F.size(column) - 1) * (F.col("n") - 1)
    top = counts.orderBy(F.desc(saved), F.desc("n"), F.desc(F.size(column)), column).limit(most).collect()
    return {f"{prefix}{k:04d}": tuple(r[column]) for k, r in enumerate(top)}


SPANS = "seq_id string, codes array<string>, glues array<string>, close string"


def spans(sequences: DataFrame, least: int, longest: int) -> DataFrame:
    """(seq_id, codes, glues, close) of all spans of sequences in the grouped form."""
    import pandas as pd

    def run(batches):
        for own in batches:
            out = []
            for name, toks in zip(own["seq_id"], own["tokens"], strict=True):
                toks, i = list(toks), 0
                while i < len(toks):
                    s = find_span(toks, i, least, longest)
                    if s:
                        out.append((name, *s[:3]))
                    i = s[3] if s else i + 1
            yield pd.DataFrame(out, columns=["seq_id", "codes", "glues", "close"])

    return sequences.select(F.col("seq_id").cast("string").alias("seq_id"), "tokens").mapInPandas(run, SPANS)


def learn_structural(sequences: DataFrame, categories: dict[str, str], most: int, least_count: int, longest: int) -> dict[str, tuple]:
    """Rules for frequent spans that start and end with EMIT_CODE, greatest savings first; a job for each."""
    from .compact import gram_counts, replace_in_rows
    from .graph import cut

    rules: dict[str, tuple] = {}
    now = cut(sequences.select("seq_id", "tokens"))
    while len(rules) < most:
        span = F.forall("gram", lambda t: t.rlike("^(EMIT_CODE|" + "|".join(GLUES) + r")\("))
        ends = F.element_at("gram", 1).startswith("EMIT_CODE(") & (F.size(F.filter("gram", lambda t: t.startswith("EMIT_CODE("))) >= 2)
        grams = gram_counts(now, tuple(range(3, longest + 1))).where(span & ends).withColumn("len", F.size("gram")).withColumn("saved", (F.col("len") - 1) * (F.col("n") - 1))
        best = grams.orderBy(F.desc("saved"), F.desc("n"), F.desc("len"), "first").limit(1).collect()
        if not best or best[0].n < least_count or best[0].saved <= 0:
            break
        parts = tuple(best[0].gram)
        kinds = {categories.get(split_token(t)[1], "motif") for t in parts if t.startswith("EMIT_CODE(")}
        name = "CHAIN" if kinds <= {"edge", "chain", "treelet"} else next(iter(kinds)).upper() if len(kinds) == 1 and kinds <= {"clique", "cycle", "star"} else "MOTIF"
        token = f"EMIT_{name}_BLOCK({len(rules):04d})"
        rules[token] = parts
        now = cut(replace_in_rows(now, parts, token))
    return rules


def fit(sequences: DataFrame, categories: dict[str, str] | None = None, rules: Rules | None = None, most_schemas: int = 256, least_count: int = 2, most_structural: int = 384, structural_len: int = 24, least_emits: int = 3, longest: int = 96, **compact) -> Motifs:
    """Learns schemas and structural rules from original sequences (seq_id, tokens), on top of compact rules."""
    base = over_arrays(sequences.select("seq_id", "tokens"), group_runs)
    m = Motifs(rules or fit_compact(sequences, **compact)[0], categories=categories or {}, least_emits=least_emits, longest=longest)
    found = spans(base, least_emits, longest)
    m.glue_schemas = _schemas(found, "glues", "", most_schemas, least_count)
    m.code_schemas = _schemas(found.where(F.size(F.array_distinct("codes")) > 1), "codes", "", most_schemas, least_count)
    if most_structural:
        m.structural = learn_structural(over_arrays(base, m.parameterized), m.categories, most_structural, least_count, structural_len)
    return m


def code_categories(codes: DataFrame) -> dict[str, str]:
    """Category of each code; a codebook is small."""
    from .codebook import shape_category
    from .kernels import adjacency, component_sets

    out = {}
    rows = codes.select("code", "n", "edges").collect()
    spark = codes.sparkSession
    facts = []
    for r in rows:
        adj = adjacency([tuple(x) for x in r.edges], range(r.n))
        d = [len(a) for a in adj.values()] or [0]
        facts.append((r.code, r.n, len(r.edges), max(d), min(d), len(component_sets(adj)) <= 1))
    if facts:
        df = spark.createDataFrame(facts, "code int, n int, e int, hi int, lo int, whole boolean")
        kind = shape_category(*[F.col(c) for c in ("n", "e", "hi", "lo", "whole")])
        out = {str(r.code): r.kind for r in df.select("code", kind.alias("kind")).collect()}
    return out
