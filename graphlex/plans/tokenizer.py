"""The tokenizer: fits a codebook, compact and motif rules and frequency models on graphs; encodes graphs in six modes; decodes them.

>>> model = GraphTokenizer(options).fit(edges)
>>> encoded = model.encode(edges, "compact")
>>> graphs = model.decode(encoded)
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import codebook, compact, motif, patches, program
from ..operators.entropy import MotifModel
from ..operators.graph import cut
from ..schemas import ENCODED
from ..sources.records import merge_options, read_document, write_document

#: The modes.
MODES = ("original", "compact", "entropy", "motif_macro", "motif_entropy", "motif_hybrid")
DEFAULTS = {
    "patch": {"sparse_edge_patches": False},
    "codebook": {"num_codes": 4096},
    "program": {"ref_window": 768, "block_size": 12, "begin_blocks": True, "refine_min_nodes": 3},
    "compact": {"max_macros": 384, "min_macro_count": 3, "max_macro_len": 12, "max_merges": 384, "min_merge_count": 3},
    "motif": {"least_emits": 3, "longest": 96, "most_schemas": 256, "least_count": 2, "most_structural": 384, "structural_len": 24},
}
HIGH_FIDELITY = {
    "patch": {"max_patches_per_graph": 12000, "sparse_edge_patches": True, "sparse_density": 1.0, "sparse_clustering": 1.0, "max_port_capacity": 32},
    "program": {"ref_window": 20000, "block_size": 64},
    "compact": {"max_macros": 768, "min_macro_count": 2, "max_macro_len": 24, "max_merges": 768, "min_merge_count": 2},
    "motif": {"least_emits": 2, "longest": 512, "most_schemas": 768, "most_structural": 768, "structural_len": 128},
}


class GraphTokenizer:
    def __init__(self, options: dict | None = None, high_fidelity: bool = False):
        self.options = merge_options(merge_options(DEFAULTS, HIGH_FIDELITY if high_fidelity else {}), options)

    def patches(self, edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
        return patches.propose(edges, self.options["patch"], nodes)

    def fit(self, edges: DataFrame, nodes: DataFrame | None = None) -> TokenizerModel:
        o = self.options
        found = cut(self.patches(edges, nodes))
        codes = codebook.with_basics(codebook.shape_codes(found, o["codebook"]["num_codes"]))
        known = {r.code: {"n": r.n, "edges": [tuple(e) for e in r.edges], "visual_key": r.visual_key} for r in codes.collect()}  # num_codes rows and two
        model = TokenizerModel(edges.sparkSession, o, known)
        sequences = cut(model.sequences(edges, nodes))
        rules, short = compact.fit(sequences.withColumnRenamed("graph_id", "seq_id"), **o["compact"])
        renamed = sequences.withColumnRenamed("graph_id", "seq_id")
        m = o["motif"]
        model.motifs = motif.fit(renamed, motif.code_categories(codes), rules, m["most_schemas"], m["least_count"], m["most_structural"], m["structural_len"], m["least_emits"], m["longest"])
        model.compact_model = MotifModel.fit(model.motifs, short)
        model.motif_model = MotifModel.fit(model.motifs, compact.over_arrays(renamed, model.motifs.encode))
        hybrid = compact.over_arrays(renamed, model.light().hybrid)
        model.hybrid_model = MotifModel.fit(model.motifs, hybrid)
        size = lambda df: max(2, df.select(F.explode("tokens")).distinct().count())
        model.sizes = {"compact": size(short), "motif_macro": size(compact.over_arrays(renamed, model.motifs.encode))}
        return model


@dataclass
class TokenizerModel:
    spark: SparkSession | None
    options: dict
    codes: dict[int, dict]
    motifs: motif.Motifs | None = None
    compact_model: MotifModel | None = None
    motif_model: MotifModel | None = None
    hybrid_model: MotifModel | None = None
    sizes: dict[str, int] = field(default_factory=dict)

    def code_table(self) -> DataFrame:
        rows = [(k, c["n"], [list(e) for e in c["edges"]], c["visual_key"]) for k, c in self.codes.items()]
        return self.spark.createDataFrame(rows, "code int, n int, edges array<array<int>>, visual_key string")

    def actions(self, edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
        """Programs of graphs; patches without a code of their exact shape are broken up into edges."""
        o = self.options["program"]
        found = patches.propose(edges, self.options["patch"], nodes)
        codes = self.code_table()
        exact = patches.refine_inexact(cut(found), codes, edges.select(F.col("graph_id").cast("string").alias("graph_id"), "u", "v"), o["refine_min_nodes"])
        coded = codebook.assign_exact(exact, codes).where("code IS NOT NULL")
        return program.compile_patches(coded.select("graph_id", "pos", "nodes", "code"), o["ref_window"], o["block_size"], o["begin_blocks"])

    def sequences(self, edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
        return program.sequences(self.actions(edges, nodes))

    def light(self) -> TokenizerModel:
        """The model without its session, to send to workers."""
        return replace(self, spark=None)

    def hybrid(self, tokens: list[str]) -> list[str]:
        return self.motifs.encode_hybrid(tokens, self.compact_model.bits, self.motif_model.bits)

    def fold(self, mode: str):
        if mode not in MODES:
            raise ValueError(f"no mode is called {mode}")
        return {"original": list, "compact": self.motifs.rules.encode, "entropy": self.motifs.rules.encode, "motif_macro": self.motifs.encode, "motif_entropy": self.motifs.encode, "motif_hybrid": self.hybrid}[mode]

    def unfold(self, mode: str):
        return list if mode == "original" else self.motifs.rules.decode if mode in ("compact", "entropy") else self.motifs.decode

    def bits(self, mode: str, tokens: list[str]) -> float:
        if mode == "original":
            code, ref = math.log2(max(2, len(self.codes))), math.log2(max(2, self.options["program"]["ref_window"]))
            cost = {"EMIT": code, "INTERFACE": code, "GLOBAL_LINK": 2 * math.log2(max(2, len(tokens)))} | dict.fromkeys(("ATTACH", "CLOSE_CYCLE", "MERGE_NODE", "MERGE_EDGE"), ref + 4)
            return sum(1.5 + cost.get(t.partition("(")[0], 0.0) for t in tokens)
        if mode in self.sizes:
            return len(tokens) * math.log2(self.sizes[mode])
        return {"entropy": self.compact_model, "motif_entropy": self.motif_model, "motif_hybrid": self.hybrid_model}[mode].bits(tokens)

    def encode(self, edges: DataFrame, *modes: str, nodes: DataFrame | None = None) -> DataFrame:
        """A row of schemas.ENCODED for each graph and mode, with whether decoding gives the original tokens back."""
        counts = edges.groupBy(F.col("graph_id").cast("string").alias("graph_id")).agg(F.count("*").alias("num_edges"))
        rows = self.sequences(edges, nodes).join(counts, "graph_id", "left")
        light = self.light()
        todo = [(m, light.fold(m), light.unfold(m)) for m in modes or MODES]

        def run(batches):
            for own in batches:
                out = []
                for r in own.itertuples():
                    tokens = list(r.tokens)
                    for m, fold, unfold in todo:
                        short = fold(tokens)
                        bits = light.bits(m, short)
                        out.append((r.graph_id, m, short, bits, bits / max(1, r.num_edges or 0), len(tokens), len(short), float(unfold(short) == tokens)))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in ENCODED.split(", ")])

        return rows.mapInPandas(run, ENCODED)

    def decode(self, encoded: DataFrame) -> DataFrame:
        """Graphs (program.EXECUTED) of encoded rows (graph_id, mode, tokens), one mode or several."""
        light = self.light()

        def run(batches):
            for own in batches:
                own["tokens"] = [light.unfold(m)(list(t)) for m, t in zip(own["mode"], own["tokens"], strict=True)]
                yield own

        back = encoded.select("graph_id", "mode", "tokens").mapInPandas(run, "graph_id string, mode string, tokens array<string>")
        named = back.select(F.concat_ws("\u0001", "graph_id", "mode").alias("graph_id"), "tokens")
        out = program.execute(named, self.codes, ref_window=self.options["program"]["ref_window"])
        return out.withColumn("mode", F.split("graph_id", "\u0001")[1]).withColumn("graph_id", F.split("graph_id", "\u0001")[0])

    def evaluate(self, edges: DataFrame, *modes: str) -> DataFrame:
        """Fidelity of each graph and mode after encoding and decoding."""
        from ..operators.metrics import structure_fidelity

        back = self.decode(self.encode(edges, *modes))
        own = edges.groupBy(F.col("graph_id").cast("string").alias("graph_id")).agg(F.array_sort(F.collect_list(F.array("u", "v"))).alias("a_edges"))
        ids = F.array_sort(F.array_distinct(F.flatten("a_edges")))
        dense = own.withColumn("ids", ids).select("graph_id", F.size("ids").alias("a_nodes"), F.transform("a_edges", lambda e: F.transform(e, lambda v: (F.array_position(F.col("ids"), v) - 1).cast("int"))).alias("a_edges"))
        pairs = back.join(dense, "graph_id").select(F.concat_ws("\u0001", "graph_id", "mode").alias("graph_id"), "a_nodes", "a_edges", F.col("num_nodes").alias("b_nodes"), F.col("edges").alias("b_edges"))
        out = structure_fidelity(pairs)
        return out.withColumn("mode", F.split("graph_id", "\u0001")[1]).withColumn("graph_id", F.split("graph_id", "\u0001")[0])

    def save(self, path: str) -> None:
        """One JSON document: options, codes, rules, schemas, counters and vocabulary sizes."""
        m = self.motifs
        content = {
            "format": "graphlex_tokenizer_1", "options": self.options, "codes": {str(k): {**c, "edges": [list(e) for e in c["edges"]]} for k, c in self.codes.items()}, "sizes": self.sizes,
            "macros": [[k, list(v)] for k, v in m.rules.macros.items()], "merges": [[k, list(v)] for k, v in m.rules.merges.items()], "categories": m.categories, "least_emits": m.least_emits, "longest": m.longest,
            **{name: [[k, list(v)] for k, v in getattr(m, name).items()] for name in ("glue_schemas", "code_schemas", "structural")},
            "models": {name: {"sequences": x.sequences, "totals": {c: list(v) for c, v in x.totals.items()}, "counts": {c: dict(n) for c, n in x.n.items()}} for name, x in (("compact", self.compact_model), ("motif", self.motif_model), ("hybrid", self.hybrid_model))},
        }
        write_document(path, {**content, "order": {k: [x[0] for x in content[k]] for k in ("macros", "merges", "structural")}})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TokenizerModel:
        from collections import Counter

        c = read_document(path)
        rules = compact.Rules({k: tuple(v) for k, v in c["macros"]}, {k: tuple(v) for k, v in c["merges"]})
        own = {name: {k: tuple(v) for k, v in c[name]} for name in ("glue_schemas", "code_schemas", "structural")}
        m = motif.Motifs(rules, **own, categories=c["categories"], least_emits=c["least_emits"], longest=c["longest"])
        out = cls(spark, c["options"], {int(k): {**v, "edges": [tuple(e) for e in v["edges"]]} for k, v in c["codes"].items()}, m, sizes=c["sizes"])
        for name, x in c["models"].items():
            model = MotifModel(m)
            model.sequences = x["sequences"]
            model.totals = {counter: tuple(v) for counter, v in x.get("totals", {}).items()}
            for counter, n in x["counts"].items():
                model.n[counter] = Counter(n)
            setattr(out, f"{name}_model", model)
        return out
