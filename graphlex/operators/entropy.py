"""Frequency models: counters over token parts, and the cost in bits of tokens under add-one smoothing.

A model is one table (counter, key, n), filled by one aggregate whatever the number of counters. Costs are a join with that table.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tokens as T
from .compact import Rules, split_token
from .motif import Motifs, pairs_of


def components_of(rows: DataFrame) -> DataFrame:
    """(seq_id, pos, tok, counter, key): what the compact model counts of each token of the long form (seq_id, pos, tok)."""
    op, payload = T.op_of(F.col("tok")), T.payload_of(F.col("tok"))
    item = lambda counter, key: F.struct(F.lit(counter).alias("counter"), key.cast("string").alias("key"))
    none = F.array().cast("array<struct<counter:string,key:string>>")
    repeat = F.split(payload, r"\|")
    pairs = T.int_pairs(F.when(op == "REPEAT_EMIT_MERGE", F.get(repeat, F.lit(1))).otherwise(payload))
    grouped = op.isin(*T.GROUPS.values(), "REPEAT_EMIT_MERGE")
    locals_ = F.transform(pairs, lambda p: item("local", p["a"]))
    # A reference counts by its distance from the one before it in the same token; the first from 0.
    deltas = F.transform(pairs, lambda p, i: item("ref_delta", p["b"] - F.when(i > 0, F.get(pairs, i - 1)["b"]).otherwise(0)))
    code = F.when(op.isin("EMIT_CODE", "INTERFACE_CODE"), F.array(item("code", payload))).when(op == "REPEAT_EMIT_MERGE", F.array(item("code", repeat[0]), item("count", F.get(repeat, F.lit(2))))).otherwise(none)
    symbol = F.when(op.rlike("^(MOTIF_MACRO_|ACTION_BPE_)"), F.array(item("symbol", F.col("tok")))).otherwise(none)
    all_items = F.concat(F.array(item("token", F.col("tok")), item("op", op)), code, symbol, F.when(grouped, F.concat(locals_, deltas)).otherwise(none))
    return rows.select("seq_id", "pos", "tok", F.explode(all_items).alias("c")).select("seq_id", "pos", "tok", "c.counter", "c.key")


def counts(components: DataFrame) -> DataFrame:
    """(counter, key, n): all counters in one aggregate."""
    return components.groupBy("counter", "key").agg(F.count("*").alias("n"))


def costs(table: DataFrame) -> DataFrame:
    """(counter, key, bits) and, with a null key, the cost of an unseen key."""
    totals = table.groupBy("counter").agg(F.sum("n").alias("total"), F.count("*").alias("distinct"))
    seen = table.join(F.broadcast(totals), "counter").select("counter", "key", T.neglog2(F.col("n"), F.col("total"), F.col("distinct")).alias("bits"))
    return seen.unionByName(totals.select("counter", F.lit(None).cast("string").alias("key"), T.neglog2(F.lit(0), F.col("total"), F.col("distinct")).alias("bits")))


def token_bits(rows: DataFrame, table: DataFrame) -> DataFrame:
    """(seq_id, pos, tok, bits): the cheaper of a token as a whole and its op with its components."""
    price = costs(table)
    unseen = F.broadcast(price.where("key IS NULL").select("counter", F.col("bits").alias("unseen")))  # one row a counter
    parts = components_of(rows).join(price.where("key IS NOT NULL"), ["counter", "key"], "left").join(unseen, "counter", "left")
    # A counter that was never seen costs log2(2): one unseen key among none.
    bits = F.coalesce("bits", "unseen", F.lit(1.0))
    whole, rest = F.sum(F.when(F.col("counter") == "token", bits)), F.sum(F.when(~F.col("counter").isin("token", "symbol"), bits))
    return parts.groupBy("seq_id", "pos", "tok").agg(F.least(whole, rest).alias("bits"))


def sequence_bits(rows: DataFrame, table: DataFrame) -> DataFrame:
    """(seq_id, n_tokens, bits)."""
    return token_bits(rows, table).groupBy("seq_id").agg(F.count("*").alias("n_tokens"), F.sum("bits").alias("bits"))


def flat_bits(rows: DataFrame) -> DataFrame:
    """(seq_id, n_tokens, bits) under whole-token frequencies of the rows themselves."""
    n = rows.groupBy("tok").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"), F.count("*").alias("distinct"))
    price = n.join(F.broadcast(total)).select("tok", T.neglog2(F.col("n"), F.col("total"), F.col("distinct")).alias("b"))
    return rows.join(price, "tok").groupBy("seq_id").agg(F.count("*").alias("n_tokens"), F.sum("b").alias("bits"))


class MotifModel:
    """Counters of the motif codec's tokens, for use inside per-sequence folds; its tables are rules and alphabets, not corpora."""

    def __init__(self, motifs: Motifs):
        self.motifs = motifs
        self.n: dict[str, Counter] = defaultdict(Counter)
        self.totals: dict[str, tuple[int, int]] = {}  # counts and keys of each counter, those that `n` leaves out included
        self.sequences = 0

    def parts(self, token: str) -> list[tuple[str, str]]:
        """(counter, key) of a token beside the whole token."""
        op, payload = split_token(token)
        out = [("op", op), ("category", op.removeprefix("EMIT_").removesuffix("_BLOCK").lower() if op.endswith("_BLOCK") else op)]
        if not payload.startswith("v2|"):
            if op.endswith("_PATTERN") and (pairs := pairs_of(payload)):
                return out + self.pairs(pairs)
            return out + [("payload", payload)] if payload else out
        _, count, codes, glues, close = payload.split("|", 4)
        out.append(("length", count))
        out += [("code_schema", codes[2:])] if codes.startswith("C:") else [("code", codes[2:])] if codes.startswith("R:") else [("code", c) for c in codes.split(".")]
        if glues.startswith("S:"):
            out.append(("schema", glues[2:]))
        elif glues.startswith("F:R,"):
            out += [("merge_family", "R"), ("payload", glues[4:])]
        elif glues.startswith("F:"):
            code, n, l0, step, *own = glues[2:].split(",")
            out += [("merge_family", code), ("merge_pair_count", n), ("merge_local_start", l0), ("merge_local_step", step), *(("payload", f"{k}={v}") for k, v in enumerate(own))]
        elif glues.startswith("P:"):
            out += [("payload", x) for x in glues[2:].split(".")]
        elif glues:
            before = 0
            for g in self.motifs_glues(glues):
                gop, gpay = split_token(g)
                out.append(("glue_op", gop))
                pairs = pairs_of(gpay) or []
                out += self.pairs(pairs, before)
                before = pairs[-1][1] if pairs else before
        return out + [("close", close)] if close else out

    @staticmethod
    def motifs_glues(text: str) -> list[str]:
        from .motif import unpack_glues

        return unpack_glues(text, {})

    @staticmethod
    def pairs(pairs: list[tuple[int, int]], before: int = 0) -> list[tuple[str, str]]:
        out = []
        for a, b in pairs:
            out += [("local", str(a)), ("ref_delta", str(b - before))]
            before = b
        return out

    def observe(self, tokens: Iterable[str]) -> None:
        self.sequences += 1
        for t in tokens:
            self.n["token"][t] += 1
            for c, k in self.parts(t):
                self.n[c][k] += 1

    def price(self, counter: str, key: str) -> float:
        c = self.n[counter]
        total, distinct = self.totals.get(counter) or (c.total(), len(c))
        return -math.log2((c[key] + 1) / (total + max(1, distinct) + 1))

    def token_bits(self, token: str) -> float:
        whole, parts = self.price("token", token), sum(self.price(c, k) for c, k in self.parts(token))
        payload = split_token(token)[1].split("|")
        schema_like = payload[0] != "v2" or (payload[2].startswith(("R:", "C:")) and payload[3].startswith(("S:", "F:")))
        return min(whole, parts) if schema_like else parts

    def bits(self, tokens: Iterable[str]) -> float:
        return sum(map(self.token_bits, tokens))

    def rulebook_bits(self) -> float:
        return rulebook_bits(self.motifs.rules) + 8.0 * sum(len(k) + sum(map(len, v)) for rules in (self.motifs.glue_schemas, self.motifs.code_schemas, self.motifs.structural) for k, v in rules.items())

    @classmethod
    def fit(cls, motifs: Motifs, sequences: DataFrame, most_keys: int = 1_000_000) -> MotifModel:
        """Counts over a table of encoded sequences (tokens); what reaches the driver is counters, `most_keys` keys at most, the most frequent.

        Totals and alphabets are those of all keys; a key beyond `most_keys` is priced as unseen.
        """
        import pandas as pd

        blank = cls(motifs)

        def run(batches):
            for own in batches:
                n: Counter = Counter()
                for toks in own["tokens"]:
                    for t in toks:
                        n["token", t] += 1
                        n.update(blank.parts(t))
                yield pd.DataFrame([(c, k, v) for (c, k), v in n.items()], columns=["counter", "key", "n"])

        table = sequences.select("tokens").mapInPandas(run, "counter string, key string, n bigint").groupBy("counter", "key").agg(F.sum("n").alias("n"))
        out = cls(motifs)
        table = table.persist()  # small against the sequences; computed again if it is lost
        for r in table.groupBy("counter").agg(F.sum("n").alias("total"), F.count("*").alias("distinct")).collect():  # a dozen counters
            out.totals[r.counter] = (r.total, r["distinct"])
        for r in table.orderBy(F.desc("n"), "counter", "key").limit(most_keys).collect():
            out.n[r.counter][r.key] = r.n
        table.unpersist()
        out.sequences = sequences.count()
        return out


def rulebook_bits(rules: Rules) -> float:
    return rules.bits()


def usage(rows: DataFrame, key: str) -> DataFrame:
    """(key, n, share, rank) of a column's values."""
    n = rows.groupBy(key).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return n.select(key, "n", (F.col("n") / total).alias("share"), F.row_number().over(Window.orderBy(F.desc("n"), key)).alias("rank"))
