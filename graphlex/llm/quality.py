"""Quality rules: statistics of each text and a learned decision list.

The list is learned from labelled statistics by sequential covering (rule growing by information gain on a growing part,
pruning on a pruning part) and comes out as an ordered chain of Spark conditional expressions, so that the verdict itself
is a plain DataFrame expression.

Null text has no words. Empty tables give empty results; with no labels, or one class only, the list is empty and every text
that passes the base rules is kept. Rows with equal ids each give a row; extra columns are ignored. Labels that are null,
or contradict each other for one id, are not learned from.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

SYMBOLS = "#*$%&|<>"
WINDOW = 8
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines")
STATS_SCHEMA = "doc_id long, " + ", ".join(f"{x} long" for x in STATS)
#: What rules test: ratios of the statistics, each defined for every text.
FEATURES = {
    "n_words": "n_words",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
}


def repeated_words(words: list) -> int:
    """How many words stand in a window of WINDOW words that the text has twice or more. Exact: windows are ranked by doubling."""
    if len(words) <= WINDOW:
        return 0
    ids = pd.factorize(np.array(words, dtype=object))[0].astype(np.int64)
    step = 1
    while step < WINDOW:
        pairs = ids[:-step] * (int(ids.max()) + 1) + ids[step:]
        ids = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
        step *= 2
    found = np.bincount(ids)[ids] > 1
    if not found.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(found)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def stats_of(text: str | None) -> tuple:
    text = text or ""
    raw = text.encode()
    words = raw.split()  # bytes.split() splits at exactly \x20 and \x09-\x0d
    seen, dup = set(), 0
    lines = 0
    for line in raw.split(b"\n"):
        if line.strip():
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
    spaces = sum(raw.count(c) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
    upper = sum(map(str.isupper, text)) if not text.isascii() else len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return len(words), len(text) - spaces, sum(text.count(c) for c in SYMBOLS), dup, repeated_words(words), upper, lines


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [stats_of(x.as_py()) for x in batch.column(1)]
        cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64()) for _ in STATS]
        yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", *STATS])


def text_stats(docs: DataFrame) -> DataFrame:
    """doc_id and STATS for each row of docs."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_stats, STATS_SCHEMA)


def base_failed() -> Column:
    return F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words")


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, '>' or '<=', threshold)."""

    tests: tuple

    def covers(self, x: dict) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for f, op, t in self.tests:
            out &= x[f] > t if op == ">" else x[f] <= t
        return out

    def sql(self) -> str:
        return " AND ".join(f"({FEATURES[f]}) {op} CAST({t!r} AS DOUBLE)" for f, op, t in self.tests)


def _gain(p0: float, n0: float, p: np.ndarray, n: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        g = p * (np.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
    return np.where(p > 0, g, -np.inf)


def _grow(x: dict, y: np.ndarray, most: int) -> Rule:
    """Adds the test of highest gain until no bad case is covered, no gain is left, or `most` tests stand."""
    tests: tuple = ()
    inside = np.ones(len(y), bool)
    while len(tests) < most and (~y[inside]).any():
        p0, n0 = y[inside].sum(), (~y[inside]).sum()
        best = (1e-9, None)
        for f, v in x.items():
            v, t = v[inside], y[inside]
            order = np.argsort(v, kind="stable")
            v, t = v[order], t[order]
            cuts = np.flatnonzero(v[1:] > v[:-1])
            if not len(cuts):
                continue
            p, n = np.cumsum(t)[cuts], np.cumsum(~t)[cuts]
            for op, g in (("<=", _gain(p0, n0, p, n)), (">", _gain(p0, n0, p0 - p, n0 - n))):
                if g[k := int(g.argmax())] > best[0]:
                    best = (g[k], (f, op, float((v[cuts[k]] + v[cuts[k] + 1]) / 2)))
        if best[1] is None:
            break
        tests += (best[1],)
        inside = Rule(tests).covers(x)
    return Rule(tests)


def _prune(rule: Rule, x: dict, y: np.ndarray) -> tuple[Rule, float]:
    """Drops last tests while that doesn't lower (p - n) / (p + n) on the pruning part."""
    worth = []
    for k in range(len(rule.tests), 0, -1):
        c = Rule(rule.tests[:k]).covers(x)
        p, n = int(y[c].sum()), int((~y[c]).sum())
        worth.append(((p - n) / (p + n) if p + n else -1.0, -k, k))
    value, _, k = max(worth)
    return Rule(rule.tests[:k]), value


def learn(x: dict, bad: np.ndarray, min_value: float = 0.8, min_cases: int = 3, most_tests: int = 3, most_rules: int = 16, patience: int = 8, seed: int = 7) -> list[Rule]:
    """An ordered list of rules for bad texts by sequential covering; a rule stays if it is right in 90 % of the pruning part (value 0.8).

    A rule that fails is grown again on other parts; the list ends after `patience` failures in a row.
    """
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    rng = np.random.default_rng(seed)
    failed = 0
    while len(rules) < most_rules and failed < patience and bad[left].sum() >= min_cases:
        failed += 1
        at = np.flatnonzero(left)
        part = rng.random(len(at)) < 2 / 3
        grow, prune = at[part], at[~part]
        if not bad[grow].any() or not bad[prune].any():
            continue
        rule = _grow({f: v[grow] for f, v in x.items()}, bad[grow], most_tests)
        if not rule.tests:
            continue
        rule, value = _prune(rule, {f: v[prune] for f, v in x.items()}, bad[prune])
        covered = rule.covers(x) & left
        if value < min_value or bad[covered].sum() < min_cases or bad[covered].mean() < (1 + min_value) / 2:
            continue
        rules.append(rule)
        failed = 0
        left &= ~covered
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional expression: false at the first rule that holds, else true."""
    out = F
    for r in rules:
        out = out.when(F.expr(r.sql()), F.lit(False))
    return out.otherwise(F.lit(True)) if rules else F.lit(True)


def labelled_stats(docs: DataFrame, labels: DataFrame, most: int) -> tuple[dict, np.ndarray]:
    """Features and `quality = 0` of about `most` labelled documents at most, chosen by a hash of their ids."""
    one = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("a"), F.max("quality").alias("b")).where("a = b").select("doc_id", (F.col("a") == 0).alias("bad"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # a bounded table: `most` rows of 9 bytes
    rows = text_stats(docs.join(F.broadcast(chosen), "doc_id", "left_semi")).join(F.broadcast(chosen), "doc_id").select(*[F.expr(e).cast("double").alias(f) for f, e in FEATURES.items()], "bad").limit(2 * most)
    pdf = rows.toPandas().sort_values([*FEATURES, "bad"], kind="stable")
    return {f: pdf[f].to_numpy(float) for f in FEATURES}, pdf["bad"].to_numpy(bool)


def rate(docs: DataFrame, labels: DataFrame, most_labelled: int = 10_000) -> DataFrame:
    """doc_id, the statistics, base_failed and kept for each row of docs. The list is fitted on `most_labelled` labelled rows at most."""
    x, bad = labelled_stats(docs, labels, most_labelled)
    rules = learn(x, bad) if len(bad) else []
    return text_stats(docs).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
