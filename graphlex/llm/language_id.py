"""Language identification by language-bitmask n-gram filters.

Every language has a Bloom filter of its frequent character n-grams; the filters share their hash functions and lie bit-sliced
in one table, whose slot holds a bitmask over languages. Looking up an n-gram ANDs the slots it hashes to, which returns all
languages that contain it at once. A text is decided by the popcount of each language over the text's n-grams, corrected for
the false positives that the fill of that language's filter lets one expect.

Training takes at most about `docs_per_language` documents of each language and `grams_per_language` n-grams for each; the
table's size follows from these parameters, not from the corpus. Prediction reads whole texts and nothing but the text.

Null texts and texts without a letter are `und` with score 0. Without any training row every text is `und`. Ties go to the
language that comes first by name. Repeated rows each give a row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import received, share, small_batches, table, worker_memo

SIZES = (1, 2, 3, 4)
PROBES = 3
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
#: Longer texts are looked up piece by piece.
PIECE = 1 << 18
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    memo = worker_memo()
    if "letters" not in memo:
        memo["letters"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return memo["letters"]


def code_points(text: str) -> np.ndarray:
    """Lower-cased letters, every run of other characters as one space, a space at either end."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[c]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    c = np.where(is_letter, c, 32)[keep]
    if not len(c) or not is_letter.any():
        return np.zeros(0, np.uint32)
    return np.concatenate([[32] if c[0] != 32 else [], c, [32] if c[-1] != 32 else []]).astype(np.uint32)


def grams(c: np.ndarray) -> Iterator[np.ndarray]:
    """64-bit hashes of the n-grams of each size."""
    c = c.astype(np.uint64)
    for n in SIZES:
        if len(c) < n:
            return
        h = np.full(len(c) - n + 1, n, np.uint64)
        for j in range(n):
            h += c[j : j + len(h)] * _K[j]
            h ^= h >> np.uint64(31)
            h *= _K[(j + 1) % 4]
        yield h ^ (h >> np.uint64(29))


class Filters:
    """The bit-sliced filters of all languages."""

    def __init__(self, hashes: dict[str, np.ndarray], bits_per_gram: int = 32):
        self.names = sorted(hashes)
        need = max([1, *(len(x) for x in hashes.values())]) * bits_per_gram
        self.bits = min(21, max(10, need.bit_length()))  # three probes take 21 bits each of a 64-bit hash
        self.slots = np.zeros((1 << self.bits, (len(self.names) + 7) // 8), np.uint8)
        for i, x in enumerate(self.names):
            for s in self.at(hashes[x].astype(np.uint64)):
                self.slots[s, i // 8] |= np.uint8(1 << i % 8)
        fill = self.popcounts(self.slots) / len(self.slots)
        self.false_positives = fill**PROBES

    def at(self, h: np.ndarray) -> list[np.ndarray]:
        return [(h >> np.uint64(21 * k)).astype(np.int64) & ((1 << self.bits) - 1) for k in range(PROBES)]

    def popcounts(self, masks: np.ndarray) -> np.ndarray:
        """For each language the number of masks with its bit."""
        bit = (np.arange(256)[:, None] >> np.arange(8)) & 1
        return np.concatenate([np.bincount(masks[:, b], minlength=256) @ bit for b in range(masks.shape[1])] or [np.zeros(0)])[: len(self.names)].astype(float)

    def masks(self, h: np.ndarray) -> np.ndarray:
        a, *rest = self.at(h)
        out = self.slots[a]
        for s in rest:
            out &= self.slots[s]
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        c = code_points(text or "")
        if not len(c) or not self.names:
            return "und", 0.0
        hits, n = np.zeros(len(self.names)), 0
        for start in range(0, len(c), PIECE):
            for h in grams(c[start : start + PIECE + SIZES[-1] - 1]):
                hits += self.popcounts(self.masks(h))
                n += len(h)
        true = np.clip((hits - n * self.false_positives) / (1 - self.false_positives), 0, n)
        best = int(true.argmax())
        return self.names[best], float(true[best] / n)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column(1).to_pylist()
        for lang in sorted(set(langs)):
            at = [h for x, own in zip(batch.column(0), langs, strict=True) if own == lang for h in grams(code_points(x.as_py()))]
            if at:
                h, n = np.unique(np.concatenate(at), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h)), pa.array(h.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "gram", "n"])


def fit(labelled: DataFrame, docs_per_language: int = 400, grams_per_language: int = 20_000, least: int = 3, ratio: float = 0.3) -> Filters:
    """Filters from rows of (doc_id, text, lang) with neither text nor lang null.

    A language contains an n-gram that was found `least` times in it and has at least `ratio` times the relative frequency
    that it has in the language where it is most frequent (else stray foreign lines would count); the most frequent ones stay.
    """
    rows = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not rows:
        return Filters({})
    share = F.lit(0.0)
    for lang, n in sorted(rows.items()):
        share = F.when(F.col("lang") == lang, F.lit(docs_per_language / n)).otherwise(share)
    some = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30)).select("text", "lang")
    counts = some.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # Bounded by the sample; each language has its own total.
    share = F.col("n") / F.sum("n").over(Window.partitionBy("lang"))
    high = F.max("share").over(Window.partitionBy("gram"))
    own = counts.withColumn("share", share).withColumn("high", high).where((F.col("n") >= least) & (F.col("share") >= ratio * F.col("high")))
    top = own.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("k") <= grams_per_language)
    pdf = top.select("lang", "gram").toPandas()  # grams_per_language rows for each language at most
    out = {x: np.zeros(0, np.uint64) for x in rows} | {x: g["gram"].to_numpy(np.int64).view(np.uint64) for x, g in pdf.groupby("lang")}
    return Filters(out)


def _predictor(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = received(shared)
        for batch in batches:
            got = [f.predict(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    shared = share(docs.sparkSession, filters)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(_predictor(shared), SCHEMA)


def _keeper(shared, column: int, least: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = received(shared)
        for batch in batches:
            got = [f.predict(x.as_py()) for x in batch.column(column)]
            yield batch.filter(pa.array([lang != "und" and s >= least for lang, s in got], pa.bool_()))

    return run


def keep_known(docs: DataFrame, filters: Filters, least_score: float) -> DataFrame:
    """The rows of docs, unchanged, whose text is in a known language with at least that score. Needs no id and no shuffle."""
    small_batches(docs.sparkSession)
    shared = share(docs.sparkSession, filters)
    return docs.mapInArrow(_keeper(shared, docs.columns.index("text"), least_score), docs.schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(training_rows(docs)))
