"""Token counts by a map-side two-tier lookup.

Tier one is a hash table from frequent pre-tokens to their number of tokens, at most `table_size` entries, fitted on a
bounded sample of documents and broadcast. Tier two is a bounded cache in each Python worker: a pre-token that the table
lacks is encoded once by the library and remembered. Nothing is shuffled, and the result depends on neither tier: every
entry of both comes from the library.

Null text counts as empty. Special strings inside texts count as one token, the library's default. Extra columns, also
ones named like the result's, are ignored; rows with equal ids each give a row.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, worker_memo

#: The pre-token pattern of the word_bpe tokenizer, as in its file.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Code points on which the library's normalizer does no more than str.lower and white space handling.
PLAIN = regex.compile(r"[\t\n\r -~¡-įı-ɏ]*")
#: Longer texts are cut at white space, so that the list of pre-tokens stays small.
SEGMENT = 1 << 20
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class _Lengths(dict):
    """Pre-token to number of tokens: the broadcast table, and what was missing in it so far."""

    def __init__(self, table: dict, tokenizer, room: int):
        super().__init__(table)
        self.table, self.tokenizer, self.most = table, tokenizer, len(table) + room

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.most:
            self.clear()
            self.update(self.table)
        n = self[piece] = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        return n


class Counts:
    """Counts the tokens of a text as the tokenizer of the given definition does."""

    def __init__(self, definition: str, table: dict, room: int = 1 << 18):
        from tokenizers import Tokenizer

        spec = json.loads(definition)
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.lengths = _Lengths(table, self.tokenizer, room)
        added = spec.get("added_tokens") or []
        self.added = regex.compile("|".join(regex.escape(x["content"]) for x in added)) if added else None
        self.known = splits_known(spec)
        self.pieces = regex.compile(PIECES)

    def __call__(self, text: str) -> int:
        if not self.known:
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if self.added is None or "<|" not in text:
            return self.plain(text)
        parts = self.added.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))

    def plain(self, text: str) -> int:
        if len(text) > SEGMENT:
            return sum(map(self.segment, segments(text)))
        return self.segment(text)

    def segment(self, text: str) -> int:
        if PLAIN.fullmatch(text):
            return sum(map(self.lengths.__getitem__, self.pieces.findall(text.lower())))
        # Pre-tokens do not span white space, so the chunks between can be counted alone.
        return sum(map(self.lengths.__getitem__, regex.findall(r"[^ \t\n\r]+", text)))


def segments(text: str) -> Iterator[str]:
    """The text in pieces of about SEGMENT characters that end at white space."""
    at = 0
    while at < len(text):
        end = regex.compile(r"[ \t\n\r]").search(text, at + SEGMENT)
        yield text[at : (at := end.end() if end else len(text))]


def splits_known(spec: dict) -> bool:
    """Whether a tokenizer's file asks for the normalisation and the pre-tokens that Counts knows."""
    try:
        steps, first = spec["normalizer"]["normalizers"], spec["pre_tokenizer"]["pretokenizers"][0]
        plain = all(not (x["normalized"] or x["single_word"] or x["lstrip"] or x["rstrip"]) and x["content"].startswith("<|") and " " not in x["content"] for x in spec["added_tokens"])
        return plain and [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and first["pattern"]["Regex"] == PIECES and first["invert"] and spec["model"]["dropout"] is None
    except (KeyError, TypeError, IndexError):
        return False


def frequent_lengths(docs: DataFrame, definition: str, sample_docs: int, table_size: int) -> dict:
    """The most frequent pre-tokens of about sample_docs documents, with their numbers of tokens. A cache only: results do not depend on it."""
    counts = Counts(definition, {}, 0)
    if not counts.known or not (n := docs.count()):
        return {}
    seen: Counter = Counter()
    for row in docs.where("text is not null and length(text) <= 100000").select("text").sample(min(1.0, sample_docs / n), 42).limit(2 * sample_docs).toLocalIterator():
        if PLAIN.fullmatch(row.text):
            seen.update(counts.pieces.findall(row.text.lower()))
    pieces = [x for x, _ in seen.most_common(table_size)]
    return {p: len(e.ids) for p, e in zip(pieces, counts.tokenizer.encode_batch(pieces, add_special_tokens=False), strict=True)}


def count_tokens(docs: DataFrame, definition: str, limit: int = 2048, sample_docs: int = 1000, table_size: int = 1 << 15, cache_size: int = 1 << 18) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((definition, frequent_lengths(docs, definition, sample_docs, table_size)))
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(counter(shared, limit, cache_size), SCHEMA)


def counter(shared, limit: int, cache_size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = worker_memo()
        if memo.get("tokens of") != shared.value[0]:
            memo["tokens of"], memo["tokens"] = shared.value[0], Counts(*shared.value, cache_size)
        count = memo["tokens"]
        for batch in batches:
            sizes, tokens = [], []
            for x in batch.column(1):
                text = x.as_py() or ""
                sizes.append(len(text) if text.isascii() else len(text.encode()))
                tokens.append(count(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return count_tokens(table(spark, sf_dir, "documents"), f.read())
