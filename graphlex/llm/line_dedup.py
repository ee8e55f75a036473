"""Line deduplication by an exact set-similarity join.

All of it is DataFrame operations (the README has the figures).

A line is the set of its words. Equal lines are first reduced to one row each. Words are ordered by rarity; two lines with
Jaccard similarity of at least num/den then share a word among the rarest n - ceil(n * num/den) + 1 of each (prefix filter).
Lines that share such a word stay candidates of each other if their sizes (length filter), the words that may still follow
(positional filter) and the parity bitmaps of their words (their symmetric difference has at least as many words as the bitmaps
differ in bits) allow the similarity. A bitmap has 64 bits, 128 for lines of 88 words and 256 for lines of 192, as many words fill
a small one; in lines of some 300 words it excludes little, and verification decides. A first semi join keeps the prefix words by
which a line has any candidate; it yields each line and word once. Each such line is then compared with the earliest line of every
such word, which settles groups of copies without their pairs; only lines that are still unsettled are paired with all earlier
candidates. Pairs are verified by their exact Jaccard similarity.

Result: a line goes if an earlier line is equal or similar, whether or not that one stays itself. Earlier: by id (null first), then
by a hash of the text, then by line number. Lines without a word and lines with fewer than `min_words` different words stay.
Null texts stay null and empty ones empty; a text of any length is read whole. Rows equal in id and text are one document and each
give the same row. An empty table gives an empty one. Words stand as 64-bit hashes (in the order by rarity as 7 bits of frequency
and 57 of another hash), lines as 128-bit hashes. Extra columns are kept, whatever their names, but for those that the result gives
its own two columns.

What a phase finds is written to the shared checkpoint folder, so a lost executor costs no earlier phase, and the shuffle files
of a finished phase are removed.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import aside, back, settings, stored, table

#: White space of words beside \n, for trim().
TRIM = r"' \t\n\r\u000B\u000C'"
#: Cells of word frequencies, as a power of two.
SKETCH_BITS = 18
#: Bits of a key that are of the word's hash; the 7 above are of its frequency.
HASH_BITS = 57
#: Bits of the map-side filter before lines are moved, as a power of two.
FILTER_BITS = 23
#: Bytes that are hashed at once, and the longest word that is hashed with others.
PIECE, LONG = 1 << 16, 64
#: A line with blanks for its white space.
BLANKS = r"CASE WHEN {} THEN translate(line, '\t\r\u000B\u000C', '    ') ELSE line END".format(" OR ".join(f"contains(line, {c})" for c in (r"'\t'", r"'\r'", r"'\u000B'", r"'\u000C'")))


def _parity(bit: str, least: int) -> str:
    """A bitmap of 64 bits, of which each word with the bit set flips one; null for lines of fewer words than `least`."""
    return f"CASE WHEN n >= {least} THEN aggregate(s, 0L, (a, x) -> a ^ shiftleft({bit}, cast(x & 63 AS int))) END"


#: Bitmaps of all words, of those with bit 6 or bit 7 of their key set, and of those with both.
SIGS = {
    "sig": _parity("1L", 0),
    "sig6": _parity("shiftrightunsigned(x, 6) & 1L", 88),
    "sig7": _parity("shiftrightunsigned(x, 7) & 1L", 192),
    "sig67": _parity("shiftrightunsigned(x, 6) & shiftrightunsigned(x, 7) & 1L", 192),
}
#: Seed of the hashes of words.
SEED = 42
POSITION = ("d", "text_hash", "line_no")
AT_FIRST = " AND ".join(f"{c} = first_{c}" for c in POSITION)


def _id() -> Column:
    """doc_id, null as the smallest long."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))


def _lines(docs: DataFrame) -> DataFrame:
    """d, text_hash, line_no, line, k, k2 of each line."""
    hashed = docs.select(_id().alias("d"), F.xxhash64("text").alias("text_hash"), F.split("text", "\n", -1).alias("x"))  # once a text, not once a line
    lines = hashed.select("d", "text_hash", F.posexplode("x").alias("line_no", "line"))
    return lines.withColumn("k", F.xxhash64("line")).withColumn("k2", F.xxhash64(F.lit(1), "line"))


class Words:
    """Words of UTF-8 bytes and their 64-bit hashes, without a Python object for each. The query, which is native, does not use it.

    A word's hash is the sum of its bytes' random values, each times a power of an odd number that its place gives, mixed. Powers
    are taken from the start of a piece of text, so that a running sum serves all words in it, and divided out again. Words of
    more than LONG bytes, whose places could cancel out by design, have XXH64 hashes instead.
    """

    def __init__(self):
        odd = 0x9E3779B97F4A7C15
        self.white = np.zeros(256, bool)
        self.white[[0x20, *range(0x09, 0x0E)]] = True
        self.value = np.array([xxhash.xxh64_intdigest(bytes([b]), SEED) for b in range(256)], np.uint64)
        self.power, self.inverse = (np.cumprod(np.array([1] + [x] * (PIECE - 1), np.uint64)) for x in (odd, pow(odd, -1, 1 << 64)))

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where the words start, and their hashes."""
        data = np.frombuffer(text, np.uint8)
        edges = np.flatnonzero(np.diff(self.white[data], prepend=True, append=True))
        start, end = edges[::2], edges[1::2]
        out = np.empty(len(start), np.uint64)
        i = 0
        while i < len(start):
            base = start[i]
            j = int(np.searchsorted(start, base + PIECE - LONG))
            piece = data[base : min(end[j - 1], base + PIECE)]
            sums = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(self.value[piece] * self.power[: len(piece)], out=sums[1:])
            first = start[i:j] - base
            out[i:j] = (sums[np.minimum(end[i:j] - base, len(piece))] - sums[first]) * self.inverse[first]
            i = j
        for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xC2B2AE3D27D4EB4F), (32, 1)):
            out = (out ^ (out >> np.uint64(shift))) * np.uint64(factor)
        for w in np.flatnonzero(end - start > LONG):
            out[w] = xxhash.xxh64_intdigest(text[start[w] : end[w]], SEED)
        return start, out


def _sketch(docs: DataFrame) -> DataFrame:
    """One row, one array: what turns the upper 7 bits of a word's hash into those of its key, by exclusive or, for each of 2 ^ SKETCH_BITS hash cells.

    Those of the key are 3 * log2 of how often the cell's words occur in all texts, so that they order counts up to 2 ^ 42; those of
    the hash are the cell's own, so that one operation a word gives its key.
    """
    words = docs.select(F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("w"))
    cells = words.groupBy(F.expr(f"shiftrightunsigned(xxhash64(w), {64 - SKETCH_BITS})").alias("cell")).agg(F.count("*").alias("n"))
    every = docs.sparkSession.range(1 << SKETCH_BITS).select(F.col("id").alias("cell"), F.lit(0).cast("long").alias("n"))
    dense = cells.union(every).groupBy("cell").agg(F.sum("n").alias("n"))
    level = f"shiftleft(cast(least(3 * log2(x.n + 1), 127) AS bigint) - 64, {HASH_BITS})"  # 64 less, so that signed order is their order
    own = f"shiftleft(shiftright(x.cell, {SKETCH_BITS + HASH_BITS - 64}), {HASH_BITS})"
    return dense.agg(F.expr(f"transform(sort_array(collect_list(struct(cell, n))), x -> {level} ^ {own})").alias("sketch"))


def _hashes() -> Column:
    """The different words of a line, as hashes."""
    return F.array_remove(F.array_distinct(F.transform(F.split(F.expr(BLANKS), " "), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def _with_prefix(lines: DataFrame, sketch: DataFrame, num: int, den: int, min_words: int) -> DataFrame:
    """Adds n (the number of the line's words), its bitmaps and prefix (its rarest words' keys, rarest first; none if n < min_words) in place of line."""
    key = f"coalesce(get(sketch, cast(shiftrightunsigned(h, {64 - SKETCH_BITS}) AS int)), 0L) ^ h"  # never null, so that plain longs are sorted
    hashes = f"array_remove(array_distinct(transform(split({BLANKS}, ' '), w -> xxhash64(w))), xxhash64(''))"
    words = F.expr(f"sort_array(transform({hashes}, h -> {key}))")
    keyed = lines.withColumn("sketch", sketch.scalar()).withColumn("s", words).withColumn("n", F.size("s"))  # the sketch is named once: a column named twice would be copied into each row
    p = F.expr(f"CASE WHEN n < {min_words} THEN 0 ELSE n - (({num} * n + {den - 1}) div {den}) + 1 END")
    return keyed.withColumns({name: F.expr(sql) for name, sql in SIGS.items()}).withColumn("prefix", F.slice("s", F.lit(1), p.cast("int"))).drop("line", "s", "sketch")


def _need(num: int, den: int) -> str:
    """Common words that make the similarity of aliases a and b."""
    return f"(({num} * (a.n + b.n) + {num + den - 1}) div {num + den})"


def _may(num: int, den: int) -> str:
    """Length, positional and bitmap filters on aliases a and b, which share the words i of their prefixes.

    The first common word of a similar pair has `need` words or more from its place on in both lines.
    """
    need = _need(num, den)
    sig, six, seven, both = (f"(a.{x} ^ b.{x})" for x in SIGS)
    two = f"bit_count({six}) + bit_count({sig} ^ {six})"
    four = f"bit_count({both}) + bit_count({six} ^ {both}) + bit_count({seven} ^ {both}) + bit_count({sig} ^ {six} ^ {seven} ^ {both})"
    return f"""a.k <> b.k AND b.n * {den} >= a.n * {num} AND a.n * {den} >= b.n * {num}
        AND a.n - a.i >= {need} AND b.n - b.i >= {need}
        AND least(a.i, b.i) + least(a.n - a.i, b.n - b.i) >= {need}
        AND coalesce({four}, {two}, bit_count({sig})) <= a.n + b.n - 2 * {need}"""


def _maybe(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose k is among the keys, and a few more: a map-side filter of fixed size; what it lets through is joined exactly later."""
    low = FILTER_BITS - 6
    cells = keys.groupBy(F.expr(f"k & {(1 << low) - 1}").alias("cell")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(k, {low}) & 63 AS int))")).alias("bits"))
    every = rows.sparkSession.range(1 << low).select(F.col("id").alias("cell"), F.lit(0).cast("long").alias("bits"))
    dense = cells.union(every).groupBy("cell").agg(F.bit_or("bits").alias("bits"))
    known = stored(dense.agg(F.expr("transform(sort_array(collect_list(struct(cell, bits))), x -> x.bits)").alias("known")))
    word = F.get(known.scalar(), F.expr(f"cast(k & {(1 << low) - 1} AS int)"))
    return rows.where(F.getbit(word, F.expr(f"cast(shiftrightunsigned(k, {low}) & 63 AS int)")) == 1)


def _verified(pairs: DataFrame, words: DataFrame, num: int, den: int) -> DataFrame:
    """Of different pairs (k, other) the distinct k that are similar to their other."""
    a, b = words.select("k", F.col("h").alias("s")), words.select(F.col("k").alias("other"), F.col("h").alias("t"))
    same = f"size(array_intersect(s, t)) * {num + den} >= {num} * (size(s) + size(t))"
    return pairs.join(a, "k").join(b, "other").where(same).select("k").distinct()


def verdicts(docs: DataFrame, num: int = 4, den: int = 5, min_words: int = 2) -> DataFrame:
    """For each different line: k, k2, its first position, how often it occurs, and whether an earlier line is similar."""
    with settings(docs.sparkSession, {"spark.sql.codegen.aggregate.fastHashMap.capacityBit": str(SKETCH_BITS + 1)}):  # the aggregate's fast map holds all cells
        sketch = stored(_sketch(docs))
    some = _lines(docs).where(F.expr(f"btrim(line, {TRIM}) <> ''"))
    first = F.min(F.struct(*POSITION, "k2", "line")).alias("f")
    lines = some.groupBy("k").agg(first, F.count("*").alias("times")).select("k", "f.*", "times")  # words of equal lines are hashed and sorted once
    every = stored(_with_prefix(lines, sketch, num, den, min_words))
    prefixes = every.select("k", "n", *SIGS, F.posexplode("prefix").alias("i", "word"))
    hits = stored(prefixes.alias("a").join(prefixes.alias("b"), F.expr(f"a.word = b.word AND {_may(num, den)}"), "left_semi"))
    place = F.struct(*POSITION).alias("at")
    placed = stored(hits.join(every.select("k", place), "k"))
    near = placed.groupBy("k").agg(F.min("at").alias("at"))
    texts = _maybe(_lines(docs), placed).withColumn("own", place).join(near, "k").where("own = at")
    words = stored(texts.dropDuplicates(["k"]).select("k", _hashes().alias("h")))
    may = f"b.at < a.at AND {_may(num, den)}"
    line = F.struct("at", "k", "n", *SIGS, "i")
    least = placed.groupBy("word").agg(F.min(line).alias("b"))
    leaders = stored(placed.select("word", line.alias("a")).join(least, "word").where(may).select("a.k", F.col("b.k").alias("other")).distinct())
    settled = stored(_verified(leaders, words, num, den))
    rest = placed.join(settled, "k", "left_anti").select("word", line.alias("a")).join(placed.select("word", line.alias("b")), "word")
    pairs = stored(rest.where(may).select("a.k", F.col("b.k").alias("other")).distinct())
    late = stored(_verified(pairs.join(leaders, ["k", "other"], "left_anti"), words, num, den))
    similar = settled.unionByName(late).withColumn("similar", F.lit(True))
    return every.select("k", "k2", *POSITION, "times").join(similar, "k", "left").withColumn("similar", F.col("similar").isNotNull())


def dedup_lines(docs: DataFrame, num: int = 4, den: int = 5, min_words: int = 2, names: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """docs with its columns, text without the lines that go, and two columns `names` (in place of ones of these names): the text's lines, and how many went."""
    thin = docs.select("doc_id", "text")
    found = stored(verdicts(thin, num, den, min_words).where("similar OR times > 1"))
    seen = found.select("k", F.col("k2").alias("own"), *[F.col(c).alias(f"first_{c}") for c in POSITION], "similar")
    lines = _maybe(_lines(thin).drop("line"), seen).join(seen, "k")
    gone = lines.where((F.col("k2") == F.col("own")) & (F.col("similar") | ~F.expr(AT_FIRST)))
    lists = gone.groupBy("d", "text_hash").agg(F.collect_set("line_no").alias("gone"))
    here = aside(docs, "doc_id", "text").withColumn("d", _id()).withColumn("text_hash", F.xxhash64("text"))
    both = here.join(lists, ["d", "text_hash"], "left")
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.expr("array_join(filter(split(text, '\\n', -1), (x, i) -> NOT array_contains(gone, i)), '\\n')"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1)))
    counts = [n_lines.cast("long").alias(names[0]), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias(names[1])]
    return both.select(*[kept.alias(c) if c == "text" else back(c, "doc_id") for c in docs.columns if c not in names], *counts)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Near or equal earlier lines by brute force over all pairs of lines that share a word.
ORACLE = r"""
WITH l AS (
  SELECT doc_id, i - 1 AS line_no, x[i] AS line, len(x) AS n_lines
  FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents), unnest(range(1, len(x) + 1)) AS t(i)
), w AS (
  SELECT doc_id, line_no, line, list_distinct(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda v: v <> '')) AS s FROM l
), d AS (
  SELECT line, any_value(s) AS s, len(any_value(s)) AS n, min((doc_id, line_no)) AS f FROM w WHERE len(s) > 0 GROUP BY line
), e AS (
  SELECT line, n, f, unnest(s) AS v FROM d WHERE n >= 2
), p AS (
  SELECT a.line FROM e a JOIN e b ON a.v = b.v AND b.f < a.f AND b.n * 5 >= a.n * 4 AND a.n * 5 >= b.n * 4
  GROUP BY a.line, b.line, a.n, b.n HAVING count(*) * 9 >= 4 * (a.n + b.n)
), g AS (
  SELECT l.doc_id, l.line_no FROM l JOIN d USING (line) WHERE (l.doc_id, l.line_no) <> d.f OR l.line IN (SELECT line FROM p)
)
SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.line_no) FILTER (g.line_no IS NULL) AS kept, any_value(l.n_lines) AS n_lines, count(g.line_no) AS n_removed
FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.line_no = g.line_no GROUP BY l.doc_id
"""
ORACLE_SQL = f"SELECT doc_id, coalesce(kept, '') AS text, n_lines, n_removed FROM ({ORACLE})"
