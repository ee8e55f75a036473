"""Personal data by candidate gradient boosting, in DataFrame operations only.

Base spans come from four fixed patterns. Beside them, high-recall generators propose overlapping candidate spans (numbers in
any grouping, runs of whole groups inside them, written-out or bracketed addresses, colon groups); each gets format features and features of the text around it, and
boosted trees, one ensemble for each kind, score it. The trees become nested conditional expressions over the features. A candidate
is selected if its score reaches the kind's threshold, calibrated on a held-out part of the training texts to be right in
PRECISION of the cases, and if it overlaps no base span; of selected candidates that overlap, the best scored one stays.

The trees are fitted on generated texts with known answers (`samples`), a fixed number whatever the corpus.

Offsets are code points, end exclusive. Null texts are empty. Base patterns are written so that they match what the plain
ones match (leftmost, not overlapping) but in linear time and without recursion, however long a run of characters is. Repeated rows
each give a row; extra columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: From the separator of a written-out address to its last label's first two characters.
_HOST = r"(?:\x20?[\[({]\x20?(?i:at|@)\x20?[\])}]\x20?|\x20@\x20?|@\x20|\x20(?i:at)\x20)[A-Za-z0-9-]{1,64}+(?:\x20?[\[({]\x20?(?i:dot|\.)\x20?[\])}]\x20?|\x20(?i:dot)\x20|\x20\.\x20|\.)[A-Za-z0-9-]{2}"
GENERATORS = {
    "mail": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+" + _HOST + r"[A-Za-z0-9-]{0,62}+",
    "number": r"(?<![0-9A-Za-z])[(]?[0-9](?:[\x20().\-/\[\]]{0,3}[0-9]){6,24}",
    "colon": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){3,7}(?![0-9A-Fa-f:])",
    "chain": r"(?<![0-9A-Za-z])[(]?[0-9]++(?:[\x20().\-/\[\]]{1,3}[0-9]++)*+",
}
#: Kinds that a generator's spans are proposed for. Of a chain, which has no longest length, the spans of whole groups in PARTS are.
PROPOSES = {"mail": ("email",), "number": ("ip", "card", "phone"), "colon": ("ip",), "chain": ("ip", "card", "phone")}
#: No card or phone number is longer.
MOST_DIGITS = {"card": 19, "phone": 15}
#: Most groups of a span inside a chain.
MOST_GROUPS = 6
#: Which groups i to j of a chain x (v: its groups; g: what stands before each and after the last; d: digits in all) each kind takes.
PARTS = {
    # Four with plain dots only are the base pattern's.
    "ip": "j = i + 3 AND " + " AND ".join([*(f"length(x.v[i + {n}]) <= 3" for n in range(4)), *(f"contains(x.g[i + {n}], '.')" for n in (1, 2, 3))]) + " AND concat(x.g[i + 1], x.g[i + 2], x.g[i + 3]) <> '...'",
    "card": "d BETWEEN 13 AND 19",
    "phone": "d BETWEEN 7 AND 15",
}
#: Holds in every text where a base pattern or a generator matches: these need a digit, an '@', _HOST, or letters between colons.
WORTH = r"[0-9@]|[A-Fa-f](?::[A-Fa-f]{1,4}){2}:[A-Fa-f]|" + _HOST
PRECISION = 0.98
#: Log odds of 9 to 1: held-out cases are of the generators' kinds only, so the trees must be sure as well.
LEAST = 2.2


def _count(chars: str) -> str:
    return f"(length(x.m) - length(translate(x.m, '{chars}', '')))"


def _context(words: str) -> str:
    # Not lower(): its first call in a process makes some GB of garbage over all code points, and the heap grows for good.
    return f"cast(x.b rlike r'(?i)(?:{words})[^0-9]{{0,12}}$' AS int)"


_GROUPS = r"filter(split(x.m, r'[^0-9A-Za-z]+'), v -> v <> '')"
_DIGITS = r"regexp_replace(x.m, r'[^0-9]', '')"


def _luhn(digits: str) -> str:
    each = "cast(substring(reverse(d.d), i, 1) AS int)"
    twice = f"CASE WHEN i % 2 = 0 THEN 2 * {each} - CASE WHEN {each} > 4 THEN 9 ELSE 0 END ELSE {each} END"
    return f"(transform(array(named_struct('d', {digits})), d -> length(d.d) > 1 AND aggregate(sequence(1, greatest(length(d.d), 1)), 0, (s, i) -> s + {twice}) % 10 = 0)[0])"


#: Features of a candidate x: its text m, what stands before (b) and after (a) it.
FEATURES = {
    "digits": f"length({_DIGITS})",
    "letters": "length(regexp_replace(x.m, r'[^A-Za-z]', ''))",
    "ats": _count("@"),
    "dots": _count("."),
    "dashes": _count("-"),
    "spaces": _count(" "),
    "slashes": _count("/"),
    "colons": _count(":"),
    "parens": _count("()"),
    "brackets": _count("[]{}"),
    "groups": f"size({_GROUPS})",
    "longest": f"coalesce(array_max(transform({_GROUPS}, v -> length(v))), 0)",
    "shortest": f"coalesce(array_min(transform({_GROUPS}, v -> length(v))), 0)",
    "luhn": f"cast({_luhn(_DIGITS)} AS int)",
    "octets": f"cast(size({_GROUPS}) = 4 AND forall({_GROUPS}, v -> v rlike '^[0-9]{{1,3}}$' AND cast(v AS int) <= 255) AS int)",
    "ending": r"cast(x.m rlike r'[^A-Za-z][A-Za-z]{2,6}$' AS int)",
    "written": r"cast(x.m rlike r'(?i)\bdot\b' AS int)",
    "near_mail": _context("e-?mail|contact|write|reach|correo|schreib"),
    "near_phone": _context("tel|telefon|phone|call|fax|mobile|cell|whatsapp|ruf"),
    "near_card": _context("card|visa|mastercard|amex|credit|debit|karte|tarjeta|carte"),
    "near_ip": _context(r"\bip|ipv6|host|server|addr"),
    "near_other": _context(r"order|invoice|number|no\.|nr|id|version|isbn|date|ref|on|since|[#=$v]"),
    "glued": "cast(x.b rlike '[A-Za-z0-9_=/:.-]$' OR x.a rlike '^[A-Za-z0-9_%/:-]' AS int)",
}


def _find(text: str, pattern: str, name: str, df: DataFrame) -> DataFrame:
    """Adds column `name`: all matches of the pattern with offsets and what stands before and after each."""
    t = F.col(text)
    out = df.withColumn("_g", F.split(t, pattern, -1)).withColumn("_m", F.regexp_extract_all(t, F.lit(pattern), F.lit(0)))
    found = """aggregate(
        transform(_m, (m, i) -> named_struct('m', m, 'g', _g[i], 'n', _g[i + 1])),
        named_struct('p', 0, 'o', cast(array() AS array<struct<m: string, s: int, e: int, b: string, a: string>>)),
        (y, x) -> named_struct('p', y.p + length(x.g) + length(x.m), 'o', concat(y.o, array(named_struct(
            'm', x.m, 's', y.p + length(x.g), 'e', y.p + length(x.g) + length(x.m), 'b', right(x.g, 24), 'a', left(x.n, 12))))),
        y -> y.o)"""
    return out.withColumn(name, F.expr(found)).drop("_g", "_m")


def _base_holds(kind: str) -> str:
    digits = "length(regexp_replace(x.m, '[^0-9]', ''))"
    return {
        "email": "true",
        "ip": r"x.m rlike r'^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}$'",
        "card": _luhn(_DIGITS),
        "phone": f"{digits} BETWEEN 10 AND 15",
    }[kind]


def base_spans(df: DataFrame, text: str) -> DataFrame:
    """Adds `base`: array of (kind number, start, end), by start, then kind."""
    for k, kind in enumerate(KINDS):
        df = _find(text, BASE[kind], f"_{kind}", df).withColumn(f"_{kind}", F.expr(f"transform(filter(_{kind}, x -> {_base_holds(kind)}), x -> named_struct('s', x.s, 'k', {k}, 'e', x.e))"))
    names = [f"_{kind}" for kind in KINDS]
    return df.withColumn("base", F.array_sort(F.concat(*names))).drop(*names)


def _parts(name: str) -> str:
    """The chains in column `name` as spans of whole groups, overlapping, with the kind numbers (k) that each is proposed for."""
    # A chain is cut after each 64 groups (n of them), each piece with the next groups behind it, as arrays grow by copying.
    cut = f"(?:[^0-9]*[0-9]++){{1,64}}+)(?=((?:[^0-9]*[0-9]++){{0,{MOST_GROUPS - 1}}})"
    pieces = f"""flatten(transform({name}, x -> aggregate(
        zip_with(regexp_extract_all(x.m, '({cut})', 1), regexp_extract_all(x.m, '({cut})', 2), (h, t) -> named_struct('h', h, 't', t)),
        named_struct('p', 0, 'o', cast(array() AS array<struct<m: string, n: int, s: int, b: string, a: string>>)),
        (y, w) -> named_struct('p', y.p + length(w.h), 'o', concat(y.o, array(named_struct('m', concat(w.h, w.t), 'n', size(regexp_extract_all(w.h, '[0-9]+', 0)), 's', x.s + y.p,
            'b', right(concat(x.b, substring(x.m, greatest(1, y.p - 23), least(y.p, 24))), 24), 'a', left(concat(substring(x.m, y.p + length(w.h) + length(w.t) + 1, 12), x.a), 12))))),
        y -> y.o)))"""
    # Groups with their ends (p) and the digits before each end (d); a group's start is its end less its length.
    groups = f"""transform({pieces}, x -> named_struct('m', x.m, 'n', x.n, 's', x.s, 'b', x.b, 'a', x.a, 'v', regexp_extract_all(x.m, '[0-9]+', 0), 'g', split(x.m, '[0-9]+', -1)))"""
    ends = f"""transform({groups}, x -> named_struct('m', x.m, 'n', x.n, 's', x.s, 'b', x.b, 'a', x.a, 'v', x.v, 'g', x.g, 'p', aggregate(
        transform(x.v, (w, i) -> named_struct('w', length(w), 'g', length(x.g[i]))),
        named_struct('p', 0, 'd', 0, 'o', cast(array() AS array<struct<p: int, d: int>>)),
        (y, w) -> named_struct('p', y.p + w.g + w.w, 'd', y.d + w.w, 'o', concat(y.o, array(named_struct('p', y.p + w.g + w.w, 'd', y.d + w.w)))),
        y -> y.o)))"""
    kinds = ", ".join(f"CASE WHEN {rule.replace('d BETWEEN', 'x.p[j].d - x.p[i].d + length(x.v[i]) BETWEEN')} THEN {KINDS.index(kind)} END" for kind, rule in PARTS.items())
    pairs = f"""flatten(transform(sequence(0, x.n - 1), i -> filter(transform(sequence(i, least(i + {MOST_GROUPS - 1}, size(x.v) - 1)), j -> named_struct(
        's', x.p[i].p - length(x.v[i]), 'e', x.p[j].p, 'o', right(x.g[i], 1) = '(', 'k', filter(array({kinds}), k -> k IS NOT NULL))), q -> size(q.k) > 0)))"""
    # A bracket before the first group belongs to a span that closes it; spans with other open ends are none.
    opened = f"transform({pairs}, q -> named_struct('s', q.s - cast(q.o AND substring(x.m, q.s + 1, q.e - q.s) rlike '^[^(]*[)]' AS int), 'e', q.e, 'k', q.k))"
    whole = f"filter({opened}, q -> NOT substring(x.m, q.s + 1, q.e - q.s) rlike '^[^(]*[)]|[(][^)]*$')"
    return f"""flatten(transform({ends}, x -> transform({whole}, q -> named_struct('m', substring(x.m, q.s + 1, q.e - q.s), 's', x.s + q.s, 'e', x.s + q.e, 'k', q.k,
        'b', right(concat(x.b, substring(x.m, greatest(1, q.s - 23), least(q.s, 24))), 24), 'a', left(concat(substring(x.m, q.e + 1, 12), x.a), 12)))))"""


def candidates(df: DataFrame, text: str) -> DataFrame:
    """Adds `candidates`: array of the proposed spans with their kind number and features."""
    names = []
    for name, pattern in GENERATORS.items():
        df = _find(text, pattern, f"_{name}", df)
        if name == "chain":
            df = df.withColumn(f"_{name}", F.expr(_parts(f"_{name}")))
        kinds = "x.k" if name == "chain" else f"array({', '.join(str(KINDS.index(k)) for k in PROPOSES[name])})"
        features = ", ".join(f"'{f}', {e}" for f, e in FEATURES.items())
        rows = f"transform(_{name}, x -> named_struct('ks', {kinds}, 's', x.s, 'e', x.e, {features}))"
        copies = f"flatten(transform(_{name}, x -> transform(x.ks, k -> named_struct('k', k, 's', x.s, 'e', x.e, {', '.join(f'{chr(39)}{f}{chr(39)}, x.{f}' for f in FEATURES)}))))"
        fits = f"filter(_{name}, x -> NOT coalesce(CASE x.k {' '.join(f'WHEN {KINDS.index(k)} THEN x.digits > {most}' for k, most in MOST_DIGITS.items())} END, false))"
        df = df.withColumn(f"_{name}", F.expr(rows)).withColumn(f"_{name}", F.expr(copies)).withColumn(f"_{name}", F.expr(fits))
        names.append(f"_{name}")
    return df.withColumn("candidates", F.concat(*names)).drop(*names)


# Training


def samples(n: int, seed: int) -> list[tuple[str, int, int]]:
    """(text, kind number, label): generated texts around one candidate each."""
    return [case[:3] for case in spanned_samples(n, seed)]


def spanned_samples(n: int, seed: int) -> list[tuple[str, int, int, int, int]]:
    """The samples with the start and end of the candidate that the label is for."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    w = lambda: "".join(r.choice("abcdefghijklmnoprstuvwz") for _ in range(r.randint(2, 9)))

    def luhn(k: int, valid: bool) -> str:
        body = r.choice("3456") + d(k - 2)
        total = sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(body)))
        return body + str((-total + (0 if valid else r.randint(1, 9))) % 10)

    def fours(s: str, sep: str) -> str:
        return sep.join(s[i : i + 4] for i in range(0, len(s), 4))

    octet = lambda: str(r.randint(1, 255))
    say = lambda *words: r.choice(words) + r.choice([" ", ": ", " is ", " at "])
    phone_words, card_words, ip_words = ("tel", "phone", "call", "fax", "mobile", "Telefon"), ("card", "visa", "credit card", "Karte"), ("ip", "host", "server", "IPv6 addr")
    other = ("order", "invoice", "id", "version", "isbn", "date", "ref", "since", w(), w(), w())
    tld = lambda: r.choice(["com", "org", "net", "de", "fr", "es", "io", "edu"])
    number = [
        lambda: (say(*other), f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}"),
        lambda: (say(*other), f"{r.randint(1, 28):02}/{r.randint(1, 12):02}/{r.randint(1900, 2030)}"),
        lambda: (say(*other), d(r.randint(7, 22))),
        lambda: (say(*other), f"978-{d(1)}-{d(3)}-{d(5)}-{d(1)}"),
        lambda: (say(*other), ".".join(d(r.randint(1, 3)) for _ in range(r.choice([3, 5, 6])) ) + d(4)),
        lambda: (say(*other), " ".join(str(r.randint(1900, 2030)) for _ in range(r.randint(2, 5)))),
        lambda: (say(*other), fours(luhn(16, False), r.choice([".", "/", " ", "-", ""]))),
        lambda: (say(*card_words, *other), fours(luhn(r.choice([15, 16]), False), r.choice([" ", "-", "", "."]))),
        lambda: (say(*other), f"{d(3)}-{d(3)}-{d(4)}"),
        lambda: (say(*other), f"{r.randint(256, 999)}.{r.randint(256, 999)}.{d(3)}.{d(3)}"),
        lambda: (say(*other), f"{d(1)}.{d(9)}"),
        lambda: (say(*other), f"{d(4)} / {d(4)} {d(2)}"),
    ]
    phone = [
        lambda: (say(*phone_words), f"({d(3)}) {d(3)}-{d(4)}"),
        lambda: (say(*phone_words), f"{d(3)}{(s := r.choice('-. '))}{d(3)}{s}{d(4)}"),
        lambda: (say(*phone_words), f"0{d(2)} {d(3)} {d(4)}"),
        lambda: (say(*phone_words), f"00{d(2)} {d(3)} {d(3)} {d(3)}"),
        lambda: (say(w(), w(), *phone_words), f"({d(3)}) {d(3)}-{d(4)}"),
        lambda: (say(*phone_words), "0" + d(r.randint(8, 10))),
    ]
    card = [
        lambda: (say(*card_words), fours(luhn(16, True), r.choice([".", "/", " / "]))),
        lambda: (say(w(), w(), *card_words), fours(luhn(16, True), r.choice([".", "/"]))),
        lambda: (say(*card_words), luhn(13, True)),
    ]
    ip = [lambda: (say(*ip_words, w(), w()), r.choice(["[.]", "(.)", " . ", ". "]).join(octet() for _ in range(4))), lambda: (say(*ip_words, w(), w()), r.choice(["[.]", "(.)"]).join(r.choice([d(1), octet()]) for _ in range(4)))]
    ip6 = [lambda: (say(*ip_words, w(), w()), ":".join(f"{r.randint(256, 65535):x}" for _ in range(8)))]
    colon = [
        lambda: (say(*other), ":".join(f"{r.randint(16, 255):02x}" for _ in range(6))),
        lambda: (say(*other), ":".join(f"{r.randint(0, 59):02}" for _ in range(4))),
        lambda: (say(*other), ":".join(d(r.randint(1, 2)) for _ in range(r.randint(4, 8)))),
    ]
    at, dot = (lambda: r.choice([" [at] ", "[at]", " (at) ", "(at)", " at ", " {at} ", " AT "])), (lambda: r.choice([" [dot] ", "[dot]", " (dot) ", " dot ", " DOT ", "(dot)"]))
    mail = [
        lambda: (say(w(), "mail", "contact", "write"), f"{w()}{r.choice(['', '.' + w(), d(2)])}{at()}{w()}{dot()}{tld()}"),
        lambda: (say(w(), "email"), f"{w()}{r.choice([' [at] ', '(at)', '[at]'])}{w()}.{tld()}"),
        lambda: (say("email", "mail", "contact"), f"{w()} @ {w()}.{tld()}"),
    ]
    mail_no = [
        lambda: (say(w()), f"{w()} at {w()}.{r.choice(['', ' '])}{w()}"),
        lambda: (say(w()), f"{w()} at {w()}.{w()}"),
        lambda: (say(w(), "contact"), f"{w()} at {w()}.{w()[:3]}"),
        lambda: (say(w()), f"{w()} at {d(2)}.{d(2)}"),
        lambda: (say(w()), f"{w()} @ {w()}.{w()}"),
    ]
    cases = []
    for k, yes, no in ((0, mail, mail_no), (1, ip, [*number, *phone, *card]), (1, ip6, colon), (2, card, [*number, *phone, *ip]), (3, phone, [*number, *number, *card, *ip])):
        for i in range(n):
            label = i % 2
            before, what = r.choice(yes if label else no)()
            glue = r.random() < 0.1 and not label
            lead = f"{w()} {w()} {before}{w() + '=' if glue else ''}"
            cases.append((f"{lead}{what}{r.choice([' ', '. ', ', ', ''])}{w() if glue else ''} {w()}.", k, label, len(lead), len(lead) + len(what)))
    return cases


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, rate: float = 0.3) -> list:
    """Logistic gradient boosting of trees with two levels: a list of (feature, cut, (feature, cut, low, high), (feature, cut, low, high))."""

    def stump(rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple:
        best = (-1.0, 0, 0.5, 0.0, 0.0)
        for f in range(x.shape[1]):
            v = x[rows, f]
            for cut in np.unique(v)[:-1]:
                low = v <= cut
                a, b = (g[low].sum(), h[low].sum()), (g[~low].sum(), h[~low].sum())
                worth = a[0] ** 2 / (a[1] + 1) + b[0] ** 2 / (b[1] + 1)
                if worth > best[0] + 1e-12:
                    best = (worth, f, float(cut) + 0.5, float(rate * a[0] / (a[1] + 1)), float(rate * b[0] / (b[1] + 1)))
        if best[0] < 0:
            value = float(rate * g.sum() / (h.sum() + 1))
            return (0.0, 0, 0.5, value, value)
        return best

    score, trees = np.zeros(len(y)), []
    every = np.arange(len(y))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        _, f, cut, _, _ = stump(every, g, h)
        sides = []
        for rows in (every[x[:, f] <= cut], every[x[:, f] > cut]):
            _, f2, cut2, low, high = stump(rows, g[rows], h[rows])
            sides.append((f2, cut2, low, high))
            score[rows] += np.where(x[rows, f2] <= cut2, low, high)
        trees.append((f, cut, *sides))
    return trees


def predict(trees: list, x: np.ndarray) -> np.ndarray:
    score = np.zeros(len(x))
    for f, cut, left, right in trees:
        for side, rows in ((left, x[:, f] <= cut), (right, x[:, f] > cut)):
            score += np.where(rows, np.where(x[:, side[0]] <= side[1], side[2], side[3]), 0)
    return score


def threshold(score: np.ndarray, y: np.ndarray) -> float:
    """The lowest score, LEAST at least, from which at least PRECISION of the cases are right; infinite if there is none."""
    order = np.argsort(-score, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.append(score[order][1:] != score[order][:-1], True)
    good = np.flatnonzero(last & (right >= PRECISION))
    return max(LEAST, float(score[order][good[-1]])) if len(good) else float("inf")


def texts_of(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """i, t: the samples' texts by number. From Arrow, as a list of rows would start Python workers on the executors."""
    return spark.createDataFrame(pa.table({"i": pa.array(range(len(rows)), pa.int32()), "t": pa.array([t for t, *_ in rows], pa.string())}))


def fit(spark: SparkSession, per_kind: int = 600, seed: int = 11) -> dict[int, tuple[list, float]]:
    """For each kind number its trees and threshold."""
    rows = spanned_samples(per_kind, seed)
    df = candidates(texts_of(spark, rows), "t")
    got = df.select("i", F.explode("candidates").alias("c")).select("i", "c.k", "c.s", "c.e", *[F.col(f"c.{f}").cast("double").alias(f) for f in FEATURES]).distinct().orderBy("i", "k", "s", "e", *FEATURES).toPandas()
    kind = np.array([k for _, k, *_ in rows])
    got = got[got["k"].to_numpy() == kind[got["i"]]]
    # A span beside or inside the true one is a wrong one.
    true = np.array([x[2:] for x in rows])[got["i"]]
    got["label"] = ((true[:, 0] == 1) & (true[:, 1] == got["s"]) & (true[:, 2] == got["e"])).astype(float)
    out = {}
    for k in range(len(KINDS)):
        own = got[got["k"] == k]
        x, y, held = own[list(FEATURES)].to_numpy(float), own["label"].to_numpy(), own["i"].to_numpy() // 2 % 3 == 0
        trees = boost(x[~held], y[~held])
        out[k] = (trees, threshold(predict(trees, x[held]), y[held]))
    return out


def score_sql(trees: list) -> str:
    names = list(FEATURES)
    leaf = lambda s: f"CASE WHEN c.{names[s[0]]} <= {s[1]}D THEN {s[2]!r}D ELSE {s[3]!r}D END"
    return " + ".join(f"CASE WHEN c.{names[f]} <= {cut}D THEN {leaf(a)} ELSE {leaf(b)} END" for f, cut, a, b in trees)


def redact_spans(docs: DataFrame, model: dict[int, tuple[list, float]]) -> DataFrame:
    """docs' doc_id with `base` and `spans`: arrays of (start, kind number, end)."""
    text = text_of(docs)
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(text.rlike(WORTH), text).otherwise("").alias("t"))
    df = candidates(base_spans(df, "t"), "t").drop("t")
    able = {k: m for k, m in model.items() if np.isfinite(m[1])}
    margin = "CASE c.k " + " ".join(f"WHEN {k} THEN {score_sql(trees)} - ({least!r}D)" for k, (trees, least) in sorted(able.items())) + " ELSE -1D END" if able else "-1D"
    free = "filter(candidates, c -> NOT exists(base, b -> b.s < c.e AND c.s < b.e))"
    df = df.withColumn("free", F.expr(free)).withColumn("free", F.expr(f"filter(transform(free, c -> named_struct('v', {margin}, 's', c.s, 'k', c.k, 'e', c.e)), c -> c.v >= 0)"))
    # By score, then the earliest, then the longest; each that overlaps none taken before it.
    order = "transform(array_sort(transform(free, c -> named_struct('v', -c.v, 's', c.s, 'l', -c.e, 'k', c.k))), c -> named_struct('s', c.s, 'k', c.k, 'e', -c.l))"
    best = f"aggregate({order}, cast(array() AS array<struct<s: int, k: int, e: int>>), (y, c) -> CASE WHEN exists(y, o -> o.s < c.e AND c.s < o.e) THEN y ELSE concat(y, array(c)) END)"
    return df.withColumn("spans", F.array_sort(F.concat("base", F.expr(best)))).select("doc_id", "base", "spans")


def _joined(spans: str) -> Column:
    names = "array('" + "', '".join(KINDS) + "')"
    return F.expr(f"array_join(transform({spans}, x -> concat({names}[x.k], ':', x.s, ':', x.e)), ',')")


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = redact_spans(table(spark, sf_dir, "documents"), fit(spark))
    counts = [F.expr(f"cast(size(filter(base, x -> x.k = {k})) AS bigint)").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
