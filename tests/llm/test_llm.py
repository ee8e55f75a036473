"""Every operator against brute force on small tables, and the shared edge cases: nulls, empty and long texts, ties, repeated rows, empty
tables, extra columns with clashing names."""

from __future__ import annotations

import hashlib
import math
import re
from itertools import combinations
from zlib import crc32

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from graphlex.llm import chat, components, decontamination, language_id, line_dedup, packing, personal_data, quality, queries, sharding, simhash, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, k string, part int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    r = np.random.default_rng(seed)
    return " ".join(r.choice(WORDS, n).tolist())


ODD = [
    (1, None, "en", "a", None, "x", "x", 1),
    (2, "", "en", "a", 0, "x", "x", 1),
    (3, "   \n\t \n", "en", None, 3, "x", "x", 1),
    (4, prose(4, 30), "en", "b", 9, "x", "x", 1),
    (5, prose(4, 30), None, "b", 9, "x", "x", 1),
    (5, prose(4, 30), None, "b", 9, "x", "x", 1),
    (None, prose(7, 12), "en", "b", 9, "x", "x", 1),
    (8, ("word " * 3 + "\n") * 20000, "en", "a", 9, "x", "x", 1),
    (9, "x" * 200_000, "en", "a", 9, "x", "x", 1),
    (10, "1234 5678 é 漢字 \u0000 😀 <|endoftext|>", "en", "c", 9, "x", "x", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


# 1 Decontamination


def slow_leak(text, item, min_words=13) -> bool:
    a, b = decontamination.tokens(text), decontamination.tokens(item)
    need = min(min_words, len(b))
    if len(b) < 5:
        return False
    for d in range(-len(b) + 1, len(a)):
        same = [a[k + d] == b[k] if 0 <= k + d < len(a) else None for k in range(len(b))]
        for s in range(len(b)):
            for e in range(s + need, len(b) + 1):
                part = same[s:e]
                if None not in part and sum(part) >= 0.8 * len(part):
                    return True
    return False


def test_decontamination_finds_substituted_passages(spark):
    item = prose(1, 30).split()
    changed = [("other" if k % 6 == 5 else w) for k, w in enumerate(item)]
    rows = [(1, "lead in " + " ".join(item).upper() + ". tail"), (2, " ".join(changed)), (3, prose(99, 200)), (4, " ".join(item[:12])), (5, " ".join(item[3:20])), (6, None), (7, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame([(7, " ".join(item)), (8, "too short"), (9, None), (None, prose(3, 20)), (10, "six words stand in this item")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.find_leaks(d, b).collect()}
    assert {k for k in got if k[1] == 7} == {(i, 7) for i, t in rows if t and slow_leak(t, " ".join(item))} == {(1, 7), (2, 7), (5, 7)}
    assert got[1, 7].n_overlap == 30 and got[1, 7].start == 2 and got[2, 7].n_equal == 25
    assert sorted(r.doc_id for r in decontamination.drop_leaks(d, b).collect()) == [3, 4, 6, 7]
    blocks = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(d, b, block_tokens=8).collect()}
    assert blocks == set(got)


def test_decontamination_edges(odd, empty, spark):
    b = spark.createDataFrame([(1, prose(4, 30))], "item_id long, text string")
    assert sorted(r.doc_id for r in decontamination.find_leaks(odd, b).collect()) == [4, 5, 5]
    assert decontamination.drop_leaks(odd, b).columns == odd.columns
    assert decontamination.find_leaks(empty, b).count() == 0
    assert decontamination.find_leaks(odd, b.limit(0)).count() == 0
    assert decontamination.drop_leaks(odd, b.limit(0)).count() == len(ODD)


def found_leak(text: str, item: str) -> bool:
    return bool(decontamination.Block([(1, decontamination.tokens(item))], 13, 5).search(text))


def substituted(pattern: str) -> tuple[str, str]:
    """A text and an item of distinct words that agree where the pattern has E."""
    item = [f"w{k}" for k in range(len(pattern))]
    return " ".join(w if c == "E" else "x" + w for w, c in zip(item, pattern, strict=True)), " ".join(item)


def test_decontamination_looks_at_every_hit_of_a_diagonal():
    assert slow_leak(*substituted("EMEEMEEEEEMEEMEEE")) and found_leak(*substituted("EMEEMEEEEEMEEMEEE"))
    r = np.random.default_rng(7)
    for _ in range(3000):
        pattern = "".join("E" if x else "M" for x in r.random(r.integers(15, 30)) < 0.75)
        hit = any(all(pattern[s + o] == "E" for o in mask) for mask in decontamination.MASKS for s in range(len(pattern) - mask[-1]))
        pair = substituted(pattern)
        assert found_leak(*pair) == (hit and slow_leak(*pair)), pattern


def test_decontamination_of_short_items_holds_to_the_share():
    for n in range(5, 14):
        for k in range(4):
            for places in combinations(range(n), k):
                text, item = substituted("".join("M" if p in places else "E" for p in range(n)))
                assert found_leak(f"some {text} more", item) == (5 * (n - k) >= 4 * n), (n, places)


def test_decontamination_recall_by_length_and_substitutions():
    r = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(400)]
    recall = {}
    for n, most in ((6, 1), (8, 1), (10, 2), (12, 2), (13, 2), (15, 3), (20, 4), (30, 6)):
        hits = 0
        for k in range(100):
            item = r.choice(vocabulary, n).tolist()
            own = list(item)
            for at in r.choice(n, most, replace=False):
                own[at] = "changed"
            text = " ".join([*r.choice(vocabulary, 20).tolist(), *own, *r.choice(vocabulary, 20).tolist()])
            hits += bool(decontamination.Block([(k, [w.encode() for w in item])], 13, 5).search(text))
        recall[n, most] = hits / 100
    assert recall.pop((6, 1)) >= 0.9 and min(recall.values()) >= 0.95, recall


def test_decontamination_of_repetitive_texts_is_linear():
    item = [b"same"] * 250
    block = decontamination.Block([(1, item)], 13, 5)
    text = "same " * 100_000
    assert block.search(text) == [(1, 250, 250, 0, 0)] and block.search(text, one=True)
    assert len(block.hashes) < 5 * 250
    half = decontamination.Block([(2, [b"a", b"b"] * 30)], 13, 5)
    assert half.search("b a " * 5_000)[0][:3] == (2, 60, 60)


def test_longest_similar_is_the_longest():
    r = np.random.default_rng(5)
    for _ in range(200):
        equal = r.random(r.integers(1, 14)) < 0.7
        at = int(r.integers(len(equal)))
        s, e = decontamination.longest_similar(equal, at)
        best = max((b - a for a in range(at + 1) for b in range(at + 1, len(equal) + 1) if equal[a:b].sum() * 5 >= 4 * (b - a)), default=0)
        assert e - s == best and (best == 0 or (s <= at < e and equal[s:e].sum() * 5 >= 4 * best))


# 2 Packing


def slow_pack(items, capacity):
    bins, out = [], []
    for size, source, cluster in items:
        fit = [(b["room"], k) for k, b in enumerate(bins) if b["room"] >= size and (source is None or source not in b["s"]) and (cluster is None or cluster not in b["c"])]
        if fit:
            _, k = min(fit)
        else:
            k = len(bins)
            bins.append({"room": capacity, "s": set(), "c": set()})
        out.append((k, capacity - bins[k]["room"]))
        bins[k]["room"] -= size
        bins[k]["s"].add(source)
        bins[k]["c"].add(cluster)
    return out


def test_best_fit_is_the_tightest_compatible_bin():
    r = np.random.default_rng(2)
    for _ in range(20):
        items = sorted(((int(r.integers(1, 100)), int(r.integers(6)) if r.random() < 0.8 else None, int(r.integers(40)) if r.random() < 0.8 else None) for _ in range(120)), key=lambda x: -x[0])
        assert packing.pack(items, 100) == slow_pack(items, 100)


def test_packing_is_whole_and_without_conflicts(docs, odd, empty):
    for table in (docs, odd):
        rows = packing.best_fit(table, 512, rows_per_part=64).toPandas()
        n = table.select(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 1).alias("n")).first().n
        assert rows.length.sum() == n and rows.groupby("bin").length.sum().max() <= 512
        for _, own in rows.groupby("bin"):
            spans = sorted(zip(own.offset, own.offset + own.length, strict=True))
            assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    rows = packing.best_fit(docs, 512, rows_per_part=64).toPandas().merge(docs.select("doc_id", "source", F.xxhash64("text").alias("c")).toPandas(), on="doc_id")
    part = rows[rows.length < 512]
    assert not part.duplicated(["bin", "source"]).any() and not part.duplicated(["bin", "c"]).any()
    assert packing.best_fit(empty).count() == 0


# 3 Language


def test_language_held_out_accuracy(docs):
    f = language_id.fit(language_id.training_rows(docs))
    got = language_id.identify(docs, f).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.held_out == [crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() >= 0.97 and got.score.between(0, 1).all()


def test_language_filters_hold_what_they_learned_and_correct_false_positives():
    r = np.random.default_rng(1)
    own = {x: r.integers(0, 1 << 62, 3000, dtype=np.uint64) for x in ("a", "b", "c")}
    f = language_id.Filters(own)
    for k, x in enumerate(f.names):
        assert ((f.masks(own[x])[:, 0] >> k) & 1).all()
    other = r.integers(0, 1 << 62, 200_000, dtype=np.uint64)
    assert np.allclose(f.popcounts(f.masks(other)) / len(other), f.false_positives, atol=2e-3)
    many = language_id.Filters({f"l{k:02d}": own["a"][k * 10 : k * 10 + 10] for k in range(20)})
    assert many.slots.shape[1] == 3 and many.popcounts(many.masks(own["a"][130:140]))[13] == 10


def test_language_edges(odd, empty):
    f = language_id.fit(language_id.training_rows(odd))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(odd, f).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == "en" and len(got) == 9
    none = language_id.fit(language_id.training_rows(empty))
    assert {r.lang_pred for r in language_id.identify(odd, none).collect()} == {"und"}
    assert language_id.identify(empty, f).count() == 0
    assert language_id.keep_known(odd, f, 0.3).columns == odd.columns


# 4 Personal data

PLAIN = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def luhn(digits: str) -> bool:
    return sum((d := int(c) * (1 + i % 2)) - 9 * (d > 9) for i, c in enumerate(reversed(digits))) % 10 == 0


def slow_base(text: str) -> list[tuple]:
    out = []
    for k, (kind, pattern) in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": lambda: True, "ip": lambda m=m: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda d=digits: 14 <= len(d) <= 19 and luhn(d), "phone": lambda d=digits: 10 <= len(d) <= 15}[kind]
            if good():
                out.append((m.start(), k, m.end()))
    return sorted(out)


@pytest.fixture(scope="module")
def model(spark):
    return personal_data.fit(spark)


def test_personal_data_base_is_that_of_the_plain_patterns(spark, model):
    r = np.random.default_rng(3)
    bits = ["@", ".", "a", "b-", "1", "22", "255", "256", "+", " ", "-", "(", ")", "4111 1111 1111 1111", "4111-1111-1111-1112", "é", "\n", "x@y.z", "1.2.3.4", "+1 415 555 0100", "_", "%"]
    rows = [(i, "".join(r.choice(bits, r.integers(1, 25)).tolist())) for i in range(600)]
    got = {x.doc_id: x for x in personal_data.redact_spans(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for i, text in rows:
        assert [(s.s, s.k, s.e) for s in got[i].base] == slow_base(text), text
        assert {tuple(s) for s in got[i].base} <= {tuple(s) for s in got[i].spans}


def test_personal_data_adds_what_the_trees_select(spark, model):
    texts = ["call me tel: (415) 555-0199 now", "write to john.doe [at] example [dot] com please", "card: 4539.1488.0343.6467 ok", "on 2021-03-04 order 123-456-7890", "server 192[.]168[.]1[.]5 is", prose(1, 50)]
    rows = personal_data.redact_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [[(personal_data.KINDS[s.k], texts[r.doc_id][s.s : s.e]) for s in r.spans] for r in rows] == [[("phone", "(415) 555-0199")], [("email", "john.doe [at] example [dot] com")], [("card", "4539.1488.0343.6467")], [], [("ip", "192[.]168[.]1[.]5")], []]


def test_personal_data_prefilter_lets_every_candidate_through(spark, model):
    texts = ["contact john at example [dot] com", "mail: john at example(dot)com", "contact john at example[dot]org", "write john at example.com now", "john aT example dOt com", "host ab:cd:ef:fa:de here"]
    texts += [t for t, k, y in personal_data.samples(60, 5) if k == 0]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, t string")
    assert personal_data.candidates(df, "t").where((F.size("candidates") > 0) & ~F.col("t").rlike(personal_data.WORTH)).count() == 0
    found = {r.doc_id: r.spans for r in personal_data.redact_spans(df.withColumnRenamed("t", "text"), model).collect()}
    assert [texts[0][x.s : x.e] for x in found[0]] == ["john at example [dot] com"]


def test_personal_data_proposes_neighbours_alone(spark, model):
    cases = [
        ("x (555) 123-4567 (555) 987-6543 y", ["(555) 123-4567", "(555) 987-6543"]), ("x 2024-01-02 555-123-4567 y", ["555-123-4567"]), ("x 555-123-4567. 555-987-6543 y", ["555-123-4567", "555-987-6543"]),
        ("x 555-123-4567 555-987-6543 555-222-3333 y", ["555-222-3333"]), ("x 8[.]8[.]8[.]8 y", ["8[.]8[.]8[.]8"]), ("x 10[.]0[.]0[.]1 y", ["10[.]0[.]0[.]1"]),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, t string")
    for r in personal_data.candidates(df, "t").select("doc_id", "t", "candidates.k", "candidates.s", "candidates.e", "candidates.digits").collect():
        kind = 1 if r.doc_id > 3 else 3
        assert set(cases[r.doc_id][1]) <= {r.t[s:e] for k, s, e in zip(r.k, r.s, r.e, strict=True) if k == kind}
        assert all(d == sum(map(str.isdigit, r.t[s:e])) for s, e, d in zip(r.s, r.e, r.digits, strict=True))
    texts = ["a call (555) 123-4567 (555) 987-6543 b", "host 8[.]8[.]8[.]8 is"]
    got = personal_data.redact_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [[texts[r.doc_id][x.s : x.e] for x in r.spans] for r in got] == [["(555) 123-4567", "(555) 987-6543"], ["8[.]8[.]8[.]8"]]


def test_personal_data_trees_hold_out(spark, model):
    rows = personal_data.samples(150, 99)
    got = {r.doc_id: r.spans for r in personal_data.redact_spans(spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(rows)], "doc_id long, text string"), model).collect()}
    hit = np.array([any(s.k == k for s in got[i]) for i, (_, k, _) in enumerate(rows)])
    true = np.array([y == 1 for *_, y in rows])
    assert (hit & true).sum() / hit.sum() >= 0.97 and (hit & true).sum() / true.sum() >= 0.85


def test_personal_data_makes_no_heap_and_no_workers_of_its_own(spark):
    """lower() fills an executor's heap once in its life, a list of rows starts Python workers."""
    assert not [name for name, sql in personal_data.FEATURES.items() if "lower(" in sql]
    texts = personal_data.texts_of(spark, personal_data.spanned_samples(5, 1))
    assert texts.count() == 25 and "PythonRDD" not in texts._jdf.queryExecution().toRdd().toDebugString()
    before = spark.createDataFrame([("CONTACT: ",), ("Telefon ",), ("nothing ",)], "b string").selectExpr("named_struct('b', b, 'a', '', 'm', 'a DOT b') AS x")
    got = before.selectExpr(*[f"{personal_data.FEATURES[f]} AS {f}" for f in ("near_mail", "near_phone", "written")]).collect()
    assert [tuple(r) for r in got] == [(1, 0, 1), (0, 1, 1), (0, 0, 1)]


def test_personal_data_edges(odd, empty, model, spark):
    assert personal_data.redact_spans(odd, model).count() == len(ODD) and personal_data.redact_spans(empty, model).count() == 0
    long = ["7 " * 30000, "@" * 5000 + "a@b.c", "1." * 30000, "a" * 200_000 + "@x.y", "1" * 100_000, "+1" + "(" * 100_000]
    rows = personal_data.redact_spans(spark.createDataFrame(list(enumerate(long)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [len(r.base) for r in rows] == [0, 1, 7500, 1, 0, 0]


# 5 Quality


def slow_repeats(words: list) -> int:
    seen: dict = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    return len({k for at in seen.values() if len(at) > 1 for i in at for k in range(i, i + 8)})


def test_statistics_are_those_of_brute_force(texts):
    r = np.random.default_rng(4)
    for text in [*list(texts.values())[:150], None, "", "a\x0bb\x0cc", *(" ".join(r.choice(["a", "b"], 40).tolist()) for _ in range(30)), "é # \n#\n \n#\nÜ"]:
        t = text or ""
        words, lines = re.findall(r"[^\x20\x09-\x0D]+", t), t.split("\n")
        worded = [x for x in lines if re.search(r"[^\x20\x09-\x0D]", x)]
        dup = sum(x in worded[:k] for k, x in enumerate(worded))
        got = quality.stats_of(text)
        assert got[:5] == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, slow_repeats(words))
        assert got[5] == sum(map(str.isupper, t)) and got[6] == len(worded)


def test_decision_list_agrees_with_its_sql_and_learns(docs, spark, sf_dir):
    r = np.random.default_rng(6)
    x = {f: r.random(2000) for f in quality.FEATURES}
    bad = (x["symbol_share"] > 0.8) | ((x["repeat_share"] > 0.7) & (x["n_words"] <= 0.5))
    rules = quality.learn(x, bad)
    found = np.zeros(2000, bool)
    for rule in rules:
        found |= rule.covers(x)
    assert len(rules) >= 2 and (found == bad).mean() > 0.97
    rated = quality.rate(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).toPandas()
    failed = (rated.n_words < 20) | (100 * rated.n_repeat_words > 30 * rated.n_words)
    assert (rated.base_failed == failed).all() and not (rated.kept & rated.base_failed).any()
    sql = docs.sparkSession.createDataFrame([(1.0, 0.1), (0.0, 0.9)], "n_symbols double, word_chars double")
    assert [v[0] for v in sql.select(quality.verdict([quality.Rule((("symbol_share", ">", 0.5),))])).collect()] == [False, True]


def test_quality_edges(odd, empty, spark):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (None, 1, 0), (8, None, 0)], "doc_id long, quality int, toxic int")
    assert quality.rate(odd, labels).count() == len(ODD) and quality.rate(odd, labels.limit(0)).where("NOT base_failed AND NOT kept").count() == 0
    assert quality.rate(empty, labels).count() == 0


# 6 Sharding


def test_shards_are_near_equal_gapless_and_keep_groups(docs, odd, empty):
    out = sharding.shard(docs).toPandas()
    sizes = out.groupby("shard")["size"].sum()
    assert len(sizes) == 16 and sizes.max() <= 1.1 * sizes.mean() and len(out) == docs.count()
    for _, own in out.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    text = {r.doc_id: r.text for r in docs.collect()}
    raw = out.doc_id.map(lambda i: (text[i] or "").encode())
    assert (out["size"] == raw.map(len) + 1).all() and (out.text_crc32 == raw.map(crc32)).all() and (out.law == "bytes").all() and out.grown_shard.isna().all()
    assert (out.groupby(["text_crc32", "size"]).shard.nunique() == 1).mean() > 0.95
    assert sharding.shard(odd).count() == len(ODD) and sharding.shard(empty).count() == 0


def test_a_hot_group_is_cut_and_balanced(spark):
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit(prose(1, 40))).otherwise(F.concat(F.lit("text "), F.col("id").cast("string"), F.lit(prose(2, 30)))).alias("text"))
    out = sharding.shard(d).toPandas()
    sizes = out.groupby("shard")["size"].sum()
    assert len(sizes) == 16 and sizes.max() <= 1.1 * sizes.mean()


def test_copies_without_ids_are_balanced(spark):
    rows = [(None, "the same text")] * 4000 + [(i, f"text {i} of its own") for i in range(400)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).toPandas()
    sizes = out.groupby("shard")["size"].sum()
    assert len(out) == 4400 and len(sizes) == 16 and sizes.max() / sizes.mean() <= 1.1
    assert all(sorted(g) == list(range(len(g))) for _, g in out.groupby("shard")["slot"])


def test_copies_without_ids_are_packed_in_many_parts(spark):
    rows = [(None, "same", "a")] * 3000 + [(i, f"own {i}", "b") for i in range(100)]
    out = packing.best_fit(spark.createDataFrame(rows, "doc_id long, text string, source string"), capacity=64, rows_per_part=256).toPandas()
    per_part = (out["bin"] // 2**32).value_counts()
    assert len(out) == 3100 and per_part.max() < 3 * per_part.mean()


def test_placement_takes_the_highest_dot_product():
    r = np.random.default_rng(3)
    cells = r.random((60, 3)) * 100
    share, free = cells / cells.sum(axis=0), np.full((4, 3), 0.25)
    want = np.zeros(60, int)
    for k in sorted(range(60), key=lambda k: (-share[k].max(), k)):
        fits = [s for s in range(4) if (free[s] >= share[k]).all()] or range(4)
        want[k] = max(fits, key=lambda s: (free[s] @ share[k], -s))
        free[want[k]] -= share[k]
    assert (sharding.place(cells, 4) == want).all()


# 7 Chats


def slow_viterbi(m, seen):
    from itertools import product

    log = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
    start, step, emit = log(m.start), log(m.step), [log(e) for e in m.emit]
    worth = lambda s: start[s[0]] + sum(step[a, b] for a, b in zip(s, s[1:], strict=False)) + sum(e[s[i], seen[i, k]] for i in range(len(s)) for k, e in enumerate(emit))
    return max(worth(s) for s in product(range(chat.STATES), repeat=len(seen))), worth


def test_chat_viterbi_is_the_best_path_and_recovers_roles(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    m = chat.fit(rows)
    seen = chat.features("User: hi?\nmore\n\nok then\nAssistant: yes".split("\n"))
    best, worth = slow_viterbi(m, seen)
    assert math.isclose(worth(tuple(m.decode(seen))), best)
    out = chat.format_chats(rows, m).toPandas()
    assert out.n_lines_right.sum() / out.n_lines.sum() > 0.9 and len(out) == rows.select("conv_id").distinct().count()
    assert chat.parse("### Instruction:\nHi\n\n### Response:\nHello\nthere", m) == [("user", "Hi"), ("assistant", "Hello\nthere")]


def test_chat_canonical_form_reads_back():
    turns = [("user", "a\n<|end|>\nb"), ("assistant", "")]
    text = chat.render(turns)
    assert re.findall(r"<\|(\w+)\|>\n(.*?)\n<\|end\|>\n", text, re.S) == [("user", "a\n< |end|>\nb"), ("assistant", "")]


def test_chat_edges(spark):
    s = "conv_id long, turn long, role string, text string, part string"
    rows = spark.createDataFrame([(1, 0, "user", None, "x"), (1, 0, "user", None, "x"), (1, None, None, "lost", "x"), (None, 3, "assistant", "", "x"), (2, 900, "user", "late " * 50000, "x"), (2, 1, "other", "a: b", "x")], s)
    out = chat.format_chats(rows, chat.fit(rows)).toPandas()
    assert len(out) == 5 and out.n_turns.min() >= 1
    assert chat.format_chats(rows.limit(0), chat.fit(rows.limit(0))).count() == 0


# 8 Lines


def slow_lines(rows: list[tuple]) -> dict:
    lines = [((i, k), x, frozenset(re.findall(r"[^\x20\x09-\x0D]+", x))) for i, t in sorted(rows, key=lambda r: r[0]) if t is not None for k, x in enumerate(t.split("\n"))]
    out: dict = {}
    for n, (at, x, s) in enumerate(lines):
        if s and any(y == x or (len(s) >= 2 and len(z) >= 2 and 9 * len(s & z) >= 4 * (len(s) + len(z))) for _, y, z in lines[:n]):
            out.setdefault(at[0], set()).add(at[1])
    return out


def test_line_dedup_wide_bitmaps_stand_for_long_lines_only(spark):
    """A key is the word's hash with 7 bits replaced by its frequency; lines of either bitmap are still compared with each other."""
    texts = [" ".join(f"w{i}" for i in range(a, a + n)) for a, n in ((0, 87), (0, 88), (1000, 191), (1000, 192), (2000, 70))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sketch = line_dedup._sketch(docs)
    rows = line_dedup._with_prefix(line_dedup._lines(docs), sketch, 4, 5, 2).orderBy("d").collect()
    assert [(r.n, r.sig6 is None, r.sig67 is None) for r in rows] == [(87, True, True), (88, False, True), (191, False, True), (192, False, False), (70, True, True)]
    changes = sketch.head().sketch
    for r, text in zip(rows, texts):
        low = (1 << line_dedup.HASH_BITS) - 1
        keys = []
        for w in text.split():
            h = xxhash.xxh64_intdigest(w, 42)
            level = (changes[h >> 64 - line_dedup.SKETCH_BITS] >> line_dedup.HASH_BITS) ^ (h - (h >> 63 << 64) >> line_dedup.HASH_BITS)
            assert -64 < level < -50  # 3 * log2(n + 1) - 64 of a few occurrences
            keys.append((level << line_dedup.HASH_BITS) + (h & low))
        assert r.prefix == sorted(keys)[: r.n - -(-4 * r.n // 5) + 1]
    assert [r.n_removed for r in line_dedup.dedup_lines(docs).orderBy("doc_id").collect()] == [0, 1, 0, 1, 0]


def test_line_dedup_hashes_the_words_of_equal_lines_once(spark, monkeypatch):
    given, with_prefix = [], line_dedup._with_prefix

    def watched(lines, *args):
        given.extend(r.line for r in lines.collect())
        return with_prefix(lines, *args)

    monkeypatch.setattr(line_dedup, "_with_prefix", watched)
    docs = spark.createDataFrame([(2, "a b c d e\n\nx y"), (1, "a b c d e\na b  c d e\na b c d e"), (3, "x y\nx z"), (None, "x y"), (4, None)], "doc_id long, text string")
    found = line_dedup.verdicts(docs).collect()
    assert sorted(given) == ["a b  c d e", "a b c d e", "x y", "x z"]
    assert sorted((r.d, r.line_no, r.times, r.similar) for r in found) == [(-(1 << 63), 0, 3, False), (1, 0, 3, False), (1, 1, 1, True), (3, 1, 1, False)]
    assert {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(docs).collect()} == {1: ("a b c d e", 2), 2: ("", 2), 3: ("x z", 1), None: ("x y", 0), 4: (None, 0)}


def test_words_and_their_hashes():
    hashed, r = line_dedup.Words(), np.random.default_rng(80)
    for n in (0, 1, 6, 1000, 200000):  # the last ones span many pieces, and words longer than a piece
        text = bytes(r.choice(np.frombuffer(b"abc  \n\t", np.uint8), n)) + b"\n" + (b"x" * 65 + b" " + b"y" * 150000 + b" ab ab" if n > 6 else b"")
        found = [(m.start(), m.group()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
        start, h = hashed(text)
        known: dict = {}
        assert start.tolist() == [at for at, _ in found]
        assert all(known.setdefault(w, x) == x for (_, w), x in zip(found, h.tolist())) and len(set(known.values())) == len(known)


def test_line_dedup_against_all_pairs(spark):
    r = np.random.default_rng(8)
    base = [prose(k, int(r.integers(1, 25))).split() for k in range(40)]
    rows = []
    for i in range(120):
        own = []
        for _ in range(int(r.integers(0, 5))):
            w = list(base[int(r.integers(40))])
            for _ in range(int(r.integers(0, 3))):
                w[int(r.integers(len(w)))] = str(r.choice([*WORDS, "new\tword", ""]))
            own.append(" ".join(w))
        rows.append((i, "\n".join(own)))
    got = {x.doc_id: (x.text, x.n_removed) for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    gone = slow_lines(rows)
    assert sum(map(len, gone.values())) > 50
    for i, t in rows:
        assert got[i] == ("\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ())), len(gone.get(i, ()))), i


def test_line_dedup_edges(odd, empty):
    out = line_dedup.dedup_lines(odd)
    rows = out.collect()
    by = {r.doc_id: r for r in rows if r.doc_id != 5}
    assert out.columns[: len(odd.columns)] == odd.columns and len(rows) == len(ODD)
    assert by[1].text is None and by[2].text == "" and by[3].n_removed == 0 and by[8].n_removed == 19999
    assert [r.n_removed for r in rows if r.doc_id == 5] == [1, 1] and by[4].n_removed == 0
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_runs_no_python_on_executors(spark, monkeypatch):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "a b c d e\nx\ty"), (2, "a b c d e\nx y\na b c d f"), (3, None)], "doc_id long, text string")

    def refused(*_, **__):
        raise AssertionError("Python on the executors")

    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(type(docs), name, refused)
    for out in (line_dedup.dedup_lines(docs), corpus_pipeline.lines(spark, docs, "")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
        assert {r.doc_id: r.text for r in out.collect()}[2] == "a b c d f"
    assert [r.n_removed for r in line_dedup.dedup_lines(docs).orderBy("doc_id").collect()] == [0, 2, 0]


# 9 Tokens


@pytest.fixture(scope="module")
def definition():
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def test_token_counts_are_the_librarys(docs, odd, empty, definition):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(definition)
    t.no_padding()
    t.no_truncation()
    for table in (docs, odd):
        text = [(r.doc_id, r.text or "") for r in table.collect()]
        want = sorted((i if i is not None else -1, len(x.encode()), len(t.encode(x, add_special_tokens=False).ids)) for i, x in text)
        got = token_counts.count_tokens(table, definition, sample_docs=20, table_size=100, cache_size=50).collect()
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 2048) for r in got)
    assert token_counts.count_tokens(empty, definition).count() == 0


def test_token_counts_on_random_characters(definition):
    from tokenizers import Tokenizer

    t, count, r = Tokenizer.from_str(definition), token_counts.Counts(definition, {}), np.random.default_rng(9)
    pool = [*map(chr, range(0x20, 0x250)), *"'s 't 're İ Σς ﬁ 漢字 😀 é   \u0085 \x1c ½ ²".split(" "), " ", "\n", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "I'll", "don't", "a" * 300]
    for _ in range(1500):
        text = "".join(r.choice(pool, r.integers(1, 40)).tolist())
        assert count(text) == len(t.encode(text, add_special_tokens=False).ids), repr(text)
    long = ("word's 12 naïve " * 100_000)
    assert count(long) == len(t.encode(long, add_special_tokens=False).ids)


# 10 SimHash


def slow_fingerprint(text: str | None) -> int:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    h = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in ([w[i : i + 3] for i in range(len(w) - 2)] if len(w) >= 3 else [w])] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def slow_classes(values: list[int], near: int = 3) -> dict[int, int]:
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    own = sorted(root)
    for k, a in enumerate(own):
        for b in own[k + 1 :]:
            if (a ^ b).bit_count() <= near:
                a2, b2 = find(a), find(b)
                root[max(a2, b2)] = min(a2, b2)
    return {v: find(v) for v in own}


def test_fingerprints_and_components(docs, texts, odd, spark):
    for rows, table in ((list(texts.items()), docs), ([(r[0], r[1]) for r in ODD], odd)):
        fp = [(i, slow_fingerprint(t)) for i, t in rows]
        classes = slow_classes([f for _, f in fp])
        least: dict = {}
        for i, f in fp:
            if i is not None:
                least[classes[f]] = min(least.get(classes[f], i), i)
        want = sorted((-1 if i is None else i, f"{f:016x}", least.get(classes[f], -1)) for i, f in fp)
        got = simhash.with_components(table).withColumn("f", F.lower(F.lpad(F.hex("fp"), 16, "0"))).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.f, -1 if r.component_id is None else r.component_id) for r in got) == want
        kept = simhash.keep_one(table)
        assert kept.count() == len(set(classes.values())) and kept.columns == table.columns


def test_trees_lose_no_link(spark):
    r = np.random.default_rng(10)
    centre = r.integers(0, 1 << 63, 150, dtype=np.uint64)
    values = set(centre.tolist())
    for c in centre[:100]:
        v = int(c)
        for _ in range(6):  # a chain, each step within 3 bits
            for b in r.choice(64, int(r.integers(1, 4)), replace=False):
                v ^= 1 << int(b)
            values.add(v)
    fp = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp long")
    links = simhash.linked(fp, leaf=16, least_sample=4096, most_sample=4096)
    found = {np.int64(x.a).view(np.uint64).item(): np.int64(x.b).view(np.uint64).item() for x in components.components(links).collect()}
    classes = slow_classes(list(values))
    groups = lambda root: {frozenset(v for v in values if root(v) == c) for c in {root(v) for v in values}}
    assert groups(lambda v: found.get(v, v)) == groups(lambda v: classes[v])


def test_large_shards_are_divided_without_losing_links():
    r = np.random.default_rng(5)
    fp = np.unique(r.integers(0, 1 << 63, 4000, dtype=np.int64).view(np.uint64))
    near = fp[:300] ^ (np.uint64(1) << r.integers(0, 64, 300).astype(np.uint64))
    fp = np.concatenate([fp, near])
    whole = dict(zip(*simhash.forest(fp, 3), strict=True))
    parts = [simhash.shard_links(fp, mask, 3, 64) for mask in simhash.HALVES]
    linked = {}
    for a, b in ((int(x), int(y)) for p in parts for x, y in zip(*p, strict=True)):
        linked.setdefault(a, set()).add(b)
        linked.setdefault(b, set()).add(a)
    for a, b in whole.items():
        seen, todo = set(), [int(a)]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += linked.get(x, ())
        assert int(b) in seen


CLASHES = "doc_id long, text string, source string, lang string, n_removed string, n_lines string, id string, hash string, n string, d string, k string, text_hash string, gone string, extra string, __id string, __hash string"


def test_clashing_columns_are_kept(spark):
    row = lambda i, t: (i, t, "s", "en", *[f"{c}{i}" for c in range(12)])
    rows = [row(1, prose(1, 40)), row(2, prose(1, 40)), row(2, prose(1, 40)), row(None, None), row(3, prose(3, 30) + "\n" + prose(1, 40))]
    docs = spark.createDataFrame(rows, CLASHES)
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns and {r for r in map(tuple, got.collect())} <= set(rows)
    out = line_dedup.dedup_lines(docs, names=("a", "b"))
    assert out.columns == [*docs.columns, "a", "b"] and sorted((r.n_removed, r.extra) for r in out.collect()) == sorted((r[4], r[13]) for r in rows)
    assert line_dedup.dedup_lines(docs).count() == len(rows)
    assert corpus_pipeline.lines(spark, docs, "").columns == docs.columns


def test_simhash_empty(empty):
    assert simhash.with_components(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_components_of_a_long_path(spark):
    links = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(100, 100), (200, 201), (201, 200), (None, 3)], "a long, b long"))
    got = {r.a: r.b for r in components.components(links).collect()}
    assert got == {**{k: 0 for k in range(1, 61)}, 201: 200}


# Pipeline


def test_pipeline_stages_keep_what_they_should(spark, docs, sf_dir):
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, sf_dir).cache()
        assert out.columns == docs.columns and 0 < out.count() <= now.count(), name
        now = out
    packed = corpus_pipeline.packed(spark, now, sf_dir).toPandas()
    assert set(packed.doc_id) == {r.doc_id for r in now.collect()}
    item = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    assert not any(t in r.text for r in now.collect() for t in item.values())


def test_pipeline_odd_and_empty(spark, odd, empty, sf_dir):
    for table in (odd, empty):
        now = table
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, sf_dir).cache()
        now.count()


def test_queries_with_sql_match_it(spark, con, sf_dir):
    from oracle import differences

    for name, sql in queries.ORACLE_SQL.items():
        assert differences(spark, con, queries.QUERIES[name], sql, sf_dir) == "", name


def test_query_columns(spark, sf_dir):
    want = {
        "op3_language_id": "doc_id held_out lang_pred score", "op5_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op4_personal_data": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
        "op6_sharding": "doc_id size text_crc32 law shard slot grown_shard", "op9_token_counts": "doc_id n_bytes n_tokens over_limit", "op10_simhash_dedup": "doc_id fingerprint component_id",
    }
    for name, columns in want.items():
        assert queries.QUERIES[name](spark, sf_dir).columns == columns.split()
    row = queries.QUERIES["op4_personal_data"](spark, sf_dir).where("spans = ''").first()
    assert row.base_sha256 == hashlib.sha256(b"").hexdigest()
