"""Collocations, vector codes and quality rules against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenspan.llm import collocations, quality_rules, vector_codes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_phrases(rows, least, top, most=5):
    """Every rule as the contract says it; a phrase is compared with all longer candidates."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, most + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    candidates = {x: a for x, a in f.items() if a >= least and len(x[1]) > 1}
    out = []
    for (lang, p), a in candidates.items():
        inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        if any(o == lang and len(q) > len(p) and b >= a and inside(q) for (o, q), b in candidates.items()):
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, left, right, n[lang], score))
    out.sort(key=lambda x: (x[0], -x[6], -x[2], x[1].encode()))
    ranked, place = [], Counter()
    for lang, *rest in out:
        place[lang] += 1
        if place[lang] <= top:
            ranked.append((lang, place[lang], *rest))
    return ranked


def phrase_rows():
    rng = random.Random(3)
    vocab = ["the", "of", "New", "York", "new", "É", "字", "a b", "x-y", "q"]
    rows = []
    for i in range(120):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 40))]
        for at in sorted((rng.randrange(len(words) + 1) for _ in range(3)), reverse=True):
            words[at:at] = rng.choice([["city", "of", "new", "york"], ["in", "spite", "of", "it", "all"], ["\n"], [","], ["."]])
        rows.append((rng.choice([" ", "  ", "\t"]).join(words), rng.choice(["en", "fr", None, "und"])))
    return [*rows, (None, "en"), ("", None), (" \t\n", "en"), ("one two " * 20_000, "long"), ("w", "tiny"), *[("same row here", "rep")] * 9]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, x, "clash", "clash", "clash") for i, (t, x) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, n string, score string")


@pytest.mark.parametrize("kept", [(1 << 20, 1 << 20, 2_000_000), (40, 60, 0)])
def test_phrases_equal_brute_force(spark, monkeypatch, kept):
    """Once as it is, once with dictionaries and counts given out early and bitmaps in the place of hashes."""
    for name, value in zip(("KEPT_WORDS", "KEPT_PHRASES", "MOST_HASHES"), kept, strict=True):
        monkeypatch.setattr(collocations, name, value)
    monkeypatch.setattr(collocations, "CHUNK", 500)
    rows = phrase_rows()
    got = collocations.collocations(frame(spark, rows), least=8, top=12)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute_phrases(rows, 8, 12)
    assert len(want) > 30 and sorted(map(tuple, got.collect())) == sorted(want)


def test_products_of_counts_may_pass_64_bits(spark):
    wide = [("x", "a", 3_000_000_000_000), ("x", "b", 2_999_999_999_999), ("x", None, 15_000_000_000_001)]
    level1 = spark.createDataFrame(wide, "lang string, phrase string, n long")
    level2 = spark.createDataFrame([("x", "a b", 2_999_999_999_998)], "lang string, phrase string, n long")
    row = collocations._scored([level1, level2]).first()
    assert row.score == 1000 * 2_999_999_999_998 * 15_000_000_000_001 // (3_000_000_000_000 * 2_999_999_999_999)


def test_phrases_of_odd_tables(spark, no_docs):
    assert collocations.collocations(no_docs).count() == 0
    assert collocations.collocations(frame(spark, [(None, None), ("a b", None)])).count() == 0


def brute_codes(rows, entries=64, rounds=2):
    kept = [(i, np.floor(np.array(v, np.float64) * 256).astype(int), x) for i, v, x in rows if v is not None and None not in v and np.isfinite(v).all()]
    out = []
    for size in sorted({len(v) for _, v, _ in kept}):
        own = sorted(((i is None, i or 0, tuple(v)), x) for i, v, x in kept if len(v) == size)
        vectors = np.array([k[2] for k, _ in own], int).reshape(len(own), size)
        cut = [slice(size * p // 16, size * (p + 1) // 16) for p in range(16)]
        books = [[[int(c) for c in v[s]] for v in vectors[:entries]] for s in cut]

        def nearest(part, book):
            return min((sum((int(a) - b) ** 2 for a, b in zip(part, e, strict=True)), j) for j, e in enumerate(book))

        for _ in range(rounds):
            for p in range(16):
                groups = {}
                for v in vectors[:, cut[p]].tolist():
                    groups.setdefault(nearest(v, books[p])[1], []).append(v)
                for j, g in groups.items():
                    books[p][j] = [sum(c) // len(g) for c in zip(*g, strict=True)]
        digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
        for ((null, i, v), x) in own:
            found = [nearest(v[s], b) for s, b in zip(cut, books, strict=True)]
            out.append((None if null else i, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found), x, digest))
    labels = Counter()
    for _, _, e, x, _ in out:
        labels[x] += e
    return sorted(((i, c, e, labels[x], h) for i, c, e, x, h in out), key=repr)


VECTORS = "vec_id long, embedding array<float>, label int, code string, n string, error string"


def test_codes_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.02, 32).astype(np.float32).tolist(), int(rng.integers(0, 3))) for i in range(260)]
    rows += [(1000 + i, rows[3][1], 1) for i in range(150)]  # a hot vector
    rows += [(2000 + i, rows[5][1][:16] + rows[6][1][16:], None) for i in range(20)]
    rows += [(7, rows[7][1], 2)] * 2 + [(7, rows[9][1], 2), (None, rows[9][1], None), (None, rows[11][1], 0)]
    rows += [(3000, None, 1), (3001, [None] * 32, 1), (3002, [float("nan")] * 32, 1), (3003, [float("inf")] + [0.0] * 31, 1), (3004, [0.0] * 32, None)]
    rows += [(4000 + i, rng.normal(0, 1, 20).astype(np.float32).tolist(), 5) for i in range(5)]  # another length, which 16 doesn't divide
    rows += [(5000, [0.5, -0.25], 5), (5001, [], 5), (5002, [], 6)]
    got = vector_codes.vector_codes(spark.createDataFrame([(*r, "c", "c", "c") for r in rows], VECTORS))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_codes(rows)


def test_means_are_rounded_down_and_ties_go_to_the_lower_entry(spark):
    rows = [(i, [x / 256] + [0.0] * 15, 0) for i, x in enumerate([-3.0, 3.0, 0.0, -4.0, -4.0])]
    table, books = vector_codes.compress(spark.createDataFrame([(*r, "c", "c", "c") for r in rows], VECTORS), entries=2)
    # 0 is as near to -3 as to 3: -3, 0, -4, -4 sum to -11, a quarter of which is below -2.75
    assert books[16][0].tolist() == [[-3], [3]]
    assert {r.vec_id: r.code[:2] for r in table.collect()} == {0: "00", 1: "01", 2: "00", 3: "00", 4: "00"}
    back = {r.vec_id: r.embedding for r in vector_codes.decompress(table, books[16]).collect()}
    assert back[1][0] == pytest.approx(3.5 / 256)


def test_codes_of_no_vectors(spark):
    assert vector_codes.vector_codes(spark.createDataFrame([], VECTORS)).count() == 0
    assert vector_codes.vector_codes(spark.createDataFrame([(1, None, 1, "", "", "")], VECTORS)).count() == 0


def test_huge_components_are_held_within_the_bound(spark):
    rows = [(1, [3e38] * 16, 0, "", "", ""), (2, [-3e38] * 16, 0, "", "", ""), (3, [0.0] * 16, 0, "", "", "")]
    got = {r.vec_id: r.error for r in vector_codes.compress(spark.createDataFrame(rows, VECTORS), entries=1, rounds=0)[0].collect()}
    assert got == {1: 0, 2: 16 * (2 * vector_codes.MOST) ** 2, 3: 16 * vector_codes.MOST**2}


def brute_rules(docs, trusted, threshold):
    code = lambda w: zlib.crc32(w.encode())

    def grams(words):
        c = [code(w) for w in words]
        one = [((x * 1_640_531_527) & 0xFFFFFFFF) >> 16 for x in c]
        return one + [((x * 625_341_585 + y * 461_845_907) & 0xFFFFFFFF) >> 16 for x, y in zip(c, c[1:], strict=False)]

    raw, target = Counter(), Counter()
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    for i, t in docs:
        g = grams(split(t))
        raw.update(g)
        if i in trusted:
            target.update(g)
    r, t, b = sum(raw.values()), sum(target.values()), quality_rules.BUCKETS
    p = lambda x: (raw[x] + 1) / (r + b)
    weight = lambda x: math.floor(math.log((target[x] + quality_rules.PRIOR * p(x)) / (t + quality_rules.PRIOR) / p(x)) * 1000 + 0.5)
    out = []
    for i, text in docs:
        text = text or ""
        w, lines = split(text), [x for x in text.split("\n") if split(x)]
        windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        twice = {k + j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(5)}
        failed = len(w) < 10 or 100 * len(twice) > 20 * len(w)
        g = grams(w)
        total = sum(map(weight, g))
        out.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(twice), failed, not failed and total >= threshold * len(g), len(g)))
    return sorted(out, key=repr)


def test_rules_equal_brute_force(spark):
    rng = random.Random(4)
    words = lambda n, v: " ".join(rng.choice(v) for _ in range(n))
    good, bad = [f"w{i}" for i in range(60)], [f"w{i}$$$" for i in range(60)]
    docs = [(i, words(60, good)) for i in range(80)] + [(100 + i, words(60, bad)) for i in range(40)]
    some = words(7, good)
    docs += [(200, None), (201, ""), (202, " \t\r\n"), (203, "few words"), (204, f"{some} x {some} y {some} " + words(80, good)), (205, words(8, good) + "\n\n" + "a line\n" * 3 + " a line\n\x0b\n" * 2)]
    docs += [(206, words(30_000, good) + " " + some + " " + some), (207, "É 字 😀 # * <b>|& %$ " * 4), (208, "a b c d e " * 9), (209, "a a a a a a a a a a a"), (210, "a b c d e f g h i a b c d e")]
    docs += [docs[3]] * 2 + [(3, "another text of a known id with ten words in it"), (None, docs[5][1]), (None, None)]
    labels = [(i, 1) for i in range(0, 80, 2)] + [(100, 0), (101, None), (None, 1), (999, 1), (0, 1), (0, 0)]
    table = spark.createDataFrame([(i, t, "clash", "clash", "clash") for i, t in docs], "doc_id long, text string, kept string, words string, codes string")
    got = quality_rules.quality_rules(table, spark.createDataFrame(labels, "doc_id long, quality int"), threshold=-60)
    want = brute_rules(docs, {i for i, q in labels if q == 1 and i is not None}, -60)
    assert sorted((tuple(r)[:9] for r in got.collect()), key=repr) == want
    ratio = {r.doc_id: r.llr for r in got.where("doc_id between 4 and 139").collect()}
    assert max(ratio[i] for i in range(100, 140)) < min(ratio[i] for i in range(4, 80))  # how far apart they are depends on how much was trusted


def test_rules_of_odd_tables(spark, no_docs):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality_rules.quality_rules(no_docs, labels).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k")], "doc_id long, text string")
    got = quality_rules.quality_rules(docs, labels.limit(0)).first()
    assert got.kept and got.llr == 0.0  # nothing is trusted: no n-gram says anything


def test_rules_run_no_python(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([(i, "one two three four five six seven eight nine ten " * 3) for i in range(50)], "doc_id long, text string").write.parquet(path)
    out = quality_rules.apply_rules(spark.read.parquet(path), [0] * quality_rules.BUCKETS)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)
    assert out.where(F.col("n_repeat_words") != 30).count() == 0


def test_only_words_of_the_level_below_are_numbered():
    """Words of no frequent phrase take no room in a task, however many there are; counts are the same."""
    h = lambda *p: [int(collocations._phrase_hash("en", np.array([[collocations._word_hash(w) for w in p]], np.uint64))[0])]
    known = np.sort(np.array(h(b"a", b"b") + h(b"b", b"c"), np.uint64))
    text = b" ".join(b"a b c x%d a b" % i for i in range(1000)) + b". c, a b c"
    counts = []
    for words in ([b"a", b"b", b"c"], None):
        counter = collocations.Counter(3, collocations.Frequent(known, words=words))
        counter.add("en", [text, b"b c"])
        assert len(counter.words) == (4 if words else 1004)
        counts.append([r for b in counter.out() for r in b.to_pylist()])
    assert counts[0] == counts[1] == [{"lang": "en", "phrase": "a b c", "n": 1001}]


def test_phrases_beyond_the_vocabulary_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(collocations, "MOST_VOCABULARY", 0)
    test_phrases_equal_brute_force(spark, monkeypatch, (40, 60, 2_000_000))
