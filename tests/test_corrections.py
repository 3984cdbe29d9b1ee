"""Correction scoring and approximate search against plain loops."""

import itertools
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lumenspan.functions.fuzzy import alike_windows
from lumenspan.operators.corrections import case_scores, score_corrections
from lumenspan.operators.fuzzy_joins import fuzzy_occurrences

GOLD = "case_id long, evidence_index long, chunk_id string, gold_index long, start_char int, end_char int, accepted array<string>, weight double"
PREDICTED = "case_id long, evidence_index long, chunk_id string, prediction_index long, start_char int, end_char int, original string, resolved string"
SOURCES = "case_id long, evidence_index long, chunk_id string, source_text string"


def ratio(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return 100.0 if not a and not b else 200.0 * row[-1] / (len(a) + len(b))


def scan(needle, text, threshold):
    """All windows, one after another."""
    n, out = len(needle), []
    for s in range(len(text)):
        for m in range(max(1, n - max(2, n // 3)), n + max(2, n // 3) + 1):
            if n and s + m <= len(text) and ratio(needle, text[s : s + m]) >= threshold:
                out.append((s, s + m, ratio(needle, text[s : s + m])))
    return sorted(out)


def test_windows_of_one_needle():
    rng = random.Random(2)
    for n, threshold in itertools.product((1, 2, 5, 9, 63, 64, 70), (60.0, 80.0, 100.0)):
        needle = "".join(rng.choice("abc字") for _ in range(n))
        text = "".join(rng.choice("abc字 ") for _ in range(60)) + needle[: n // 2] + "x" + needle[n // 2 :] + "ab"
        assert alike_windows(needle, text, threshold) == scan(needle, text, threshold)


@pytest.mark.parametrize("threshold", [60.0, 80.0, 90.0, 100.0])
def test_fuzzy_join_equals_the_plain_scan(spark, threshold):
    rng = random.Random(int(threshold))
    word = lambda n, letters="abcd": "".join(rng.choice(letters) for _ in range(n))
    needles = [(i, word(n)) for i, n in enumerate((1, 2, 3, 4, 6, 9, 12, 20, 30))] + [(50, "字é" + word(5)), (51, ""), (52, None), (53, word(9)), (54, "aaaaaaaa")]
    texts = []
    for i in range(25):
        t = word(rng.randint(0, 40), "abcdefgh字")
        for _, needle in rng.sample(needles, 3):
            spoiled = list(needle or "")
            for _ in range(rng.randint(0, 3)):
                if spoiled:
                    spoiled[rng.randrange(len(spoiled))] = rng.choice(["", "z", "ab"])
            t += "".join(spoiled) + word(rng.randint(0, 5), "efgh")
        texts.append((i, t))
    texts += [(100, None), (101, ""), (102, "a" * 30), (103, "a")]
    got = fuzzy_occurrences(spark.createDataFrame(needles, "needle_id long, needle string"), spark.createDataFrame([(*t, "c") for t in texts], "text_id long, text string, needle string"), threshold)
    want = {(i, j, *w) for i, needle in needles for j, t in texts if needle and t for w in scan(needle, t, threshold)}
    rows = [(r.needle_id, r.text_id, r.start, r.end, r.similarity) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and want
    assert "Cartesian" not in (plan := got._jdf.queryExecution().toString()) and "NestedLoop" not in plan


def test_many_needles_and_few_find_the_same(spark, monkeypatch):
    """Needles that every task has, those that are joined, and all windows one after another."""
    from lumenspan.operators import fuzzy_joins

    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcd é字") for _ in range(n))
    needles = [(f"n{i}", word(n)) for i, n in enumerate((1, 2, 5, 8, 13, 18, 19, 20, 23, 40, 63, 64, 70))]
    texts = [(f"t{i}", word(rng.randint(0, 20)) + rng.choice(needles)[1].replace("b", rng.choice(["b", "bx", ""]), 2) + word(9)) for i in range(40)] + [("t_", None)]
    n, t = spark.createDataFrame(needles, "needle_id string, needle string"), spark.createDataFrame(texts, "text_id string, text string")
    want = sorted((i, j, *w) for i, needle in needles for j, text in texts if text for w in alike_windows(needle, text, 85.0))
    plans = []
    for most in (fuzzy_joins.MOST_NEEDLES, 0):
        monkeypatch.setattr(fuzzy_joins, "MOST_NEEDLES", most)
        got = fuzzy_occurrences(n, t, 85.0)
        plans.append(got._jdf.queryExecution().toString())
        assert sorted(map(tuple, got.collect())) == want and len(want) > 40
    assert "Exchange" not in plans[0] and "Join" in plans[1]  # with few needles no stretch of a text is shuffled


def test_long_texts_are_searched_in_slices(spark):
    from lumenspan.operators.fuzzy_joins import BATCH_CHARS

    rng = random.Random(3)
    needle, noise = "the seventh gate", "".join(rng.choice("abcdefgh ") for _ in range(5_000))
    text = (noise * (2 * BATCH_CHARS // 5_000 + 2))[: 2 * BATCH_CHARS + 40]
    for at in (0, BATCH_CHARS - 16, 2 * BATCH_CHARS - 8, len(text) - 16):
        text = text[:at] + rng.choice([needle, "the seventy gate"]) + text[at + 16 :]
    got = fuzzy_occurrences(spark.createDataFrame([(7, needle)], "needle_id long, needle string"), spark.createDataFrame([(1, noise), (2, text)], "text_id long, text string"), 90.0)
    want = sorted((7, j, *w) for j, x in ((1, noise), (2, text)) for w in alike_windows(needle, x, 90.0))
    assert sorted(map(tuple, got.collect())) == want and len({s // 40 for _, _, s, _, _ in want}) >= 4


def test_no_needles_and_no_texts(spark):
    needles, texts = spark.createDataFrame([], "needle_id long, needle string"), spark.createDataFrame([(1, "ab")], "text_id long, text string")
    assert fuzzy_occurrences(needles, texts).count() == 0
    assert fuzzy_occurrences(spark.createDataFrame([(1, "ab")], "needle_id long, needle string"), texts.limit(0)).count() == 0
    with pytest.raises(ValueError):
        fuzzy_occurrences(needles, texts, 0)


def plain(text):
    text = " ".join(unicodedata.normalize("NFKC", text).casefold().split())
    return re.sub("(?<=[a-z0-9]) (?=[一-鿿])|(?<=[一-鿿]) (?=[a-z0-9])", "", text)


def brute(gold, found, text):
    """matches of one chunk's gold (index -> start, end, accepted) and predictions (start, end, original, resolved)."""
    meets = lambda g, p: g[0] < p[1] and p[0] < g[1]
    right = lambda p: text[p[0] : p[1]] == p[2]
    exact, fuzzy = {}, []
    for (i, g), (j, p) in itertools.product(enumerate(gold), enumerate(found)):
        if not meets(g, p) or not right(p):
            continue
        lo, hi = min(g[0], p[0]), max(g[1], p[1])
        actual = plain(text[lo : p[0]] + p[3] + text[p[1] : hi])
        tried = [(actual == (e := plain(text[lo : g[0]] + a + text[g[1] : hi])), ratio(actual, e), -k) for k, a in enumerate(g[2])]
        same, score, k = max(tried)
        if same:
            exact[i, j] = -k
        elif score >= 90:
            fuzzy.append((-score, i, j, 0, -k, -1, -1))
    stretches = {}
    for j, p in enumerate(found):
        mine = [(i, g) for i, g in enumerate(gold) if meets(g, p)]
        if not mine or not right(p):
            continue
        lo, hi = min(p[0], *(g[0] for _, g in mine)), max(p[1], *(g[1] for _, g in mine))
        before = text[lo : p[0]]
        actual, a, b = plain(before + p[3] + text[p[1] : hi]), len(plain(before)), len(plain(before + p[3]))
        for i, g in mine:
            for k, accepted in enumerate(g[2]):
                for s, e, score in scan(plain(accepted), actual, 80.0):
                    if s < b and a < e:
                        fuzzy.append((-score, i, j, 1, k, s, e))
                        if score == 100.0:
                            stretches.setdefault((i, j, k), (s, e))
    # the greatest matching that gives the first gold their first predictions, by trying all
    options = [[j for j in range(len(found)) if (i, j) in exact] for i in range(len(gold))]
    size = max(sum(x is not None for x in way) for way in itertools.product(*[[*o, None] for o in options]) if len(set(y for y in way if y is not None)) == sum(y is not None for y in way))
    return exact, sorted(fuzzy), stretches, size


def case(rng):
    letters = "abcdef"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(9)]
    text, spans, at = " ".join(words), [], 0
    for w in words:
        spans.append((at, at + len(w)))
        at += len(w) + 1
    gold, found = [], []
    for k in sorted(rng.sample(range(9), rng.randint(0, 6))):
        gold.append((*spans[k], [words[k][::-1], words[k].upper() + "q"], rng.choice([1.0, 0.5])))
    for _ in range(rng.randint(0, 6)):
        k = rng.randrange(9)
        last = min(8, k + rng.choice([0, 0, 0, 1, 2]))
        s, e = spans[k][0], spans[last][1]
        new = " ".join(rng.choice([w[::-1], w[::-1], w.upper() + "q", w, w[::-1] + "x"]) for w in words[k : last + 1])
        found.append((s, e, text[s:e] if rng.random() < 0.9 else "stale", new))
    return text, gold, found


def test_scores_equal_brute_force(spark):
    rng = random.Random(9)
    cases = {i: case(rng) for i in range(120)}
    cases[500] = ("先走同。p i 加再看后面", [(2, 3, ["通道"], 1.0), (4, 9, ["第i+1个", "第i个", "第i"], 1.0)], [(2, 9, "同。p i 加", "通道 第 i 个")])
    cases[501] = ("今天上海的天汽很好", [(5, 8, ["天气预报很"], 1.0)], [(5, 7, "天汽", "天气预很")])
    cases[502] = ("天汽很好；再说天汽很", [(0, 3, ["天气预报很"], 1.0)], [(7, 9, "天汽", "天气预很")])
    cases[503] = ("xa xb", [(0, 2, ["ya"], 1.0), (3, 5, ["yb"], 0.5)], [(0, 5, "xa xb", "ya xb")])
    cases[504] = ("a b", [], [(0, 1, "a", "x")])
    gold = [(c, 1, "k", i, *g) for c, (_, gs, _) in cases.items() for i, g in enumerate(gs)]
    found = [(c, 1, "k", j, *p) for c, (_, _, ps) in cases.items() for j, p in enumerate(ps)]
    sources = spark.createDataFrame([(c, 1, "k", t) for c, (t, _, _) in cases.items()], SOURCES)
    corrections, credits = score_corrections(spark.createDataFrame(gold, GOLD), spark.createDataFrame(found, PREDICTED), sources)
    by_case, worth = {}, {}
    for r in corrections.collect():
        by_case.setdefault(r.case_id, {})[r.gold_index] = r
    for r in credits.collect():
        worth.setdefault(r.case_id, {})[r.prediction_index] = r
    seen_exact = seen_fuzzy = seen_many = 0
    for c, (text, gs, ps) in cases.items():
        exact, fuzzy, stretches, size = brute([g[:3] for g in gs], ps, text)
        own = by_case.get(c, {})
        assert sorted(own) == list(range(len(gs)))
        got = {i: (r.prediction_index, r.kind, r.basis, r.similarity) for i, r in own.items() if r.kind != "unmatched"}
        sure = {i: j for i, (j, kind, _, _) in got.items() if kind == "exact"}
        assert len(sure) == size and len(set(sure.values())) == size and all((i, j) in exact for i, j in sure.items())
        # given the exact matches, the rest is a plain greedy walk
        want, taken, local = {i: (j, "exact", "local", 100.0) for i, j in sure.items()}, {}, set()
        for i, j in sure.items():
            if (i, j, exact[i, j]) in stretches:
                taken.setdefault(j, []).append(stretches[i, j, exact[i, j]])
        for score, i, j, basis, _, s, e in fuzzy:
            if i in want:
                continue
            if basis == 0:
                if j in local:
                    continue
                local.add(j)
            elif any(s < y and x < e for x, y in taken.get(j, [])):
                continue
            else:
                taken.setdefault(j, []).append((s, e))
            want[i] = (j, "fuzzy", "expression" if basis else "local", -score)
        assert {i: (*x[:3], round(x[3], 9)) for i, x in got.items()} == {i: (*x[:3], round(x[3], 9)) for i, x in want.items()}
        for j, p in enumerate(ps):
            near = [i for i, g in enumerate(gs) if g[0] < p[1] and p[0] < g[1]]
            mine, total = [i for i in near if want.get(i, (None,))[0] == j], sum(gs[i][3] for i in near)
            r = worth[c][j]
            assert r.matched_gold == mine
            assert r.relaxed_credit == (sum(gs[i][3] for i in mine) / total if near else 0.0)
            assert r.strict_credit == (sum(gs[i][3] for i in mine if want[i][1] == "exact") / total if near else 0.0)
            seen_many += len(mine) > 1
        seen_exact += len(sure)
        seen_fuzzy += len(want) - len(sure)
    assert seen_exact > 40 and seen_fuzzy > 20 and seen_many > 5
    assert {i: r.kind for i, r in by_case[500].items()} == {0: "fuzzy", 1: "fuzzy"}
    assert by_case[501][0].basis == "expression" and by_case[501][0].similarity >= 80
    assert by_case[502][0].kind == "unmatched" and not by_case[502][0].overlapping
    assert worth[503][0].kind == "unmatched" and worth[503][0].relaxed_credit == pytest.approx(2 / 3)
    totals = {r.case_id: r for r in case_scores(corrections, credits).collect()}
    assert totals[504].gold == 0 and totals[504].incorrect == 1 and totals[502].missed == 1
    assert sum(r.exact for r in totals.values()) == seen_exact and sum(r.fuzzy for r in totals.values()) == seen_fuzzy


def test_more_gold_is_matched_exactly_than_the_first_choices_allow(spark):
    """Two predictions could serve the first gold exactly; the second gold needs the first of them."""
    text = "ab cd"
    gold = [(1, 1, "k", 0, 0, 2, ["x"], 1.0), (1, 1, "k", 1, 3, 5, ["y"], 1.0)]
    found = [(1, 1, "k", 0, 0, 5, text, "x y"), (1, 1, "k", 1, 0, 2, "ab", "x"), (1, 1, "k", 2, 3, 5, "cd", "y")]
    corrections, _ = score_corrections(spark.createDataFrame(gold, GOLD), spark.createDataFrame(found, PREDICTED), spark.createDataFrame([(1, 1, "k", text)], SOURCES))
    assert {r.gold_index: (r.prediction_index, r.kind) for r in corrections.where(F.col("kind") == "exact").collect()} == {0: (1, "exact"), 1: (2, "exact")}


def test_texts_are_shuffled_once_and_not_with_pairs(spark):
    text = "ab cd ef gh"
    gold = spark.createDataFrame([(1, 1, "k", i, 3 * i, 3 * i + 2, ["x"], 1.0) for i in range(4)], GOLD)
    found = spark.createDataFrame([(1, 1, "k", i, 3 * i, 3 * i + 2, text[3 * i : 3 * i + 2], "x") for i in range(4)], PREDICTED)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        credits = score_corrections(gold, found, spark.createDataFrame([(1, 1, "k", text)], SOURCES))[1]
        plan = credits._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") <= 6 and {r.kind for r in credits.collect()} == {"exact"}


def test_odd_gold_and_predictions(spark):
    """Keys and texts that are null match nothing; accepted expressions may be none, or null."""
    text = "ab cd"
    gold = [(1, 1, "k", 0, 0, 2, [None, "x"], 1.0), (1, 1, "k", 1, 3, 5, None, 0.5), (1, None, "k", 2, 0, 2, ["x"], 1.0), (2, 1, "k", 0, 0, 2, ["x"], 1.0), (3, 1, "k", 0, 2, 2, ["x"], 1.0)]
    found = [(1, 1, "k", 0, 0, 2, "ab", "x"), (1, 1, "k", 1, 3, 5, "cd", None), (1, None, "k", 2, 0, 2, "ab", "x"), (2, 1, "k", 0, 0, 2, "ab", "x")]
    corrections, credits = score_corrections(spark.createDataFrame(gold, GOLD), spark.createDataFrame(found, PREDICTED), spark.createDataFrame([(1, 1, "k", text), (1, None, "k", text), (3, 1, "k", text)], SOURCES))
    assert {(r.case_id, r.gold_index): (r.kind, r.overlapping) for r in corrections.collect()} == {(1, 0): ("exact", True), (1, 1): ("unmatched", True), (1, 2): ("unmatched", False), (2, 0): ("unmatched", False), (3, 0): ("unmatched", False)}
    assert {(r.case_id, r.prediction_index): r.relaxed_credit for r in credits.collect()} == {(1, 0): 1.0, (1, 1): 0.0, (1, 2): 0.0, (2, 0): 0.0}


def test_expressions_have_one_normal_form(spark):
    from lumenspan.functions.text import normalize_expression, plain_expression

    texts = [" A\u00a0 b\t\n字 1 字", "ＧＰＴ 模 型 4", "ß\u2003x\x0b y", "\x1c a \x85 字 b", "", "é字 é a 字", "İstanbul 字 9 "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", normalize_expression(F.col("t")).alias("n")).collect()
    assert [(r.t, plain_expression(r.t)) for r in rows] == [(r.t, r.n) for r in rows]
