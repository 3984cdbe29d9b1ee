import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from lumenspan.llm import exact_dedup, language_id, mixing, ngram_join, pii, quality, repeats
from lumenspan.llm.sentencepiece_bpe import encode_decode

MODEL = str(public_tokenizers.path("piece_bpe_32k.model"))


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_exact_dedup(odd_docs):
    groups = defaultdict(list)
    for r in odd_docs.collect():
        groups[r.text or ""].append(r.doc_id)
    want = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    assert Counter(rows_of(exact_dedup.exact_dedup(odd_docs))) == Counter(want)


def test_drop_copies_keeps_one_row_of_each_text(odd_docs):
    left = exact_dedup.drop_copies(odd_docs)
    assert left.columns == odd_docs.columns
    texts = [r.text or "" for r in left.collect()]
    assert len(texts) == len(set(texts)) == len({r.text or "" for r in odd_docs.collect()})


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), set(order), {}
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > most * sizes[s]}
        if not over:
            return out | {s: left * w[s] / total for s in free}
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(most * sizes[s] for s in over)
        free -= over
    return out


def test_mixing(odd_docs):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = Counter()
    for r in odd_docs.collect():
        total[r.source] += size(r.text)
    goal = targets(dict(total))
    got = mixing.mix(odd_docs)
    taken = Counter()
    rows = got.collect()
    for r in rows:
        assert r.source_size == total[r.source] and r.target == pytest.approx(goal[r.source])
        assert r["size"] == 0 and r.taken == 0 or r.taken in (0, r["size"], 2 * r["size"])
        taken[r.source] += r.taken
    assert Counter((r.doc_id, r["size"]) for r in rows) == Counter((r.doc_id, size(r.text)) for r in odd_docs.collect())
    largest = {s: max(r["size"] for r in rows if r.source == s) for s in total}
    for s in total:
        assert abs(taken[s] - goal[s]) <= 2 * largest[s]
    assert sum(taken.values()) <= sum(goal.values()) + 1e-6
    assert Counter(map(tuple, mixing.mix(odd_docs).collect())) == Counter(map(tuple, rows))


def test_the_mix_is_a_prefix_of_the_line(odd_docs):
    """The whole line by brute force: every pass of every row, sorted by finish time, until the budget would be exceeded."""
    rows = [(r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in odd_docs.collect()]
    total = Counter()
    for _, s, n in rows:
        total[s] += n
    goal = targets(dict(total))
    key = lambda d: int(hashlib.md5(f"7:{'' if d is None else d}".encode()).hexdigest()[:15], 16)
    line = []
    for s in total:
        done = 0
        for d, _, n in sorted((r for r in rows if r[1] == s), key=lambda r: (key(r[0]), r[0] is not None, r[0] or 0, r[2])):
            done += n
            if n:
                line += [((done + e * total[s]) / goal[s], s is None, s or "", e, d, n) for e in (0, 1)]
    used, taken = 0, Counter()
    for _, _, _, _, d, n in sorted(line, key=lambda x: x[:4]):
        used += n
        if used > sum(goal.values()):
            break
        taken[d, n] += n
    got = Counter()
    for r in mixing.mix(odd_docs).collect():
        got[r.doc_id, r["size"]] += r.taken
    assert +got == taken


def test_mixed_rows_stand_in_the_order_of_the_line(odd_docs):
    rows = [(r.doc_id, r.source) for r in mixing.mixed(odd_docs).collect()]
    seen = {}
    for d, s in rows:
        seen.setdefault(s, []).append(d)
    key = lambda d: int(hashlib.md5(f"7:{'' if d is None else d}".encode()).hexdigest()[:15], 16)
    for own in seen.values():
        falls = sum(key(a) > key(b) for a, b in zip(own, own[1:], strict=False))
        assert falls <= 1  # one where the second pass begins
    assert len({s for _, s in rows[: len(rows) // 4]}) == len(seen)


def test_mixed_repeats_rows(odd_docs):
    out = mixing.mixed(odd_docs)
    assert out.columns == odd_docs.columns
    words = sum(len((r.text or "").split()) for r in out.collect())
    assert words == mixing.mix(odd_docs).groupBy().sum("taken").first()[0]


def test_a_mix_of_equal_rows(spark):
    """A third of all rows share id and size: the last pass takes some of them, and no more."""
    docs = spark.createDataFrame([(7, "one two three", "a")] * 40 + [(i, "one two", "b") for i in range(100, 180)], "doc_id long, text string, source string")
    taken = Counter()
    for r in mixing.mix(docs).collect():
        taken[r.doc_id == 7] += r.taken
    out = Counter()
    for r in mixing.mixed(docs).collect():
        out[r.doc_id == 7] += len(r.text.split())
    assert out == taken


def test_sentencepiece_matches_the_library(odd_docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = Counter()
    for r in odd_docs.collect():
        ids = sp.encode(r.text or "")
        want[(r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())] += 1
    assert Counter(rows_of(encode_decode(odd_docs, MODEL))) == want


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    """Component of each row's index; rows sharing an id are one document."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            same = rows[i][0] is not None and rows[i][0] == rows[j][0]
            if same or common and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                if rows[i][0] is None or rows[j][0] is None:
                    if sets[i] != sets[j]:
                        continue
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [(d, len(sets[i]), low.get(find(i))) for i, (d, _) in enumerate(rows)]


def test_ngram_join(odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert Counter(rows_of(ngram_join.near_groups(odd_docs))) == Counter(brute_components(rows))


def test_ngram_join_of_a_large_group_and_a_shared_passage(spark):
    import random

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base, passage = [word() for _ in range(60)], [word() for _ in range(30)]
    rows = []
    for i in range(60):  # near copies of one text, some too far from the others
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(60)] = word()
        rows.append((1000 + i, " ".join(w)))
    rows += [(i, " ".join(passage + [word() for _ in range(rng.randint(2, 12))])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(rows_of(ngram_join.near_groups(docs))) == Counter(brute_components(rows))


def brute_repeats(rows):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        if d is not None:
            for i in range(len(b) - 49):
                w = b[i : i + 50]
                first[w] = min(first.get(w, d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        if d is not None:
            for i in range(len(b) - 49):
                if first[b[i : i + 50]] < d:
                    gone[i : i + 50] = b"\1" * 50
        spans = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats(odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert Counter(rows_of(repeats.remove_repeats(odd_docs))) == Counter(brute_repeats(rows))


def test_matching_statistics_equal_brute_force():
    import random

    rng = random.Random(5)
    for letters, most in ((b"ab", 40), (b"abcd", 120), (b"z", 90), (bytes(range(1, 255)), 60)):
        make = lambda: bytes(rng.choice(letters) for _ in range(rng.randint(1, most)))  # noqa: B023, E731
        held = [(g, make()) for g in range(4) for _ in range(rng.randint(1, 6))]
        asked = [(g, make()) for g in range(4) for _ in range(5)]
        asked += [(g, t[3:] + t[:9]) for g, t in held if len(t) > 3] + [((g + 1) % 4, t) for g, t in held]
        index = repeats.RunLengthIndex([t for _, t in held], np.array([g for g, _ in held]))
        text, got = b"\xff".join(t for _, t in held), {}
        for which, at, length, sample in index.statistics([t for _, t in asked], np.array([g for g, _ in asked])):
            for i, w, n, p in zip(which.tolist(), at.tolist(), length.tolist(), sample.tolist(), strict=True):
                got[i, w] = min(n, repeats.REACH)
                n = min(n, repeats.REACH)
                assert text[p : p + n] == asked[i][1][w : w + n]
        for i, (g, t) in enumerate(asked):
            for w in range(len(t)):
                most_here = max(n for h, own in held if h == g for n in range(len(t) - w + 1) if t[w : w + n] in own)
                assert got[i, w] == min(most_here, repeats.REACH)


@pytest.mark.parametrize("at_once", [1, 900, 1 << 20])
def test_levels_find_what_smaller_documents_hold(at_once, monkeypatch):
    import random

    monkeypatch.setattr(repeats, "INDEX_BYTES", at_once)
    rng = random.Random(6)
    parts = [bytes(rng.choice(b"abcdefgh") for _ in range(70)) for _ in range(6)]
    strings = list({rng.choice(parts)[rng.randint(0, 25) :] + bytes(rng.choice(b"xyz") for _ in range(rng.randint(0, 9))) for _ in range(80)})
    cells = np.array([rng.randint(0, 2) for _ in strings], np.uint64)
    docs = np.array([rng.randint(0, 30) for _ in strings])
    want = {
        (i, w) for i, s in enumerate(strings) for w in range(len(s) - 49)
        if any(cells[j] == cells[i] and docs[j] < docs[i] and s[w : w + 50] in t for j, t in enumerate(strings))
    }
    assert set(zip(*[x.tolist() for x in repeats.earlier(strings, cells, docs)], strict=True)) == want


def test_strings_that_are_wholly_found_are_not_searched_again(monkeypatch):
    """Of a passage in 256 documents half are found at the first of eight levels, and half of the rest at each level after it."""
    passage = bytes(97 + i * i % 23 for i in range(70))
    strings = [passage[i % 9 :] for i in range(256)]
    asked, plain = [], repeats.RunLengthIndex.statistics
    monkeypatch.setattr(repeats.RunLengthIndex, "statistics", lambda self, own, groups: asked.append(len(own)) or plain(self, own, groups))
    got = set(zip(*[x.tolist() for x in repeats.earlier(strings, np.zeros(256, np.uint64), np.arange(256))], strict=True))
    assert got == {(i, w) for i, x in enumerate(strings) for w in range(len(x) - 49) if i} and sum(asked) == 255


def test_repeats_in_hot_cells_and_periodic_texts(spark, monkeypatch):
    import random

    monkeypatch.setattr(repeats, "HOT_PLACES", 4)
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdef ") for _ in range(n))
    passage = word(130)
    rows = [(i, word(rng.randint(0, 90)) + passage[rng.randint(0, 60) :] + word(rng.randint(0, 90))) for i in range(40)]
    rows += [(50 + i, "ab" * rng.randint(20, 200)) for i in range(5)] + [(60 + i, "z" * (48 + i)) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(rows_of(repeats.remove_repeats(docs))) == Counter(brute_repeats(rows))


PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]


def test_base_spans_match_the_patterns():
    import random

    rng = random.Random(1)
    for _ in range(20_000):
        t = "".join(rng.choice("a.@-+1234567890 ().é%_0") for _ in range(rng.randint(0, 40)))
        want = []
        for k, p in enumerate(PATTERNS):
            for m in re.finditer(p, t):
                d = re.sub("[^0-9]", "", m[0])
                if k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split(".")) or k == 2 and 12 <= len(d) <= 19 and pii.luhn(d) or k == 3 and 9 <= len(d) <= 15:
                    want.append((m.start(), k, m.end()))
        assert pii.base_spans(t) == sorted(want)


def test_terms_that_disclose_an_entity(spark):
    import random

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("klmnopqrst") for _ in range(6))
    rows = [(i, " ".join(word() for _ in range(30))) for i in range(200)]
    rows += [(300 + i, f"{word()} {word()} Zarathustra wrote ann@mail.example.com {word()} é {word()}") for i in range(6)]
    rows += [(400, "Zarathustra alone"), (401, None), (402, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_pii(docs, "doc_id", "text").collect()}
    at = rows[200][1].index("Zarathustra")
    assert f"term:{at}:{at + 11}" in got[300].spans and got[300].n_email == 1
    assert got[400].spans == "" and got[401].spans == "" and got[0].spans == ""
    text = pii.sanitise(docs).where("doc_id = 300").first().text
    assert "ann@" not in text and "Zarathustra" not in text and "[EMAIL]" in text


def test_pii_of_odd_rows(odd_docs):
    got = pii.find_pii(odd_docs)
    assert got.count() == odd_docs.count()


def test_language_id(spark):
    import random

    rng = random.Random(3)
    kinds = {"aa": ["la", "le", "ro", "mi"], "bb": ["sch", "und", "ker", "zu"]}
    rows = []
    for i in range(240):
        lang = rng.choice(list(kinds))
        rows.append((i, " ".join("".join(rng.choice(kinds[lang]) for _ in range(rng.randint(1, 3))) for _ in range(12)), lang))
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "12 !?", None), (None, "lalero", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(docs, MODEL).collect()}
    truth = {i: lang for i, _, lang in rows}
    held = [i for i, r in got.items() if r.held_out and i is not None and i < 900]
    assert held and all(got[i].lang_pred == truth[i] for i in held)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert got[None].lang_pred == "aa" and all(0 <= r.score <= 1 for r in got.values())


def test_forward_sums_all_segmentations():
    import numpy as np

    pieces = ["a", "ab", "abc", "b", "bc", "c"]
    p = np.array([[0.3], [0.2], [0.1], [0.15], [0.05], [0.1], [0.1]])
    s = language_id.Scorer(pieces, 3, np.log(p))
    whole = 0.1 + 0.3 * 0.05 + 0.2 * 0.1 + 0.3 * 0.15 * 0.1
    assert np.exp(s.score_words(["abc"]))[0, 0] == pytest.approx(whole)
    assert np.exp(s.score_words(["x"]))[0, 0] == pytest.approx(0.1)


def test_forward_sums_of_long_words():
    """Words longer than PLAIN, also beyond what plain numbers can hold, against sums by exact fractions."""
    import math
    from fractions import Fraction

    import numpy as np

    pieces = ["a", "ab", "abc", "b", "bc", "c"]
    p = [Fraction(3, 10), Fraction(1, 5), Fraction(1, 10), Fraction(3, 20), Fraction(1, 20), Fraction(1, 10), Fraction(1, 10)]
    s = language_id.Scorer(pieces, 3, np.log(np.array([[float(x)] for x in p])))
    for n in (5, 11, 40, 900):
        word = "abcxb"[: n % 5] + "abcxb" * (n // 5)
        sums = [Fraction(1)]
        for j in range(1, len(word) + 1):
            sums.append(sum(sums[j - k] * p[pieces.index(word[j - k : j])] for k in (1, 2, 3) if k <= j and word[j - k : j] in pieces) + (sums[j - 1] * p[6] if word[j - 1] == "x" else 0))
        want = math.log(sums[-1].numerator) - math.log(sums[-1].denominator)
        assert s.score_words([word, "ab"])[0, 0] == pytest.approx(want)
        counts = s.expected([word], np.array([2.0]), 0)
        letters = {**{i: len(x) for i, x in enumerate(pieces)}, 6: 1}
        assert sum(counts[i] * k for i, k in letters.items()) == pytest.approx(2 * len(word))


def test_language_of_texts_without_letters_and_with_long_runs(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("lalero mi la", "aa"), ("schund zu ker", "bb")] * 30)]
    rows += [(100, "² ½ Ⅷ 3", None), (101, "la" * 30_000, None), (102, "schund" * 5_000, None)] + [(103, "zu ker", None)] * 2
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, score string")
    got = language_id.identify(docs, MODEL).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and by[100].lang_pred == "und" and by[100].score == 0
    assert [by[i].lang_pred for i in (101, 102, 103)] == ["aa", "bb", "bb"]


def test_quality(spark):
    import random

    rng = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.6
        words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(40)]
        rows.append((i, " ".join(words) + "." if good else " ".join(w + "$$$" for w in words)))
        labels.append((i, int(good)))
    rows += [(500, None), (501, ""), (502, "x" * 9999)]
    labels += [(3, None), (None, 1), (999, 1)]
    rows += [(503, "one two three " * 4_000)] * 2 + [(3, rows[4][1]), (None, rows[4][1])]
    docs = spark.createDataFrame([(*r, "c", "c", "c") for r in rows], "doc_id long, text string, score string, x string, y string")
    found = quality.score_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(found) == len(rows) and len({r.score for r in found if r.doc_id == 503}) == 1
    assert {r.score for r in found if r.doc_id is None} == {r.score for r in found if r.doc_id == 4} <= {r.score for r in found if r.doc_id == 3}
    order = sorted((r.ridge_score, r.score) for r in found)
    assert all(a[1] <= b[1] for a, b in zip(order, order[1:], strict=False))  # the fit never falls
    got = {r.doc_id: r for r in found}
    held = [(got[i].predicted, y) for i, y in labels[:400] if got[i].held_out]
    assert held and sum(a == b for a, b in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in found)


def test_isotonic():
    import numpy as np

    assert quality.isotonic(np.array([0.0, 1.0, 0.0, 1.0]), np.ones(4)).tolist() == [0.0, 0.5, 0.5, 1.0]


def test_empty_tables(spark, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for df in (
        exact_dedup.exact_dedup(no_docs), exact_dedup.drop_copies(no_docs), mixing.mix(no_docs), mixing.mixed(no_docs), encode_decode(no_docs, MODEL),
        ngram_join.near_groups(no_docs), ngram_join.drop_near_copies(no_docs), repeats.remove_repeats(no_docs), pii.find_pii(no_docs),
        language_id.identify(no_docs, MODEL), quality.score_quality(no_docs, labels),
    ):
        assert df.count() == 0
