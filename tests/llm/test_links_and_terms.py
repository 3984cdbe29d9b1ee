"""Links of families and terms near copies, where counts of entries or documents decide."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from lumenspan.llm import ngram_join, pii


def test_copies_of_passages_do_not_hide_a_disclosing_term(spark):
    rng = random.Random(6)
    words = lambda n: " ".join("".join(rng.choice("bcdfg") for _ in range(6)) for _ in range(n))
    passages = [f"{words(8)} quarry ann@mail.example {words(8)}" for _ in range(3)]
    texts = [p for p in passages for _ in range(30)] + [words(20) for _ in range(300)]
    # several contexts in one document are one document of the pair; alone, the entity counts too
    texts += [" ".join(f"{words(8)} harbour bob@mail.example {words(8)}" for _ in range(6))] + [f"{words(9)} harbour" for _ in range(5)] + ["bob@mail.example"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.find_base(docs)
    got = {r.term: r.disclosure for r in pii.disclosing(found, docs, generalise=-9.0).where("term in ('quarry', 'harbour')").collect()}
    n = len(texts)
    assert got["quarry"] == pytest.approx(1.0)
    assert got["harbour"] == pytest.approx(math.log2(1 * n / (6 * 2)) / math.log2(n / 2))


def test_a_link_whose_sets_require_different_numbers(spark):
    """12 of 16 shingles, all shared entries in large groups, as many as the smaller set requires and fewer than the larger does."""
    rng = random.Random(8)
    words = lambda n: ["".join(rng.choice("abcdefghijk") for _ in range(8)) for _ in range(n)]

    def signatures(text):
        s, m, _, band, required = ngram_join.entries(*ngram_join.Shingler().sets([" ".join(text)]))
        return next(((set(s[m == i].tolist()), int(required[i])) for i in range(len(band)) if band[i] == 4), (set(), 0))

    while True:
        small = words(16)
        large = small + words(4)
        (a, ra), (b, rb) = signatures(small), signatures(large)
        if not ra <= len(a & b) < rb:
            continue
        fillers = []
        for want in a & b:
            found = []
            for _ in range(1500):
                at = rng.randrange(12)
                text = words(4) + small[at : at + 5] + words(13)
                if signatures(text)[0] & (a | b) == {want}:
                    found.append(text)
                if len(found) == 6:
                    break
            fillers.append(found)
        if all(len(f) == 6 for f in fillers):
            break
    texts = [" ".join(t) for t in [small, large, *(t for f in fillers for t in f)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.near_groups(docs).collect()}
    assert got == {i: max(0, i - (i == 1)) for i in range(len(texts))}


def test_a_link_between_an_extension_and_its_base(spark):
    """Six variants keep all entries that base and extension share in large groups."""
    words = [f"w{i}" for i in range(150)]
    base = words[:100]
    texts = [base]
    for k in range(6):
        w = list(base)
        w[15 * k] = f"x{k}"
        texts.append(w)
    texts.append(words[:132])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.component_id for r in ngram_join.near_groups(docs).collect()} == {0}


def _components(sets):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("seed", range(3))
def test_families_larger_than_a_block(spark, monkeypatch, seed):
    """Copies at the edge of the similarity, extensions and chains of them, in families of many blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    texts = []
    for n in (40, 90):
        base = [word() for _ in range(n)]
        for _ in range(45):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(n)] = word()
            at = rng.randint(0, n // 4)
            texts.append(w[at:] + [word() for _ in range(rng.choice((0, 0, 1, n // 5, n // 4, n // 3)))])
        chain = list(base)
        for _ in range(12):
            chain = chain[n // 9 :] + [word() for _ in range(n // 9)]
            texts.append(chain)
    rng.shuffle(texts)
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.near_groups(docs).collect()}
    assert Counter(got.items()) == Counter(enumerate(_components(sets)))


def test_entries_leave_out_the_costliest_segments():
    rng = random.Random(31)
    words = lambda n: ["".join(rng.choice("abcdefghijk") for _ in range(8)) for _ in range(n)]
    base = words(200)
    changed = base[:]
    for at in (30, 31, 32, 90):
        changed[at] = words(1)[0]
    sets = ngram_join.Shingler().sets([" ".join(base), " ".join(changed)])
    every = ngram_join.entries(*sets, every=True)[0]
    costs = np.array([rng.randrange(1000) for _ in range(ngram_join.COST_BINS)])
    price = lambda s: costs[(s & np.uint64(ngram_join.COST_BINS - 1)).astype(int)]
    s, m, of, band, required = ngram_join.entries(*sets, costs=costs)
    for b in set(band.tolist()):
        a, c = (set(s[m == i].tolist()) for i in np.flatnonzero(band == b))
        assert len(a & c) >= required[band == b].min()
    left = np.setdiff1d(every, s)
    assert len(left) and price(left).mean() > price(s).mean()
    whole, member = ngram_join.entries(*sets, every=True)[:2]
    for i in np.flatnonzero(band == 8):
        out = np.setdiff1d(whole[member == i], s[m == i])
        assert len(out) and price(s[m == i]).max() <= price(out).min()


def test_linked_sets_share_the_entries_that_the_bound_promises():
    """Sets drawn from few segments of a band are short of entries, on one side or both."""
    rng = np.random.default_rng(11)
    lost = seen = 0
    pools = {}
    for m in (16, 27, 54):
        h = rng.integers(0, 2**64, 200_000, dtype=np.uint64)
        segment = (ngram_join._mix(h + np.uint64(0xA5A5A5)) >> np.uint64(33)).astype(np.int64) % m
        pools[m] = [h[segment == i] for i in range(m)]
    for _ in range(6000):
        m = int(rng.choice([16, 27, 54]))
        near = int(rng.integers(3, 65))
        some = rng.choice(m, int(rng.integers(1, 7)), replace=False)
        # one segment may hold nearly all elements
        share = rng.dirichlet(np.full(len(some), 0.3))
        common = np.unique(np.concatenate([rng.choice(pools[m][s], max(0, round(near * p))) for s, p in zip(some, share, strict=True)]))
        if not len(common):
            continue
        room = len(common) * 100 // 75 - len(common)
        left = int(rng.integers(0, room + 1))
        extra = lambda k: np.concatenate([pools[m][int(rng.choice(some))][-40:] for _ in range(3)])[rng.permutation(120)[:k]]
        x, y = np.unique(np.r_[common, extra(left)]), np.unique(np.r_[common, extra(room - left)])
        both, either = len(np.intersect1d(x, y)), len(np.union1d(x, y))
        if np.array_equal(x, y) or 100 * both < 75 * either:
            continue
        seen += 1
        s, member, of, band, required = ngram_join.entries(np.r_[x, y], np.array([0, len(x), len(x) + len(y)]))
        shares = 0
        for b in np.unique(band):
            a, c = np.flatnonzero((band == b) & (of == 0)), np.flatnonzero((band == b) & (of == 1))
            if len(a) and len(c):
                shares |= len(np.intersect1d(s[member == a[0]], s[member == c[0]])) >= min(required[a[0]], required[c[0]])
        lost += not shares
    assert seen > 2000 and lost == 0


def test_a_link_of_a_set_whose_shingles_fell_into_one_segment(spark):
    """Ten words with six shingles in one of sixteen segments, and the same with two words more."""
    rng = random.Random(1)
    segment = lambda words: {int(x) for x in (ngram_join._mix(ngram_join.Shingler().sets([" ".join(words)])[0] + np.uint64(0xA5A5A5)) >> np.uint64(33)).astype(np.int64) % 16}
    new = lambda: "".join(rng.choice("abcdefghijk") for _ in range(8))
    words = [new() for _ in range(5)]
    while len(words) < 10:  # word by word, as the chance of all at once is small
        more = [*words, new()]
        if len(segment(more)) == 1:
            words = more
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words, new(), new()])), (3, " ".join(new() for _ in range(12)))], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.near_groups(docs).collect()} == {1: 1, 2: 1, 3: 3}


def test_chance_neighbours_make_no_family(spark, monkeypatch):
    """Sets in a chain, each sharing one shingle with the next and one with all, and two near copies; no shingle looks rarer than others."""
    monkeypatch.setattr(ngram_join, "COUNT_BINS", 1)
    own = lambda i: [1_000 * (i + 1) + k for k in range(60)]
    sets = [[-900, -500 + i, -499 + i, *own(i)] for i in range(40)]
    sets.append([-900, -497, -496, 8, *own(3)[:-2]])
    rows = spark.createDataFrame(list(enumerate(sets)), "node long, set array<long>")
    assert {(r.node, r.family) for r in ngram_join._refined(rows, 75).collect()} == {(3, 3), (40, 3)}


@pytest.mark.parametrize("few,shared", [(2, 1), (4, 3), (3, 40)])
def test_families_however_many_shingles_must_be_shared(spark, monkeypatch, few, shared):
    for name, value in (("FEW", few), ("SHARED", shared), ("TASK_BLOCKS", 1), ("FAMILY_TASKS", 1), ("BLOCK_SHINGLES", 200)):
        monkeypatch.setattr(ngram_join, name, value)
    test_families_larger_than_a_block(spark, monkeypatch, few)


def test_a_family_is_not_sent_as_often_as_it_has_members(spark):
    """A family 12 times as large is sent to tasks as often a member, or hardly more."""
    rows = [(k, 400 * k, 924 * k, 394 * 400 * k) for k in (1, 12)]
    got = {r.family: (r.ni, r.nj) for r in ngram_join.family_blocks(spark.createDataFrame(rows, "family long, o long, n long, held long")).collect()}
    sent = {k: (400 * k * got[k][1] + 924 * k * got[k][0]) / (924 * k) for k in got}
    assert sent[12] <= 2 * sent[1] and sent[12] < 8
    assert got[12][0] * got[12][1] >= 400 * 924 * 144 / (ngram_join.BLOCK**2 * ngram_join.TASK_BLOCKS)
