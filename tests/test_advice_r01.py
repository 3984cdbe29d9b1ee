"""What the review of round 1 found left out."""

import random

import pytest

from lumenspan.functions.similarity import edit_counts, indel_ratio
from lumenspan.plans import registry


@pytest.fixture
def tables(spark, tmp_path):
    def add(name, data, schema):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    add("embeddings", [(i, i, [1.0, float(i)]) for i in range(4)], "vec_id long, label int, embedding array<float>")
    return add


DOCUMENTS = "doc_id long, text string, n_chars long"


def test_the_lexical_lane_ranks_documents_of_all_ids(spark, tables):
    path = tables("documents", [(50, "the best of all", 15), (100_000, "best", 4), (9_000_000_000, "a guest", 7), (60, "none", 4)], DOCUMENTS)
    got = [r.chunk_id for r in registry.queries()["rrf_fusion"](spark, path).where("match_type = 'lexical'").collect()]
    assert got == [100_000, 9_000_000_000, 50]


def plain_edits(a, b):
    """Substitutions, deletions, insertions by the table of all cells, a substitution before a deletion before an insertion."""
    above = [(j, 0, 0, j) for j in range(len(b) + 1)]
    for i, r in enumerate(a, 1):
        row = [(i, 0, i, 0)]
        for j, h in enumerate(b, 1):
            (c, s, d, n), (c1, s1, d1, n1), (c2, s2, d2, n2) = above[j - 1], above[j], row[j - 1]
            best = (c + (r != h), s + (r != h), d, n)
            if r != h:
                best = min(best, (c1 + 1, s1, d1 + 1, n1), (c2 + 1, s2, d2, n2 + 1), key=lambda x: x[0])
            row.append(best)
        above = row
    return above[-1][1:]


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_edits_and_ratio_equal_the_whole_table():
    rng = random.Random(3)
    for _ in range(1500):
        a, b = ("".join(rng.choice("abé字"[: rng.randint(1, 4)]) for _ in range(rng.randint(0, 40))) for _ in "ab")
        assert edit_counts(list(a), list(b)) == plain_edits(a, b)
        assert indel_ratio(a, b) == (200.0 * plain_common(a, b) / (len(a) + len(b)) if a or b else 100.0)


def test_distances_are_of_whole_turns_with_all_characters(spark, tables):
    rng = random.Random(4)
    same = "x" * 60
    turns = [same + "abc", same + "abd" + "y" * 200, "žluťoučký 字 kůň", "zlutoucky kun", "".join(rng.choice("ab c字") for _ in range(700)), "", "é"]
    path = tables("conversations", [(1, i, t) for i, t in enumerate(turns)] + [(2, 0, "字幕"), (2, 1, "字")], "conv_id long, turn int, text string")
    pairs = [(1, i, a, b) for i, (b, a) in enumerate(zip(turns, turns[1:]), 1)] + [(2, 1, "字", "字幕")]
    run = lambda name: sorted(map(tuple, registry.queries()[name](spark, path).collect()))
    e = {(c, t): sum(plain_edits(a, b)) for c, t, a, b in pairs}
    assert run("edit_operations") == [(c, t, e[c, t], len(a) - len(b)) for c, t, a, b in pairs]
    assert run("edit_guard") == [(c, t, e[c, t] / max(1, len(a)) <= 0.8) for c, t, a, b in pairs]
    assert run("rows_only_indel_ratio") == [(c, t, round(200 * plain_common(a, b) / (len(a) + len(b)), 6)) for c, t, a, b in pairs]
    some = {k: [(e[c, t], len(a)) for c, t, a, b in pairs if c == k and a] for k in (1, 2)}
    want = [(k, round(sum(x for x, _ in v) / sum(n for _, n in v), 9), round(sum(x / n for x, n in v) / len(v), 9)) for k, v in some.items()]
    assert run("cer_micro_macro") == [pytest.approx(x) for x in want]


def test_a_protected_hit_holds_the_whole_passage(spark, tables):
    opening = "a benchmark passage that begins with the same words "
    tables("benchmark", [(1, opening + "and ends so")], "item_id long, text string")
    path = tables("documents", [(70, opening + "but goes on otherwise", 80), (80, f"see: {opening}and ends so.", 80)], DOCUMENTS)
    got = [r.chunk_id for r in registry.queries()["protected_retention"](spark, path).where("appended = 1").collect()]
    assert got == [80]
