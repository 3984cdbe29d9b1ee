"""Bounds that columns of real tables may pass: many languages, long vectors, class numbers."""

import numpy as np
import pytest

from lumenspan.llm import embedding_join, language_id, ngram_join, repeats
from lumenspan.llm.queries import piece_model


def test_languages_beyond_the_bound_teach_nothing_and_every_document_is_predicted(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 2)
    texts = {"en": "the quick brown fox and the dog", "fr": "le renard et la belle dame du lac", "zz": "odd words"}
    rows = [(i, texts[lang], lang) for i, lang in enumerate(["en"] * 30 + ["fr"] * 20 + ["zz"] * 5)] + [(100 + i, "x y", f"dirty {i}") for i in range(40)] + [(200, None, "en")]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), piece_model()).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.lang_pred for r in got}
    assert all(by[i] == ("en" if i < 30 else "fr") for i in range(50)) and {by[i] for i in range(50, 55)} <= {"en", "fr"} and by[200] == "und"


@pytest.mark.parametrize("dim", [1_024, 4_096])
def test_long_vectors_link_as_in_double_precision(spark, dim):
    rng = np.random.default_rng(dim)
    base = rng.normal(size=dim)
    base /= np.linalg.norm(base)
    rows = []
    for i in range(60):  # cosines within a few millionths of the threshold, on either side
        other = rng.normal(size=dim)
        other -= (other @ base) * base
        other /= np.linalg.norm(other)
        c = 0.95 + (i - 29.5) * 2e-6
        rows.append((i + 1, (c * base + np.sqrt(1 - c * c) * other).tolist()))
    rows.append((0, base.tolist()))
    got = {r.vec_id: r.n_links for r in embedding_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = (x[:, None] * x[None]).sum(2) >= 0.95
    want = {i: int(linked[k].sum()) - 1 for k, (i, _) in enumerate(rows)}
    assert got == want and 0 < want[0] < 60
    assert embedding_join.near(64) == embedding_join.NEAR < embedding_join.near(4_096)


def test_repeated_and_null_ids_of_vectors(spark):
    a, b, c = [1.0, 0.0], [1.0, 0.1], [0.0, 1.0]
    rows = [(1, a), (1, c), (2, b), (3, c), (None, a), (4, None)]
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in embedding_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()), key=repr)
    assert got == sorted([(1, 2, 1), (1, 1, 1), (2, 2, 1), (3, 1, 1), (None, 2, 1), (4, 0, 4)], key=repr)


def test_an_index_of_many_parts_takes_little_more_than_its_entries():
    """With 6 GB there are hundreds of parts, and a part has an entry or two of a member: members must not be what fills the disk."""
    rng = np.random.default_rng(3)
    k = 400
    members = np.zeros(k, ngram_join.MEMBER)
    members["doc"], members["n"], members["required"] = 5_000_000 + np.arange(k), rng.integers(300, 800, k), rng.integers(60, 200, k)
    counts = rng.integers(1, 3, k)
    keys = rng.integers(0, 1 << 40, counts.sum()).astype(np.uint64)
    block = ngram_join.pack(members, counts, keys)
    assert len(block) <= 10.5 * len(keys)  # 12 bytes an entry and 16 a member before
    got = ngram_join.unpack(block)
    assert (got[0] == members).all() and (got[1] == keys).all() and (got[2] == np.repeat(np.arange(k), counts)).all()
    empty = ngram_join.unpack(ngram_join.pack(members[:1], np.array([0]), keys[:0]))
    assert len(empty[0]) == 1 and not len(empty[1])


def test_entries_of_a_member_that_look_alike_loosen_what_it_requires():
    members = np.zeros(3, ngram_join.MEMBER)
    members["required"] = [2 * 5 + 1, 2 * 1, 2 * 7]
    keys = np.array([1, 1, 1, 2, 4, 4, 1], np.uint64)
    got = ngram_join.loosened(members, keys, np.array([0, 0, 0, 0, 1, 1, 2]))
    assert got["required"].tolist() == [2 * 3 + 1, 2 * 1, 2 * 7] and members["required"][0] == 11


def test_links_hold_when_entries_carry_few_bytes(spark, monkeypatch):
    """Many entries then look alike, which may cost time but no link."""
    rng = np.random.default_rng(8)
    texts = []
    for _ in range(12):
        words = [f"w{x}" for x in rng.integers(0, 10_000, 90)]
        texts.append(" ".join(words))
        for _ in range(6):
            other = list(words)
            other[rng.integers(0, 90)] = "changed"
            texts.append(" ".join(other))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: i - i % 7 for i in range(len(texts))}
    for size in (5, 1):
        monkeypatch.setattr(ngram_join, "KEY_BYTES", size)
        assert {r.doc_id: r.component_id for r in ngram_join.near_groups(docs).collect()} == want


def test_blocks_of_places_grow_with_the_input_and_not_with_its_square(spark, monkeypatch):
    """More parts come with more input; a task then holds more before it packs a block for each part."""
    rng = np.random.default_rng(4)
    rows = [(i, "".join(map(chr, rng.integers(97, 123, 20_000))), i) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h long").coalesce(1)
    monkeypatch.setattr(repeats, "HELD_PLACES", 1)
    parts = 40  # 40 documents give about 50,000 places, fewer than 1,500 a part
    assert repeats._places(docs, parts).count() == parts
