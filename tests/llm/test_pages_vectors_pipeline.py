import hashlib
from collections import Counter

import numpy as np
import pytest

from lumenspan.llm import embedding_join, warc
from lumenspan.llm.common import components, new_path


def test_warc_round_trip(spark):
    big = "x" * 2000
    rows = [(1, "http://a/1", big), (2, None, big), (3, "http://a/3", big), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", "")]
    rows += [(8, "u v\nw", "é" * 600), (9, "u", "é" * 600), (10, "u", "\r\n\r\n" + "y" * 999), (11, "u", "z" * 3_000_000)]
    rows += [(12, "u", "q" * 1500)] * 2 + [(None, "u", "n" * 1200), (None, "u", None)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    last = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if i is not None:
            last[b] = max(last.get(b, i), i)
    want = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        old = len(b) >= 1000 and b in last and last[b] != i
        want[(i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if old else "response", last[b] if old else None)] += 1
    assert Counter(map(tuple, warc.round_trip(pages, split_bytes=300).collect())) == want


def test_reader_owns_each_record_once_and_ignores_chance_magic(spark, tmp_path):
    rng = np.random.default_rng(0)
    noise = [bytes(rng.integers(0, 256, 3000, dtype=np.uint8)).replace(b"ab", warc.MAGIC) + warc.MAGIC * 50 for _ in range(30)]
    rows = [(i, None, bytearray(n), hashlib.sha1(n).hexdigest(), None) for i, n in enumerate(noise)]
    plan = spark.createDataFrame(rows, "page_id long, url string, payload binary, digest string, refers_to long")
    path = new_path(spark, "warc-test")
    files = warc.write_archives(plan, path)
    for split in (64, 1000, 1 << 20):
        got = warc.read_archives(spark, files, path, split).collect()
        assert sorted(r.page_id for r in got) == list(range(30))
        assert all(r.payload_digest == r.stated_digest == hashlib.sha1(noise[r.page_id]).hexdigest() for r in got)
        assert all(bytes(r.payload) == noise[r.page_id] for r in got)


def test_warc_of_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def brute_vectors(rows):
    x = []
    for _, v in rows:
        ok = v and None not in v and np.isfinite(v).all() and np.any(v)
        x.append(np.array(v, float) / np.abs(v).max() if ok else None)
    n = len(rows)
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and x[i] is not None and x[j] is not None and len(x[i]) == len(x[j]):
                link[i, j] = x[i] @ x[j] / (np.linalg.norm(x[i]) * np.linalg.norm(x[j])) >= 0.95
    root = np.arange(n)
    for _ in range(n):
        root = np.minimum(root, np.where(link, root[None, :], n).min(1))
    out = []
    for i in range(n):
        low = min(rows[j][0] for j in range(n) if root[j] == root[i])
        out.append((rows[i][0], int(link[i].sum()), low, low == rows[i][0]))
    return out


@pytest.mark.parametrize("part", [8, 4096])
def test_embedding_join(spark, monkeypatch, part):
    monkeypatch.setattr(embedding_join, "PART", part)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + rng.normal(size=8) * rng.choice([0.02, 0.15, 0.5])).tolist()) for i in range(90)]
    rows += [(200, rows[0][1]), (201, rows[0][1]), (202, [0.0] * 8), (203, None), (204, [float("nan")] + [1.0] * 7), (205, [None] + [1.0] * 7)]
    rows += [(206, []), (207, [1.0, 2.0]), (208, [1.0, 2.1]), (209, [float("inf")] * 8), (210, [x * 1e200 for x in rows[1][1]])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, n_links int")
    assert sorted(map(tuple, embedding_join.near_vectors(df).collect())) == sorted(brute_vectors(rows))
    empty = spark.createDataFrame([], df.schema)
    assert embedding_join.near_vectors(empty).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(50)] + [(7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(51)}


def test_pipeline_stages(spark, odd_docs, tmp_path):
    import corpus_pipeline

    odd_docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    before = [r.asDict() for r in docs.collect()]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        path = str(tmp_path / f"out{n}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if n < 4:
            assert docs.columns == odd_docs.columns
        now = [r.asDict() for r in docs.collect()]
        if n == 0:
            assert not any((r["text"] or "").strip() == "" or r["doc_id"] == 303 for r in now)
            assert {r["doc_id"] for r in before if r["doc_id"] and r["doc_id"] < 300} <= {r["doc_id"] for r in now}
        if n == 1:
            assert len({r["text"] for r in now}) == len(now) == len({r["text"] for r in before})
        before = now
    assert len(before) > 20 and all(r["n_tokens"] > 0 for r in before)
