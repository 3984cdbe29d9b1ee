import duckdb
import pytest
from pyspark.sql import functions as F

from lumenspan.operators import evaluation as E
from lumenspan.operators import joins as J
from lumenspan.operators import retrieval as R
from lumenspan.operators import state as S
from lumenspan.plans import registry
from lumenspan.sources import artifacts
from lumenspan.streaming import projections as P

SF = "/root/testdata/sf0.001"


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_fusion_prefers_overlap_and_normalises_lexical_weight(spark):
    lane = lambda ids: spark.createDataFrame([(x, i + 1, 1.0) for i, x in enumerate(ids)], "chunk_id string, rank long, score double")
    out = R.fuse([lane("ab")], [lane("bc")], 10)
    assert [(r.chunk_id, r.match_type) for r in out.collect()] == [("b", "hybrid"), ("a", "vector"), ("c", "lexical")]
    once, twice = R.fuse([lane("a")], [lane("b")], 10).collect(), R.fuse([lane("a")], [lane("b"), lane("b")], 10).collect()
    assert [r.score for r in once] == pytest.approx([r.score for r in twice])


def test_merge_in_rank_order_is_not_transitive(spark):
    data = [(1, 1, 100, 300, "a\nb", "vector"), (1, 2, 250, 400, "b\nc", "lexical"), (1, 3, 500, 600, "d", "vector"), (1, 4, 390, 510, "e", "vector"), (2, 1, 0, 9, "x", "vector")]
    df = spark.createDataFrame(data, "recording_id long, rank long, start_ms long, end_ms long, text string, match_type string")
    got = rows(R.merge_in_rank_order(df), "recording_id", "first_rank")
    assert got == [(1, 1, 100, 510, "a\nb\nc\ne", "hybrid", 3), (1, 3, 500, 600, "d", "vector", 1), (2, 1, 0, 9, "x", "vector", 1)]


def test_rerank_order_and_budget(spark):
    df = spark.createDataFrame([("a", 1, None, 5), ("b", 2, 0.5, 5), ("c", 3, 0.9, 5)], "chunk_id string, rank long, rerank_score double, n long")
    assert [r.chunk_id for r in R.rerank_order(df).orderBy("index").collect()] == ["c", "b", "a"]
    of_one = df.withColumn("q", F.lit(1))
    assert R.budget_prefix(of_one, "n", 12, ["rank"], "q").count() == 2 and R.budget_prefix(of_one.unionByName(of_one.withColumn("q", F.lit(2))), "n", 5, ["rank"], "q", least=5).count() == 2


def test_a_lane_that_fails_is_empty(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 0.5)], "chunk_id string, rank long, score double")
    lane, error = R.tried_lane(lambda: rows, f"file://{tmp_path}/good")
    assert error is None and lane.count() == 1
    for i, build in enumerate([lambda: rows.withColumn("score", F.raise_error(F.lit("damaged")).cast("double")), lambda: spark.read.parquet(f"file://{tmp_path}/nowhere"), lambda: rows.select("none")]):
        lane, error = R.tried_lane(build, f"file://{tmp_path}/bad{i}")
        assert lane is None and error
    with pytest.raises(RuntimeError):
        R.search([lane], [lane])
    assert R.search([lane], [rows]).first().score == pytest.approx(0.1 / 61)


def test_a_lane_over_damaged_files_fails_alone(spark, tmp_path):
    spark.range(100).selectExpr("cast(id as string) as chunk_id", "id as rank", "0.5D as score").write.parquet(f"file://{tmp_path}/index")
    for part in (tmp_path / "index").glob("part-*"):
        body = part.read_bytes()
        part.write_bytes(body[:4] + b"\xff" * 50 + body[54:])
        part.with_name(f".{part.name}.crc").unlink()
    lane, error = R.tried_lane(lambda: spark.read.parquet(f"file://{tmp_path}/index"), f"file://{tmp_path}/lane")
    assert lane is None and "SparkException" in error


def test_failed_lanes_with_empty_texts_and_nulls(spark, tmp_path):
    rows = [(i, None if i % 7 == 6 else i % 5) for i in range(15)]
    spark.createDataFrame(rows, "doc_id long, n_chars long").repartition(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(registry.oracle_sql()["failed_lanes"]).fetchall()
    got = registry.queries()["failed_lanes"](spark, str(tmp_path)).collect()
    assert sorted(want) == sorted((r.failed, r.chunk_id, r.score) for r in got) and len(want) == 30


def test_interval_join_gives_each_pair_once(spark):
    a = spark.createDataFrame([(1, 0, 200_000), (1, 190_000, 191_000), (2, 0, 5)], "k long, start_ms long, end_ms long")
    assert J.interval_join(a, a, "k").count() == 5


def test_nearest_and_argmax(spark):
    turns = spark.createDataFrame([(1, 0, 1000, "x"), (1, 1000, 1200, "y"), (1, 5000, 6000, "z")], "k long, start_ms long, end_ms long, who string")
    points = spark.createDataFrame([(1, 500), (1, 3000), (1, 5000)], "k long, point_ms long")
    assert [r.r_who for r in J.nearest(points, turns, "k", ["k", "point_ms"]).orderBy("point_ms").collect()] == ["x", "y", "z"]
    tokens = spark.createDataFrame([(1, 1, 100, 900), (1, 2, 900, 1150), (1, 3, 2000, 2100)], "k long, t long, start_ms long, end_ms long")
    got = J.argmax_overlap(tokens, turns, "k", ["k", "t"]).orderBy("t").collect()
    assert [(r.t, r.r_who, r.status) for r in got] == [(1, "x", "matched"), (2, "y", "ambiguous")]


def test_rank_metrics_count_gold_once(spark):
    gold = spark.createDataFrame([(1, 10, 3), (1, 11, 2)], "case_id long, evidence_id long, relevance int")
    hits = [(1, 2, 10, 3, "c", True), (1, 3, 10, 3, "c", True), (1, 4, 11, 2, "c", True)]
    m = spark.createDataFrame(hits, "case_id long, rank long, evidence_id long, relevance int, kind string, primary boolean")
    r = E.rank_metrics(m, gold).first()
    assert (r.hit_at_1, r.hit_at_5, r.recall_at_5, r.reciprocal_rank) == (0.0, 1.0, 1.0, 0.5)
    import math

    dcg = 7 / math.log2(3) + 3 / math.log2(5)
    assert r.ndcg_at_10 == pytest.approx(dcg / (7 / math.log2(2) + 3 / math.log2(3)))


def test_loss_journeys(spark):
    stages = [(1, 1, i, s) for i, s in enumerate(["hit", "hit", "hit", "miss"])] + [(1, 2, i, s) for i, s in enumerate(["miss", "skipped", "unknown", "hit"])]
    stages += [(1, 3, i, s) for i, s in enumerate(["hit", "unknown", "miss", "skipped"])]
    got = rows(E.loss_journeys(spark.createDataFrame(stages, "case_id int, evidence_id int, stage int, status string")), "evidence_id")
    assert got == [(1, 1, False, 2, "3"), (1, 2, True, 3, None), (1, 3, False, 0, "unknown")]


def test_splits_keep_groups_and_permissions(spark):
    data = [(f"g{i % 40}", i % 40 != 3, i % 40 != 5) for i in range(400)]
    out = dict(rows(E.assign_splits(spark.createDataFrame(data, "g string, train_allowed boolean, evaluation_allowed boolean"), "g")))
    assert len(out) == 40 and out["g3"] != "train" and out["g5"] == "train"


def test_gate_and_answer_score(spark):
    pairs = spark.createDataFrame([("answer", "abstain"), ("abstain", "answer")], "expected string, actual string")
    assert rows(E.gate_metrics(pairs)) == [(0.0, 1.0, 1.0)]
    score = E.answer_score(F.col("expected"), F.col("actual"), F.lit(1.0), F.lit(1.0), F.lit(1), F.lit(0))
    both = spark.createDataFrame([("answer", "answer"), ("abstain", "abstain"), ("abstain", "answer")], "expected string, actual string")
    assert [r[0] for r in both.select(score).collect()] == [85.0, 100.0, 0.0]


def test_state_operators(spark):
    e = spark.createDataFrame([(1, 1, None, "x"), (1, 2, 5, None), (1, 3, 6, "y")], "k long, seq long, a long, b string")
    assert rows(S.first_write_merge(e, "k", "seq", ["a", "b"])) == [(1, 5, "x")]
    assert rows(J.latest(e.select("k", "seq"), ["k"], ["seq"])) == [(1, 3)]
    t = S.transition(spark.createDataFrame([("draft", 1), ("draft", 2), ("done", 1)], "status string, revision int"), "status", "revision", F.lit(1), {"draft": "reviewed"})
    assert [r.new_status for r in t.collect()] == ["reviewed", "draft", "done"]


def test_artifacts(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, t string")
    path = artifacts.write_artifact(df, str(tmp_path), artifacts.fingerprint("s", "1", "{}", ["b", "a"]))
    assert artifacts.fingerprint("s", "1", "{}", ["a", "b"]) in path
    assert rows(artifacts.read_artifact(spark, path, "id long, t string"), "id") == [(1, "a"), (2, None)]
    assert artifacts.set_checksum(df) == artifacts.set_checksum(df.orderBy(F.desc("id")))
    with pytest.raises(Exception, match="exists"):
        artifacts.write_artifact(df, str(tmp_path), path.rsplit("/", 1)[1])


def test_streams_equal_batches(spark, tmp_path):
    events = [("a", "running", 1), ("a", "succeeded", 3), ("a", "failed", 4), ("b", "running", 2), ("b", "running", 1)]
    spark.createDataFrame(events, "key string, status string, version long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, status string, version long").parquet(str(tmp_path / "in"))
    q = P.project_first_terminal(stream).writeStream.format("memory").queryName("projected").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.key: (r.status, r.version) for r in spark.table("projected").collect()} == {"a": ("succeeded", 3), "b": ("running", 2)}


def test_window_counts_stream(spark, tmp_path):
    stream = spark.readStream.schema(spark.read.parquet(f"{SF}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(SF)
    q = P.windowed_counts(stream).writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{SF}/events.parquet").count()


@pytest.mark.parametrize("name", ["vector_topk", "rrf_fusion", "interval_overlap_join", "token_p90_by_operation", "outbox_head_of_line", "rank_metrics", "split_assignment", "speaker_merge_fold",
    "restored_tokens", "assembled_turns", "document_sections", "document_search_texts", "balanced_objects", "rolling_summary_chunks", "reranked", "renumbered_citations", "lone_windows",
    "gold_by_every_path", "frozen_cases", "nearest_interval", "budget_batches", "lateral_topk_variants", "alias_variant_merge", "last_turns", "rerank_budget_prefix", "normalize_search",
    "overlapping_occurrences", "json_objects", "protected_retention", "gold_match", "config_versions", "artifact_round_trip", "evaluation_normal_forms", "expression_forms", "failed_lanes",
])
def test_oracles(spark, name):
    from lumenspan.sources.corpus import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = registry.queries()[name](spark, SF).select(*columns)
    plain = lambda r: tuple(None if v is None else round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v for v in r)
    assert sorted(map(repr, map(plain, want.fetchall()))) == sorted(map(repr, map(plain, got.collect())))


def test_driver_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
