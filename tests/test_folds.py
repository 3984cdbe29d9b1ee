"""Streamed folds against plain loops, over batches of few rows so that keys cross their borders."""

import random

import pytest
from pyspark.sql import functions as F

from lumenspan.operators import folds
from lumenspan.operators import sequences as Q


@pytest.fixture(params=[3, 10_000])
def batches(spark, request):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(request.param))
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def segments(seed):
    rng, rows = random.Random(seed), []
    for k in range(12):
        at = 0
        for _ in range(rng.choice([0, 1, 2, 40])):
            start = at + rng.choice([0, 0, 500, 3_000, 3_001, -200])
            at = start + rng.choice([300, 1_900, 2_000, 30_000, 79_000, 90_000])
            rows.append((k, start, at, rng.choice([0, 0, 1])))
    return rows


def merged(rows, gap=3_000, length=80_000):
    out = []
    for k, s, e, w in sorted(rows):
        if out and out[-1][0] == k and out[-1][3] == w and s - out[-1][2] <= gap and e - out[-1][1] <= length:
            out[-1] = (k, out[-1][1], e, w)
        else:
            out.append((k, s, e, w))
    return out


def test_merging(spark, batches):
    rows = segments(1)
    df = spark.createDataFrame(rows, "recording_id long, start_ms long, end_ms long, cluster long")
    assert sorted(map(tuple, folds.merge_adjacent(df).collect())) == sorted(merged(rows))
    assert folds.merge_adjacent(df.limit(0)).count() == 0


def test_smoothing_of_many_recordings(spark, batches):
    rows = segments(2)
    df = spark.createDataFrame(rows, "recording_id long, start_ms long, end_ms long, cluster long")
    want = []
    for k in {r[0] for r in rows}:
        line, given = sorted(r for r in rows if r[0] == k), 0
        while True:
            line, found = merged(line), None
            line = [list(r) for r in line]
            changed = 0
            i = 1
            while i + 1 < len(line):
                a, b, c = line[i - 1 : i + 2]
                if a[3] == c[3] != b[3] and b[2] - b[1] <= 2_000 and b[1] - a[2] <= 3_000 and c[1] - b[2] <= 3_000:
                    b[3] = a[3]
                    changed += 1
                i += 1
            line = [tuple(r) for r in line]
            if not changed:
                break
            given += changed
        want += [(*r, given) for r in line]
    assert sorted(map(tuple, Q.smooth_segments(df).collect())) == sorted(want)


def test_budgets(spark, batches):
    rng = random.Random(3)
    rows = [(k, i, rng.choice([0, 1, 4, 9, 10, 11, 25])) for k in range(9) for i in range(rng.choice([0, 1, 30]))]
    want = {}
    for k, _, n in rows:
        own = want.setdefault(k, [])
        if own and own[-1][1] + n <= 10:
            own[-1] = (own[-1][0] + 1, own[-1][1] + n)
        else:
            own.append((1, n))
    got = folds.budget_batches(spark.createDataFrame(rows, "k long, o long, n long"), "k", "o", "n", 10)
    assert sorted(map(tuple, got.collect())) == sorted((k, i, *b) for k, own in want.items() for i, b in enumerate(own))


def test_rolling_chunks(spark, batches):
    rng, rows = random.Random(4), []
    for k in range(9):
        at = rng.choice([0, 70_000])
        for i in range(rng.choice([0, 1, 2, 50])):
            start, at = at, at + rng.choice([100, 900, 40_000])
            rows.append((k, i, start, at, "x" * rng.choice([0, 1, 30, 90, 120])))
    want = {}
    for k, _, s, e, t in rows:
        own = want.setdefault(k, [])
        if own and e - own[-1][0] <= 60_000 and own[-1][3] + len(t) <= 100:
            own[-1] = (own[-1][0], e, own[-1][2] + 1, own[-1][3] + len(t))
        else:
            own.append((s, e, 1, len(t)))
    df = spark.createDataFrame(rows, "recording_id long, utterance_index long, start_ms long, end_ms long, text string")
    got = folds.rolling_chunks(df, F.length("text"), 100, 60_000)
    assert sorted(map(tuple, got.collect())) == sorted((k, i, *c) for k, own in want.items() for i, c in enumerate(own, 1))


def test_rolling_chunks_close_by_time_and_number_from_one(spark):
    df = spark.createDataFrame([(1, 0, 0, 600, "a"), (1, 1, 700, 1_200, "b"), (1, 2, 1_300, 1_800, "c")], "recording_id long, utterance_index long, start_ms long, end_ms long, text string")
    got = folds.rolling_chunks(df, F.length("text"), 10_000, 1_500).orderBy("chunk_index").collect()
    assert [(r.chunk_index, r.utterances) for r in got] == [(1, 2), (2, 1)]
    assert folds.rolling_budget(8_000, 1_000, 1_500, 10_000) == 3_700 and folds.rolling_budget(2_000, 1_000, 1_500) == 3_000


def test_a_million_segments_of_one_recording(spark):
    n = 1_000_000
    df = spark.range(n).select(F.lit(1).cast("long").alias("recording_id"), (F.col("id") * 1_000).alias("start_ms"), (F.col("id") * 1_000 + 900).alias("end_ms"), F.lit(0).cast("long").alias("cluster"))
    got = folds.merge_adjacent(df).agg(F.count("*"), F.max(F.expr("end_ms - start_ms")), F.sum(F.expr("end_ms - start_ms"))).first()
    assert got[0] == n // 80 and got[1] == 79_900 and got[2] == 79_900 * (n // 80)
    batches_ = folds.budget_batches(df.withColumn("n", F.lit(1)), "recording_id", "start_ms", "n", 1_000)
    assert batches_.count() == 1_000 and batches_.where("total <> 1000").count() == 0


def test_windows_name_their_segments(spark):
    df = spark.createDataFrame([(1, 0, 10_000), (1, 10_000, 35_000), (1, 36_000, 40_000)], "recording_id long, start_ms long, end_ms long")
    got = Q.speech_windows(df).orderBy("window_index").collect()
    assert [r.segments for r in got] == [[1, 2], [3]] and [r.input_end_ms for r in got] == [35_500, 40_500]
