"""Stateful streams: tails come out, ended states go, and a restarted stream goes on from its checkpoint."""

import time

from lumenspan.streaming import projections as P


def _until(query, seen, want, seconds=90):
    end = time.time() + seconds
    while time.time() < end and not want(seen):
        assert query.exception() is None
        time.sleep(0.3)
    assert want(seen), seen


def _start(spark, frame, schema, folder, check, seen, mode):
    source = spark.readStream.schema(schema).parquet(folder)
    take = lambda batch, _: seen.extend(tuple(r) for r in batch.collect())
    return frame(source).writeStream.foreachBatch(take).outputMode(mode).option("checkpointLocation", check).trigger(processingTime="200 milliseconds").start()


def test_the_rest_of_a_text_comes_out_by_time_or_end(spark, tmp_path):
    schema, folder, check = "key string, sequence long, text string, last boolean", str(tmp_path / "in"), str(tmp_path / "check")
    add = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    add(("a", 1, "x" * 6, False), ("a", 2, "y" * 6, False), ("b", 1, "tail", False), ("c", 1, "done", True), ("d", 1, None, True))
    seen = []
    run = lambda: _start(spark, lambda s: P.text_batches(s, 10, 1_500), schema, folder, check, seen, "append")
    query = run()
    _until(query, seen, lambda x: {("a", "x" * 6 + "y" * 6), ("b", "tail"), ("c", "done")} <= set(x))
    query.stop()
    add(("b", 2, "more", True))
    query = run()
    _until(query, seen, lambda x: ("b", "more") in x)
    query.stop()
    assert len(seen) == 4


def test_an_ended_state_expires(spark, tmp_path):
    schema, folder = "key string, status string, version long", str(tmp_path / "in")
    add = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    add(("a", "failed", 3), ("a", "running", 9), ("b", "running", 1))
    seen = []
    query = _start(spark, lambda s: P.project_first_terminal(s, 1_000), schema, folder, str(tmp_path / "check"), seen, "update")
    _until(query, seen, lambda x: {("a", "failed", 3, 1), ("b", "running", 1, 1)} <= set(x))
    time.sleep(4)
    add(("a", "running", 1), ("b", "running", 2))  # a has been forgotten, b has not
    _until(query, seen, lambda x: {("a", "running", 1, 1), ("b", "running", 2, 2)} <= set(x))
    query.stop()
