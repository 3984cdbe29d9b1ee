from lumenspan.plans.stages import Node, Registry, run


def test_stages_run_once_and_failures_roll_up(spark, tmp_path):
    r, calls = Registry(), []

    def numbers(spark, inputs):
        calls.append("numbers")
        return spark.range(5)

    r.add("numbers", "1", numbers)
    r.add("double", "1", lambda spark, inputs: inputs["numbers"].selectExpr("id * 2 AS id"))
    r.add("broken", "1", lambda spark, inputs: 1 / 0)
    nodes = [Node("double", needs=("numbers",)), Node("numbers"), Node("broken", required=False), Node("after", needs=("broken",), required=False)]
    report = run(spark, nodes, r, str(tmp_path))
    assert report.status == "partial_failed"
    assert report.states == {"broken": "failed", "numbers": "done", "after": "skipped", "double": "done"}
    again = run(spark, nodes[:2], r, str(tmp_path))
    assert again.status == "succeeded" and again.states == {"numbers": "reused", "double": "reused"} and calls == ["numbers"]
    assert run(spark, [Node("broken")], r, str(tmp_path)).status == "failed"
    assert r.missing({("double", "1"), ("none", "1")}) == {("none", "1")}


def test_queries_can_be_listed_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert len(e.queries()) > 150 and set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, check=False).returncode == 0
