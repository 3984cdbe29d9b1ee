"""Registries and a small executor: named stages over DataFrames, cached by fingerprint."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..operators.sequences import topological_order
from ..sources.artifacts import fingerprint

Stage = Callable[[SparkSession, dict[str, DataFrame]], DataFrame]


class Registry:
    """Callables by (name, version); a name and version is registered once."""

    def __init__(self):
        self._known: dict[tuple[str, str], Stage] = {}

    def add(self, name: str, version: str, stage: Stage) -> None:
        if (name, version) in self._known:
            raise ValueError(f"{name} {version} is registered")
        self._known[name, version] = stage

    def get(self, name: str, version: str) -> Stage:
        return self._known[name, version]

    def missing(self, wanted: set[tuple[str, str]]) -> set[tuple[str, str]]:
        return wanted - set(self._known)


@dataclass
class Node:
    name: str
    version: str = "1"
    config: str = "{}"
    needs: tuple[str, ...] = ()
    required: bool = True
    retries: int = 1


@dataclass
class Report:
    status: str = "succeeded"
    states: dict[str, str] = field(default_factory=dict)


def run(spark: SparkSession, nodes: list[Node], registry: Registry, root: str) -> Report:
    """Run nodes in order; each output is a table named by its fingerprint and reused while it exists.

    A required node's failure makes the run failed, an optional one's partial;
    nodes that need a failed one are skipped.
    """
    by_name = {n.name: n for n in nodes}
    prints: dict[str, str] = {}
    report = Report()
    hadoop = spark._jsc.hadoopConfiguration()
    for name in topological_order({n.name: set(n.needs) for n in nodes}):
        node = by_name[name]
        if any(report.states[x] not in ("done", "reused") for x in node.needs):
            report.states[name] = "skipped"
            if node.required:
                report.status = "failed"
            continue
        prints[name] = fingerprint(node.name, node.version, node.config, [prints[x] for x in node.needs])
        path = f"{root}/{prints[name]}"
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if done.getFileSystem(hadoop).exists(done):
            report.states[name] = "reused"
            continue
        for attempt in range(1 + node.retries):
            try:
                inputs = {x: spark.read.parquet(f"{root}/{prints[x]}") for x in node.needs}
                registry.get(node.name, node.version)(spark, inputs).write.mode("overwrite").parquet(path)
                report.states[name] = "done"
                break
            except Exception:
                if attempt == node.retries:
                    report.states[name] = "failed"
                    if node.required:
                        report.status = "failed"
                    elif report.status == "succeeded":
                        report.status = "partial_failed"
    return report
