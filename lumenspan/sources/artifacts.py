"""Content-addressed artifacts: canonical JSON in Parquet, verified when read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(stage: str, version: str, config: str, inputs: list[str]) -> str:
    """The name of a stage's output: equal for equal stage, version, config and inputs in any order."""
    import hashlib

    return hashlib.sha256("\n".join([stage, version, config, *sorted(inputs)]).encode()).hexdigest()


def write_artifact(rows: DataFrame, root: str, name: str) -> str:
    """Rows as JSON with a digest each, under root/name; a name is written once."""
    body = F.to_json(F.struct(*sorted(rows.columns)))
    rows.select(body.alias("body"), F.sha2(body, 256).alias("sha256")).write.mode("error").parquet(f"{root}/{name}")
    return f"{root}/{name}"


def read_artifact(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of an artifact; a row whose digest does not match raises."""
    rows = spark.read.parquet(path)
    checked = F.when(F.sha2("body", 256) == F.col("sha256"), F.col("body")).otherwise(F.raise_error(F.lit("artifact is damaged")).cast("string"))
    return rows.select(F.from_json(checked, schema).alias("r")).select("r.*")


def set_checksum(rows: DataFrame) -> str:
    """One digest of a set of rows, whatever their order: sums of row digests, so nothing is gathered."""
    digest = F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256)
    part = lambda at: F.sum(F.conv(F.substring(digest, at, 12), 16, 10).cast("decimal(38,0)"))
    r = rows.agg(F.count("*").alias("n"), part(1).alias("a"), part(13).alias("b"), part(25).alias("c")).first()
    import hashlib

    return hashlib.sha256(":".join(map(str, r)).encode()).hexdigest()


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length and md5 of stored files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.md5("content").alias("md5"))
