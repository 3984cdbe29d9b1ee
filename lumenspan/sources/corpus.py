"""Canonical views over the driver's tables; the same SQL defines them for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NOW = "TIMESTAMP '2024-01-31 00:00:00'"

VIEWS = {
    "utt": """SELECT conv_id AS recording_id, turn AS utterance_index, role AS cluster, text,
        CAST(60 * (sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) - length(text)) AS BIGINT) AS start_ms,
        CAST(60 * sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS end_ms FROM {conversations}""",
    "chunk": """SELECT doc_id AS chunk_id, source AS recording_id,
        CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS BIGINT) AS chunk_index, text, n_chars FROM {documents}""",
    "inv": """SELECT event_id AS id, user_id * 100 + day(ts) AS run_id, event_type AS operation,
        CASE WHEN event_type = 'error' THEN 'failed' ELSE 'succeeded' END AS status,
        CAST(floor(value) AS BIGINT) AS prompt_tokens, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS completion_tokens,
        value AS elapsed_ms, ts AS started_at, user_id FROM {events}""",
    "obx": """SELECT event_id, event_type AS channel, user_id AS aggregate_id, ts AS created_at, event_id % 3 = 0 AS published,
        event_id % 97 = 0 AS exhausted, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 9 AS attempt_count FROM {events}""",
    "rec": """SELECT o_orderkey AS id, o_custkey AS owner, c_nationkey AS workspace, o_orderstatus AS status, o_orderdate AS created_at,
        c_mktsegment AS location, o_totalprice AS price FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "seg": """SELECT recording_id, ordinal, CAST(before * 1000 AS BIGINT) AS start_ms,
        CAST((before + q) * 1000 + 500 * (ordinal % 2) AS BIGINT) AS end_ms, cluster FROM (
        SELECT l_orderkey AS recording_id, CAST(l_quantity AS BIGINT) AS q, l_suppkey % 3 AS cluster,
        CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS BIGINT) AS ordinal,
        CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey
            ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM {lineitem}) AS ordered""",
    "verdict": """SELECT doc_id AS case_id, CASE WHEN quality = 0 THEN 'abstain' ELSE 'answer' END AS expected,
        CASE WHEN toxic = 1 THEN 'abstain' ELSE 'answer' END AS actual FROM {labels}""",
}

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A canonical view as a DataFrame; only the columns that a query uses are read."""
    sql = VIEWS[name]
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql})


def ctes(*names: str) -> str:
    """The views as common table expressions of an oracle."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n].replace('{', '').replace('}', '')})" for n in names)
