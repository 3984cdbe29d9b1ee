"""Outbox, upserts, stale records, transitions, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import state as S
from ..operators.joins import insert_once, latest
from ..sources.corpus import NOW, ctes, table, view
from .registry import query


@query(ctes("obx") + """ SELECT aggregate_id, event_id, created_at FROM obx a WHERE NOT published AND NOT exhausted AND NOT EXISTS (SELECT 1 FROM obx b WHERE b.aggregate_id = a.aggregate_id
    AND NOT b.published AND NOT b.exhausted AND (b.created_at, b.event_id) < (a.created_at, a.event_id)) ORDER BY created_at, event_id LIMIT 100""")
def outbox_head_of_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.claim(view(spark, sf_dir, "obx"), 100).select("aggregate_id", "event_id", "created_at")


@query(ctes("obx") + """ SELECT event_id, attempt_count + 1 AS attempt_count, CAST(least(300, power(2, least(attempt_count, 8))) AS BIGINT) AS delay_seconds,
    attempt_count + 1 >= 8 AS exhausted, CASE WHEN attempt_count + 1 >= 8 THEN 'dead_letter' ELSE 'retry' END AS route FROM obx WHERE NOT published""")
def outbox_retry_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.fail(view(spark, sf_dir, "obx").where("not published"), 8)


@query(ctes("inv") + f""" SELECT id, CASE WHEN operation = 'view' AND started_at < {NOW} - INTERVAL 24 HOURS THEN 'abandoned' ELSE status END AS status,
    CASE WHEN operation = 'view' AND started_at < {NOW} - INTERVAL 24 HOURS THEN CAST(floor(epoch({NOW} - started_at)) AS BIGINT) END AS elapsed_seconds FROM inv""")
def stale_abandon(spark: SparkSession, sf_dir: str) -> DataFrame:
    stale = F.expr(f"operation = 'view' AND started_at < {NOW} - INTERVAL '24' HOUR")
    age = F.expr(f"timestampdiff(SECOND, started_at, {NOW})").cast("long")
    return view(spark, sf_dir, "inv").select("id", F.when(stale, "abandoned").otherwise(F.col("status")).alias("status"), F.when(stale, age).alias("elapsed_seconds"))


@query(ctes("inv") + f""" SELECT user_id, min(id) FILTER (WHERE operation = 'click' AND started_at < {NOW} - INTERVAL 10 DAYS) AS oldest,
    count(*) FILTER (WHERE operation = 'click' AND started_at < {NOW} - INTERVAL 10 DAYS) AS requeued FROM inv GROUP BY 1""")
def stale_requeue(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.expr(f"operation = 'click' AND started_at < {NOW} - INTERVAL '10' DAY")
    return view(spark, sf_dir, "inv").groupBy("user_id").agg(F.min(F.when(old, F.col("id"))).alias("oldest"), F.count_if(old).alias("requeued"))


@query(ctes("inv") + " SELECT run_id, max(completion_tokens) AS version, arg_max(id, completion_tokens * 1000000000 + id) AS id, count(DISTINCT id) AS ids FROM inv GROUP BY 1")
def terminal_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "inv").select("run_id", F.col("completion_tokens").alias("version"), "id")
    return S.terminal_fence(rows, "run_id", "version", "id")


@query(ctes("inv") + """ SELECT run_id, arg_min(prompt_tokens, id) FILTER (WHERE prompt_tokens % 2 = 0) AS prompt_tokens,
    arg_min(operation, id) FILTER (WHERE operation <> 'view') AS operation FROM inv GROUP BY 1""")
def first_write_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    inv = view(spark, sf_dir, "inv").select("run_id", "id", F.when(F.col("prompt_tokens") % 2 == 0, F.col("prompt_tokens")).alias("prompt_tokens"), F.when(F.col("operation") != "view", F.col("operation")).alias("operation"))
    return S.first_write_merge(inv, "run_id", "id", ["prompt_tokens", "operation"])


@query(ctes("inv") + " SELECT run_id, operation, max(id) AS id, arg_max(prompt_tokens, id) AS prompt_tokens FROM inv GROUP BY 1, 2")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(view(spark, sf_dir, "inv").select("run_id", "operation", "id", "prompt_tokens"), ["run_id", "operation"], ["id"]).select("run_id", "operation", "id", "prompt_tokens")


@query("SELECT event_id, event_type FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, event_type FROM events WHERE event_id % 3 = 0 AND event_id % 2 <> 0")
def insert_once_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    return insert_once(e.where("event_id % 2 = 0"), e.where("event_id % 3 = 0"), ["event_id"])


@query(ctes("chunk") + """ SELECT chunk_id, sha256(text) AS content_hash FROM chunk WHERE chunk_id % 4 <> 0 OR chunk_id % 8 = 0""")
def incremental_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunk = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    known = chunk.where("chunk_id % 4 = 0").select("chunk_id", F.when(F.col("chunk_id") % 8 == 0, "stale").otherwise(F.sha2("text", 256)).alias("content_hash"))
    return S.reindex(chunk, known, "chunk_id", F.sha2("text", 256)).select("chunk_id", "content_hash")


@query("""SELECT l_orderkey AS parent, count(*) AS children FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY 1
    UNION ALL SELECT o_orderkey, 1 FROM orders WHERE o_orderkey % 5 = 0""")
def replace_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("parent"), F.col("l_partkey").alias("child"))
    new = table(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("parent"), F.col("o_custkey").alias("child"))
    return S.replace_children(old, new, "parent").groupBy("parent").agg(F.count("*").alias("children"))


@query("SELECT event_id FROM events WHERE NOT (event_id % 3 = 0 AND ts < TIMESTAMP '2024-01-10 00:00:00')")
def retention_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("NOT (event_id % 3 = 0 AND ts < TIMESTAMP '2024-01-10 00:00:00')").select("event_id")


@query("""SELECT doc_id, doc_id % 3 = 0 AND quality = 1 AS accepted, CASE WHEN doc_id % 3 = 0 AND quality = 1 THEN 'reviewed' WHEN quality = 1 THEN 'draft' ELSE 'archived' END AS new_status FROM labels""")
def state_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "draft").otherwise("archived").alias("status"), (F.col("doc_id") % 3).alias("revision"))
    return S.transition(rows, "status", "revision", F.lit(0), {"draft": "reviewed", "reviewed": "approved"}).select("doc_id", "accepted", "new_status")


@query("""SELECT conv_id, turn, CAST(2 * (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS BIGINT) AS sequence,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1 AS resumable FROM conversations WHERE role = 'user'""")
def turn_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = lambda order: F.row_number().over(Window.partitionBy("conv_id").orderBy(order))
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", (2 * (place(F.col("turn")) - 1)).cast("long").alias("sequence"), (place(F.desc("turn")) == 1).alias("resumable"))


@query(ctes("seg", "inv") + """ SELECT 'interval' AS rule, count(*) FILTER (WHERE NOT (end_ms >= start_ms AND start_ms >= 0)) AS n FROM seg
    UNION ALL SELECT 'range', count(*) FILTER (WHERE NOT (prompt_tokens BETWEEN 10 AND 400)) FROM inv
    UNION ALL SELECT 'digest', count(*) FILTER (WHERE NOT regexp_full_match(md5(text), '[0-9a-f]{32}')) FROM documents
    UNION ALL SELECT 'dimensions', count(*) FILTER (WHERE len(embedding) <> 64) FROM embeddings
    UNION ALL SELECT 'unique', count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) d""")
def quality_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").count()
    return S.violations({
        "interval": (view(spark, sf_dir, "seg"), F.expr("end_ms >= start_ms AND start_ms >= 0")),
        "range": (view(spark, sf_dir, "inv"), F.expr("prompt_tokens BETWEEN 10 AND 400")),
        "digest": (table(spark, sf_dir, "documents"), F.md5("text").rlike("^[0-9a-f]{32}$")),
        "dimensions": (table(spark, sf_dir, "embeddings"), F.size("embedding") == 64),
        "unique": (counts, F.col("count") == 1),
    })


@query(ctes("inv") + """ SELECT run_id, count(DISTINCT status) > 1 AS conflict, CASE WHEN bool_or(status = 'failed' AND operation = 'error') THEN 'failed' ELSE 'succeeded' END AS rolled_up FROM inv GROUP BY 1""")
def submission_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.bool_or((F.col("status") == "failed") & (F.col("operation") == "error"))
    return view(spark, sf_dir, "inv").groupBy("run_id").agg((F.count_distinct("status") > 1).alias("conflict"), F.when(bad, "failed").otherwise("succeeded").alias("rolled_up"))


@query(ctes("inv") + """ SELECT id FROM inv WHERE run_id NOT IN (SELECT run_id FROM inv WHERE operation = 'error') ORDER BY CASE WHEN operation = 'purchase' THEN 0 ELSE 1 END, started_at, id LIMIT 40""")
def priority_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    inv = view(spark, sf_dir, "inv")
    live = inv.join(inv.where("operation = 'error'").select("run_id"), "run_id", "left_anti")
    return live.orderBy(F.when(F.col("operation") == "purchase", 0).otherwise(1), "started_at", "id").limit(40).select("id")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 5")
def bounded_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id")))
    return table(spark, sf_dir, "events").select("user_id", "event_id").withColumn("n", n).where("n <= 5").drop("n")
