"""Aggregates over invocations, outbox rows and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.corpus import NOW, ctes, table, view
from .registry import query

DONE = "done AS (SELECT DISTINCT run_id FROM inv WHERE operation = 'purchase' AND status = 'succeeded')"


def completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invocations of runs that have a succeeded purchase."""
    inv = view(spark, sf_dir, "inv")
    return inv.join(inv.where("operation = 'purchase' AND status = 'succeeded'").select("run_id"), "run_id", "left_semi")


@query(ctes("inv") + f""", {DONE} SELECT count(DISTINCT run_id) AS run_count, count(*) AS invocation_count, count(*) FILTER (WHERE status = 'failed') AS failed_count,
    CAST(coalesce(sum(prompt_tokens), 0) AS BIGINT) AS prompt_tokens, CAST(coalesce(sum(completion_tokens), 0) AS BIGINT) AS completion_tokens,
    round(avg(elapsed_ms) FILTER (WHERE status <> 'running'), 6) AS average_elapsed FROM inv JOIN done USING (run_id)""")
def run_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return completed(spark, sf_dir).agg(
        F.count_distinct("run_id").alias("run_count"), F.count("*").alias("invocation_count"), F.count_if(F.col("status") == "failed").alias("failed_count"),
        total("prompt_tokens").alias("prompt_tokens"), total("completion_tokens").alias("completion_tokens"),
        F.round(F.avg(F.when(F.col("status") != "running", F.col("elapsed_ms"))), 6).alias("average_elapsed"),
    )


@query(ctes("inv") + f""", {DONE}, u AS (SELECT run_id, operation, count(*) AS n, sum(prompt_tokens) AS p, sum(completion_tokens) AS c FROM inv JOIN done USING (run_id) GROUP BY 1, 2)
    SELECT operation, count(*) AS runs, CAST(sum(n) AS BIGINT) AS invocations, CAST(quantile_disc(p, 0.9) AS BIGINT) AS prompt_p90,
    CAST(quantile_disc(c, 0.9) AS BIGINT) AS completion_p90, CAST(quantile_disc(p + c, 0.9) AS BIGINT) AS total_p90 FROM u GROUP BY 1""")
def token_p90_by_operation(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = completed(spark, sf_dir).groupBy("run_id", "operation").agg(F.count("*").alias("n"), F.sum("prompt_tokens").alias("p"), F.sum("completion_tokens").alias("c"))
    p90 = lambda e: F.expr(f"CAST(percentile_disc(0.9) WITHIN GROUP (ORDER BY {e}) AS BIGINT)")
    return usage.groupBy("operation").agg(F.count("*").alias("runs"), F.sum("n").alias("invocations"), p90("p").alias("prompt_p90"), p90("c").alias("completion_p90"), p90("p + c").alias("total_p90"))


@query(ctes("inv") + """ SELECT run_id, count(*) AS invocations, min(started_at) AS started_at, CASE WHEN bool_or(operation = 'error') THEN 'failed' WHEN bool_or(operation = 'signup') THEN 'cancelled'
    WHEN bool_or(operation = 'click') THEN 'running' ELSE 'succeeded' END AS run_status FROM inv GROUP BY 1 ORDER BY started_at DESC, run_id LIMIT 50""")
def run_list_priority_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = lambda x: F.bool_or(F.col("operation") == x)
    state = F.when(has("error"), "failed").when(has("signup"), "cancelled").when(has("click"), "running").otherwise("succeeded")
    runs = view(spark, sf_dir, "inv").groupBy("run_id").agg(F.count("*").alias("invocations"), F.min("started_at").alias("started_at"), state.alias("run_status"))
    return runs.orderBy(F.desc("started_at"), "run_id").limit(50)


@query(ctes("obx") + f""" SELECT channel, count(*) FILTER (WHERE NOT published AND NOT exhausted) AS pending, count(*) FILTER (WHERE exhausted) AS exhausted,
    CAST(floor(coalesce(max(epoch({NOW} - created_at)) FILTER (WHERE NOT published AND NOT exhausted), 0)) AS BIGINT) AS oldest_seconds,
    CAST(coalesce(sum(attempt_count) FILTER (WHERE NOT published), 0) AS BIGINT) AS retries FROM obx GROUP BY 1""")
def outbox_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = F.expr(f"timestampdiff(SECOND, created_at, {NOW})")
    pending = F.expr("NOT published AND NOT exhausted")
    return view(spark, sf_dir, "obx").groupBy("channel").agg(
        F.count_if(pending).alias("pending"), F.count_if(F.col("exhausted")).alias("exhausted"), F.coalesce(F.max(F.when(pending, age)), F.lit(0)).cast("long").alias("oldest_seconds"),
        F.coalesce(F.sum(F.when(~F.col("published"), F.col("attempt_count"))), F.lit(0)).cast("long").alias("retries"),
    )


@query(ctes("utt") + """, s AS (SELECT recording_id, cluster, CAST(sum(greatest(0, end_ms - start_ms)) AS BIGINT) AS ms FROM utt GROUP BY 1, 2),
    a AS (SELECT recording_id, string_agg(cluster || '=' || ms, ';' ORDER BY ms DESC, cluster) AS stats FROM s GROUP BY 1)
    SELECT c.id AS recording_id, coalesce(stats, '') AS stats FROM (SELECT DISTINCT conv_id AS id FROM conversations UNION SELECT -1) c LEFT JOIN a ON a.recording_id = c.id""")
def lateral_speaker_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = view(spark, sf_dir, "utt").groupBy("recording_id", "cluster").agg(F.sum(F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))).cast("long").alias("ms"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("ms")).alias("o"), "cluster", "ms")))
    stats = per.groupBy("recording_id").agg(F.array_join(F.transform(ordered, lambda r: F.concat(r["cluster"], F.lit("="), r["ms"].cast("string"))), ";").alias("stats"))
    ids = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("recording_id")).distinct().unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("recording_id")))
    return ids.join(stats, "recording_id", "left").select("recording_id", F.coalesce("stats", F.lit("")).alias("stats"))


@query(ctes("inv") + """, c AS (SELECT conv_id, max(turn) AS turns FROM conversations GROUP BY 1), r AS (SELECT run_id, max(user_id) AS u FROM inv GROUP BY 1)
    SELECT run_id, conv_id, turns FROM r LEFT JOIN c ON c.conv_id = r.u""")
def lateral_latest_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = view(spark, sf_dir, "inv").groupBy("run_id").agg(F.max("user_id").alias("u"))
    one = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turns"))
    return runs.join(one, F.col("u") == F.col("conv_id"), "left").select("run_id", "conv_id", "turns")


@query("""SELECT source, count(DISTINCT d.doc_id) AS documents, count(DISTINCT l.doc_id) AS labelled, count(DISTINCT d.doc_id) FILTER (WHERE quality = 0) AS poor,
    count(DISTINCT lang) AS languages, max(d.doc_id) FILTER (WHERE toxic = 1) AS last_toxic FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""")
def dataset_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").withColumn("labelled", F.col("doc_id"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(labels, "doc_id", "left")
    return docs.groupBy("source").agg(
        F.count_distinct("doc_id").alias("documents"), F.count_distinct("labelled").alias("labelled"), F.count_distinct(F.when(F.col("quality") == 0, F.col("doc_id"))).alias("poor"),
        F.count_distinct("lang").alias("languages"), F.max(F.when(F.col("toxic") == 1, F.col("doc_id"))).alias("last_toxic"),
    )


@query("SELECT user_id, coalesce(max(event_id) FILTER (WHERE event_type = 'purchase'), 0) + 1 AS next_version FROM events GROUP BY 1")
def next_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg((F.coalesce(F.max(F.when(F.col("event_type") == "purchase", F.col("event_id"))), F.lit(0)) + 1).alias("next_version"))


@query(ctes("inv") + """ SELECT operation, round(CAST(count(*) FILTER (WHERE completion_tokens % 5 = 0) AS DOUBLE) / count(*), 9) AS blank_rate, round(avg(elapsed_ms), 6) AS mean_ms,
    CAST(quantile_disc(prompt_tokens, 0.5) AS BIGINT) AS p50, CAST(quantile_disc(prompt_tokens, 0.95) AS BIGINT) AS p95 FROM inv GROUP BY 1""")
def blank_and_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lambda q: F.expr(f"CAST(percentile_disc({q}) WITHIN GROUP (ORDER BY prompt_tokens) AS BIGINT)")
    blank = F.avg(F.when(F.col("completion_tokens") % 5 == 0, 1.0).otherwise(0.0))
    return view(spark, sf_dir, "inv").groupBy("operation").agg(F.round(blank, 9).alias("blank_rate"), F.round(F.avg("elapsed_ms"), 6).alias("mean_ms"), p(0.5).alias("p50"), p(0.95).alias("p95"))


@query("""WITH l AS (SELECT conv_id, role, 'c' AS source, 3 AS priority FROM conversations UNION ALL SELECT conv_id, 'user', 'b', 2 FROM conversations WHERE turn = 1 UNION ALL SELECT conv_id, role, 'a', 1 FROM conversations WHERE turn = 0)
    SELECT conv_id, role, arg_min(source, priority) AS source, count(*) AS n FROM l GROUP BY 1, 2""")
def seed_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "role", "turn")
    lane = lambda df, role, name, p: df.select("conv_id", role, F.lit(name).alias("source"), F.lit(p).alias("priority"))
    rows = lane(c, F.col("role"), "c", 3).unionByName(lane(c.where("turn = 1"), F.lit("user").alias("role"), "b", 2)).unionByName(lane(c.where("turn = 0"), F.col("role"), "a", 1))
    return rows.groupBy("conv_id", "role").agg(F.min_by("source", "priority").alias("source"), F.count("*").alias("n"))


@query(ctes("inv") + """ SELECT user_id, count(*) FILTER (WHERE operation IN ('view', 'click')) AS running, count(*) FILTER (WHERE operation = 'error') AS failed,
    bool_or(status = 'failed') AS any_failed, string_agg(DISTINCT operation, ',' ORDER BY operation) AS operations FROM inv GROUP BY 1""")
def task_gauge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "inv").groupBy("user_id").agg(
        F.count_if(F.col("operation").isin("view", "click")).alias("running"), F.count_if(F.col("operation") == "error").alias("failed"),
        F.bool_or(F.col("status") == "failed").alias("any_failed"), F.array_join(F.sort_array(F.collect_set("operation")), ",").alias("operations"),
    )


@query("""SELECT l_orderkey AS recording_id, max(CASE WHEN n = 1 THEN l_extendedprice END) AS best, max(CASE WHEN n = 2 THEN l_extendedprice END) AS second FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC) AS n FROM lineitem) t WHERE n <= 2 GROUP BY 1""")
def best_and_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice")))
    top = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice").withColumn("n", place).where("n <= 2")
    at = lambda k: F.max(F.when(F.col("n") == k, F.col("l_extendedprice")))
    return top.groupBy(F.col("l_orderkey").alias("recording_id")).agg(at(1).alias("best"), at(2).alias("second"))
