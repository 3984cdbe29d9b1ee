"""Gold matching, rank metrics, gates, scores, splits, losses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators.joins import contains_join
from ..sources.corpus import ctes, table, view
from ..sources.snapshots import shared_folder
from .registry import query

FLAT = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
GOLD = f"gold AS (SELECT item_id AS case_id, doc_id AS chunk_id, 1 + doc_id % 3 AS relevance FROM benchmark b JOIN documents d ON strpos({FLAT.format('d.text')}, {FLAT.format('b.text')}) > 0)"


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage; the passages are a stated set of queries against all documents."""
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("case_id"), flat("text").alias("passage"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), flat("text").alias("body"))
    return contains_join(docs, "chunk_id", "body", items, "passage").select("case_id", "chunk_id", (1 + F.col("chunk_id") % 3).alias("relevance"))


def ranked(g: DataFrame) -> DataFrame:
    """A deterministic ranked list for each case: its gold every other rank, other documents between."""
    place = F.row_number().over(Window.partitionBy("case_id").orderBy("chunk_id"))
    return g.withColumn("rank", 2 * place).select("case_id", "rank", "chunk_id")


@query("WITH " + GOLD + " SELECT case_id, chunk_id, relevance FROM gold")
def gold_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold(spark, sf_dir)


MATCHED = GOLD + """, r AS (SELECT case_id, chunk_id, relevance, 2 * row_number() OVER (PARTITION BY case_id ORDER BY chunk_id) AS rank FROM gold)"""


@query("WITH " + MATCHED + """, i AS (SELECT case_id, count(*) AS total, list(relevance ORDER BY relevance DESC)[1:10] AS l FROM gold GROUP BY 1),
    n AS (SELECT case_id, sum((power(2, r) - 1) / log2(p + 1)) AS ideal FROM (SELECT case_id, unnest(l) AS r, generate_subscripts(l, 1) AS p FROM i) x GROUP BY 1)
    SELECT i.case_id, CAST(bool_or(rank <= 1) AS INTEGER)::DOUBLE AS hit_at_1, CAST(bool_or(rank <= 5) AS INTEGER)::DOUBLE AS hit_at_5, round(least(1.0, count(*) FILTER (WHERE rank <= 10)::DOUBLE / max(total)), 9) AS recall_at_10,
    round(1.0 / min(rank), 9) AS reciprocal_rank, round(sum(CASE WHEN rank <= 10 THEN (power(2, relevance) - 1) / log2(rank + 1) ELSE 0 END) / max(ideal), 9) AS ndcg_at_10
    FROM i JOIN n USING (case_id) JOIN r USING (case_id) GROUP BY 1""")
def rank_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "gold")
    gold(spark, sf_dir).write.parquet(path)  # the hits are few, and finding them reads all texts
    g = spark.read.parquet(path)
    anchors = g.select("case_id", F.lit(1).alias("recording_id"), "chunk_id", F.col("chunk_id").alias("evidence_id"), "relevance", F.lit(0).alias("start_ms"), F.lit(0).alias("end_ms"), F.lit("\u0001").alias("quote"))
    items = ranked(g).select("case_id", "rank", F.lit(1).alias("recording_id"), "chunk_id", F.lit("").alias("text"), F.lit(0).alias("start_ms"), F.lit(0).alias("end_ms"))
    out = E.rank_metrics(E.match_gold(items, anchors), anchors)
    return out.select("case_id", "hit_at_1", "hit_at_5", *[F.round(c, 9).alias(c) for c in ("recall_at_10", "reciprocal_rank", "ndcg_at_10")])


@query(ctes("verdict") + """ SELECT round(avg(CASE WHEN (expected <> 'abstain') = (actual <> 'abstain') THEN 1.0 ELSE 0 END), 9) AS answerability_accuracy,
    round(avg(CASE WHEN actual = 'abstain' THEN 1.0 ELSE 0 END) FILTER (WHERE expected <> 'abstain'), 9) AS answer_false_negative_rate,
    round(avg(CASE WHEN actual <> 'abstain' THEN 1.0 ELSE 0 END) FILTER (WHERE expected = 'abstain'), 9) AS unsafe_answer_rate FROM verdict""")
def gate_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.gate_metrics(view(spark, sf_dir, "verdict"))
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query(ctes("verdict") + """ SELECT case_id, CASE WHEN expected = 'abstain' THEN CASE WHEN actual = 'abstain' THEN 100.0 ELSE 0.0 END WHEN actual = 'abstain' THEN 0.0
    ELSE round(greatest(0.0, least(100.0, (case_id % 5) / 4.0 * 65 + (case_id % 3) / 2.0 * 25 + 10 - (case_id % 2) * 15 - CASE WHEN case_id % 7 = 0 THEN 30 ELSE 0 END)), 6) END::DOUBLE AS score FROM verdict""")
def answer_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("case_id")
    score = E.answer_score(F.col("expected"), F.col("actual"), (c % 5) / 4, (c % 3) / 2, c % 2, F.when(c % 7 == 0, 1).otherwise(0))
    return view(spark, sf_dir, "verdict").select("case_id", F.round(score, 6).alias("score"))


@query("""WITH g AS (SELECT conv_id, turn, length(text) AS w, turn % 3 = 0 AS hit FROM conversations), s AS (SELECT conv_id, sum(w) FILTER (WHERE hit) AS got, sum(w) AS gold, sum(w) FILTER (WHERE turn % 2 = 0) AS found,
    sum(w) FILTER (WHERE hit AND turn % 2 = 0) AS shared FROM g GROUP BY 1)
    SELECT conv_id, round(coalesce(shared, 0)::DOUBLE / nullif(found, 0), 9) AS precision, round(coalesce(shared, 0)::DOUBLE / nullif(gold, 0), 9) AS recall FROM s""")
def correction_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("w"))
    total = lambda cond: F.coalesce(F.sum(F.when(F.expr(cond), F.col("w"))), F.lit(0))
    s = rows.groupBy("conv_id").agg(total("turn % 2 = 0").alias("found"), total("true").alias("gold"), total("turn % 6 = 0").alias("both"))
    share = lambda d: F.round(F.col("both") / F.nullif(F.col(d), F.lit(0)), 9)
    return s.select("conv_id", share("found").alias("precision"), share("gold").alias("recall"))


STAGE_ROWS = """st AS (SELECT user_id AS case_id, event_id % 10 AS evidence_id, s.stage, CASE (max(event_id) + s.stage * 3) % 5 WHEN 0 THEN 'miss' WHEN 1 THEN 'hit' WHEN 2 THEN 'hit' WHEN 3 THEN 'skipped' ELSE 'unknown' END AS status
    FROM {events}, (SELECT 0 AS stage UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) s GROUP BY user_id, event_id % 10, s.stage)"""


@query("WITH " + STAGE_ROWS.replace("{events}", "events") + """, o AS (SELECT *, coalesce(max(CASE WHEN status = 'hit' THEN stage END) OVER (PARTITION BY case_id, evidence_id), -1) AS last_hit,
    max(stage) OVER (PARTITION BY case_id, evidence_id) AS top FROM st WHERE status <> 'skipped')
    SELECT case_id, evidence_id, bool_or(stage = top AND status = 'hit') AS final_covered, CASE WHEN max(last_hit) >= 0 THEN max(last_hit) END AS last_visible,
    CASE WHEN bool_or(stage = top AND status = 'hit') THEN NULL WHEN arg_min(status, stage) FILTER (WHERE stage > last_hit AND status IN ('miss', 'unknown')) = 'miss'
        THEN CAST(min(stage) FILTER (WHERE stage > last_hit AND status IN ('miss', 'unknown')) AS VARCHAR) ELSE 'unknown' END AS first_loss FROM o GROUP BY 1, 2""")
def loss_journey(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql("WITH " + STAGE_ROWS + " SELECT * FROM st", events=table(spark, sf_dir, "events"))
    return E.loss_journeys(rows)


@query("""WITH b AS (SELECT source, bool_and(doc_id % 7 <> 0 OR lang = 'en') AS train_ok, bool_and(n_chars > 0) AS eval_ok,
    CAST(('0x' || substr(sha256('seed:' || source), 1, 16))::UBIGINT % 100 AS INTEGER) AS bucket FROM documents GROUP BY source)
    SELECT source, CASE WHEN bucket < 80 AND train_ok THEN 'train' WHEN bucket >= 80 AND eval_ok THEN CASE WHEN bucket < 90 THEN 'validation' ELSE 'test' END
    WHEN train_ok THEN 'train' WHEN eval_ok THEN 'test' END AS split FROM b""")
def split_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("source", ((F.col("doc_id") % 7 != 0) | (F.col("lang") == "en")).alias("train_allowed"), (F.col("n_chars") > 0).alias("evaluation_allowed"))
    return E.assign_splits(rows, "source")
