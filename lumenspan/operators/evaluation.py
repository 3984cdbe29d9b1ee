"""Offline evaluation over ranked results, gold sets and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STAGES = ("vector", "rrf", "expand", "rerank")


def match_gold(items: DataFrame, gold: DataFrame) -> DataFrame:
    """(case_id, rank, evidence_id, relevance, kind, primary) of the gold that each ranked item covers.

    An item covers gold of its recording by chunk id, by at least half of its
    time, or by quoting it, in this priority; the first by (priority,
    relevance, overlap, id) is the primary one.
    """
    g = gold.select(*[F.col(c).alias(f"g_{c}") for c in gold.columns])
    pairs = items.join(g, (items["case_id"] == g["g_case_id"]) & (items["recording_id"] == g["g_recording_id"]))
    length = F.greatest(F.lit(1), F.col("g_end_ms") - F.col("g_start_ms"))
    overlap = F.greatest(F.lit(0), F.least("end_ms", "g_end_ms") - F.greatest("start_ms", "g_start_ms")) / length
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    priority = (
        F.when(F.col("chunk_id") == F.col("g_chunk_id"), 3).when(overlap >= 0.5, 2)
        .when(F.instr(flat(F.col("text")), flat(F.col("g_quote"))) > 0, 1)
    )
    kinds = F.element_at(F.array(F.lit("quote"), F.lit("time_overlap"), F.lit("checksum")), F.col("priority"))
    met = pairs.withColumn("overlap", overlap).withColumn("priority", priority).where("priority is not null")
    first = Window.partitionBy("case_id", "rank").orderBy(F.desc("priority"), F.desc("g_relevance"), F.desc("overlap"), F.desc("g_evidence_id"))
    return met.select("case_id", "rank", F.col("g_evidence_id").alias("evidence_id"), F.col("g_relevance").alias("relevance"), kinds.alias("kind"), (F.row_number().over(first) == 1).alias("primary"))


def rank_metrics(matches: DataFrame, gold: DataFrame) -> DataFrame:
    """hit, recall, reciprocal rank and nDCG of each case of gold.

    Hit, recall and reciprocal rank use all matches; gains count a primary
    match only if no earlier rank covered it; the ideal order uses all gold.
    """
    at = lambda k: F.max(F.when(F.col("rank") <= k, 1.0).otherwise(0.0))
    covered = lambda k: F.count_distinct(F.when(F.col("rank") <= k, F.col("evidence_id")))
    of_gold = gold.groupBy("case_id").agg(F.count("*").alias("total"), F.sort_array(F.collect_list("relevance"), asc=False).alias("r"))
    gain = lambda r, rank: (F.pow(F.lit(2.0), r) - 1) / F.log2(rank + 1)
    ideal = F.aggregate(F.transform(F.slice("r", 1, 10), lambda r, i: gain(r, i + 1)), F.lit(0.0), lambda s, x: s + x)
    plain = matches.groupBy("case_id").agg(
        at(1).alias("hit_at_1"), at(5).alias("hit_at_5"), at(10).alias("hit_at_10"),
        covered(5).alias("c5"), covered(10).alias("c10"), covered(20).alias("c20"), (1.0 / F.min("rank")).alias("rr"),
    )
    first = matches.groupBy("case_id", "evidence_id").agg(F.min("rank").alias("first_rank"))
    fresh = matches.where("primary").join(first, ["case_id", "evidence_id"]).where("rank = first_rank and rank <= 10")
    dcg = fresh.groupBy("case_id").agg(F.sum(gain(F.col("relevance"), F.col("rank"))).alias("dcg"))
    out = of_gold.withColumn("ideal", ideal).join(plain, "case_id", "left").join(dcg, "case_id", "left")
    recall = lambda k: F.least(F.lit(1.0), F.coalesce(F.col(f"c{k}"), F.lit(0)) / F.greatest(F.lit(1), F.col("total")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return out.select(
        "case_id", *[zero(f"hit_at_{k}").alias(f"hit_at_{k}") for k in (1, 5, 10)],
        *[recall(k).alias(f"recall_at_{k}") for k in (5, 10, 20)], zero("rr").alias("reciprocal_rank"),
        F.when(F.col("ideal") > 0, zero("dcg") / F.col("ideal")).otherwise(0.0).alias("ndcg_at_10"),
    )


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def gate_metrics(pairs: DataFrame) -> DataFrame:
    """Accuracy, false-negative and unsafe rates of (expected, actual) verdicts."""
    answer, acts = F.col("expected") != "abstain", F.col("actual") != "abstain"
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    return pairs.agg(
        ratio(n(answer == acts), F.count("*")).alias("answerability_accuracy"),
        ratio(n(answer & ~acts), n(answer)).alias("answer_false_negative_rate"),
        ratio(n(~answer & acts), n(~answer)).alias("unsafe_answer_rate"),
    )


#: Weights of a correct key point, a supported citation and a right verdict, and two penalties.
KEY_POINTS, CITATIONS, VERDICT, UNSUPPORTED, CONTRADICTED = 65.0, 25.0, 10.0, 15.0, 30.0


def answer_score(expected: Column, actual: Column, correctness: Column, support: Column, unsupported: Column, contradicted: Column) -> Column:
    score = correctness * KEY_POINTS + support * CITATIONS + VERDICT - unsupported * UNSUPPORTED - contradicted * CONTRADICTED
    both = F.when(expected == "abstain", F.when(actual == "abstain", 100.0).otherwise(0.0))
    return both.when(actual == "abstain", 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)))


def loss_journeys(stages: DataFrame) -> DataFrame:
    """Per (case_id, evidence_id): final_covered, last_visible, first_loss, from rows (stage number, status).

    Skipped stages do not count.  The loss is the first miss after the last
    hit; a stage of unknown state before it makes the loss unknown.
    """
    on = stages.where("status <> 'skipped'")
    key = ["case_id", "evidence_id"]
    last_hit = F.coalesce(F.max(F.when(F.col("status") == "hit", F.col("stage"))).over(Window.partitionBy(*key)), F.lit(-1))
    seen = on.withColumn("last_hit", last_hit)
    final = F.max(F.struct("stage", (F.col("status") == "hit").alias("hit")))["hit"]
    after = F.min(F.when((F.col("stage") > F.col("last_hit")) & F.col("status").isin("miss", "unknown"), F.struct("stage", "status")))
    out = seen.groupBy(*key).agg(final.alias("final_covered"), F.max("last_hit").alias("last_hit"), after.alias("loss"))
    return out.select(
        *key, "final_covered", F.when(F.col("last_hit") >= 0, F.col("last_hit")).alias("last_visible"),
        F.when(F.col("final_covered"), F.lit(None)).when(F.col("loss")["status"] == "miss", F.col("loss")["stage"].cast("string")).otherwise("unknown").alias("first_loss"),
    )


def split_bucket(group: Column, seed: str) -> Column:
    """The first eight bytes of sha256(seed:group), modulo 100."""
    head = F.conv(F.substring(F.sha2(F.concat(F.lit(seed + ":"), group), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (head % F.lit(100).cast("decimal(20,0)")).cast("long")


def assign_splits(rows: DataFrame, group: str, seed: str = "seed") -> DataFrame:
    """A split for every group: 80/10/10 by hash, within what all its rows allow; a group lies in one split."""
    allowed = rows.groupBy(group).agg(F.bool_and("train_allowed").alias("train_ok"), F.bool_and("evaluation_allowed").alias("eval_ok"))
    bucket = split_bucket(F.col(group).cast("string"), seed)
    wish = F.when(bucket < 80, "train").when(bucket < 90, "validation").otherwise("test")
    kept = F.when((F.col("wish") == "train") & F.col("train_ok"), "train").when((F.col("wish") != "train") & F.col("eval_ok"), F.col("wish"))
    split = F.when(F.col("train_ok") | F.col("eval_ok"), kept.when(F.col("train_ok"), "train").otherwise("test"))
    return allowed.withColumn("wish", wish).select(group, split.alias("split"))
