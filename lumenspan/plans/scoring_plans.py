"""Corrections scored against gold, and needles found approximately in whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corrections import case_scores, score_corrections
from ..operators.fuzzy_joins import fuzzy_occurrences
from ..sources.corpus import table
from .registry import query

#: Words of every turn with their places: word, next words, start and end in characters.
WORDS = """SELECT conv_id AS case_id, CAST(turn AS BIGINT) AS evidence_index, concat(conv_id, '-', turn) AS chunk_id, pos, word, start_char, start_char + length(word) AS end_char,
        lead(word, 1) OVER w AS next1, lead(word, 2) OVER w AS next2, lead(word, 3) OVER w AS next3
    FROM (SELECT conv_id, turn, pos, word, CAST(sum(length(word) + 1) OVER (PARTITION BY conv_id, turn ORDER BY pos) - length(word) - 1 AS INT) AS start_char
        FROM (SELECT conv_id, turn, posexplode(split(text, ' ')) AS (pos, word) FROM {conversations}))
    WINDOW w AS (PARTITION BY conv_id, turn ORDER BY pos)"""

#: Every fourth word is taken for misheard; it should be reversed, or be in capitals.
GOLD = """SELECT case_id, evidence_index, chunk_id, row_number() OVER (PARTITION BY case_id ORDER BY evidence_index, pos) AS gold_index, start_char, end_char,
        array(reverse(word), upper(word)) AS accepted, CASE WHEN pos % 8 = 0 THEN 1.0D ELSE 0.5D END AS weight
    FROM {words} WHERE pos % 4 = 0 AND length(word) > 2"""

#: Some are corrected, some nearly, some wrongly or not at all; others with the words after them, or together with the next one.
PREDICTED = """SELECT case_id, evidence_index, chunk_id, row_number() OVER (PARTITION BY case_id ORDER BY evidence_index, pos, kind) AS prediction_index, start_char, start_char + length(original) AS end_char, original, resolved
    FROM (SELECT *, inline(array(
            struct(0 AS kind, word AS original, CASE pos % 5 WHEN 0 THEN reverse(word) WHEN 1 THEN concat(reverse(word), 'e') WHEN 2 THEN 'wrong' WHEN 3 THEN upper(word) END AS resolved),
            struct(1 AS kind, concat_ws(' ', word, next1) AS original, CASE WHEN pos % 24 = 8 THEN concat_ws(' ', reverse(word), next1) END AS resolved),
            struct(2 AS kind, concat_ws(' ', word, next1, next2, next3) AS original, CASE WHEN pos % 12 = 4 THEN concat_ws(' ', concat(reverse(word), 'a'), next1, next2, upper(next3)) END AS resolved)))
        FROM {words} WHERE pos % 4 = 0 AND length(word) > 2)
    WHERE resolved IS NOT NULL"""


def corrections(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(gold, predictions, sources) of every conversation: its turns are the chunks."""
    turns = table(spark, sf_dir, "conversations").where("text is not null")
    words = spark.sql(WORDS, conversations=turns.repartition("conv_id"))  # words and numbers are counted where a conversation's turns are
    sources = turns.select(F.col("conv_id").alias("case_id"), F.col("turn").cast("long").alias("evidence_index"), F.concat("conv_id", F.lit("-"), "turn").alias("chunk_id"), F.col("text").alias("source_text"))
    return spark.sql(GOLD, words=words), spark.sql(PREDICTED, words=words), sources


@query()
def rows_only_correction_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall and precision sums of every case: strict by exact matches, relaxed by fuzzy ones too, with shared credit."""
    return case_scores(*score_corrections(*corrections(spark, sf_dir)))


@query()
def rows_only_prediction_credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each prediction is worth, and which gold it served."""
    return score_corrections(*corrections(spark, sf_dir))[1]


@query()
def rows_only_fuzzy_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the two longest neighbouring words of each benchmark item stand in the documents, give or take some characters."""
    words = table(spark, sf_dir, "benchmark").select("item_id", F.split("text", r"\s+").alias("w")).where("size(w) > 1")
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.array_join(F.slice("w", i, F.lit(2)), " "))
    longest = words.select("item_id", F.explode(pairs).alias("p")).groupBy("item_id").agg(F.max_by("p", F.struct(F.length("p"), "p")).alias("needle"))
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")
    return fuzzy_occurrences(longest.select(F.col("item_id").alias("needle_id"), "needle"), texts, 90.0)
