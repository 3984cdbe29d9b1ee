"""A corpus pipeline of five operators, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.llm import exact_dedup, language_id, mixing, ngram_join, sentencepiece_bpe
from lumenspan.llm.common import new_path, table
from lumenspan.llm.queries import piece_model

#: Documents stay if their language is told with at least this posterior probability.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of which no learned language is likely, go.

    Trained on the documents at hand whose id is not held out.  A null text
    has no letter.  Other columns stay as they are.
    """
    model = piece_model()
    trained = language_id.train(docs.where(~language_id.is_held_out()), model)
    return language_id.keep_identified(docs, trained, model, LEAST_SCORE)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by shingle similarity the one with the smallest id stays."""
    return ngram_join.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids_sha256 and decoded_sha256 of every row of the mix."""
    return sentencepiece_bpe.encode_decode(docs, piece_model(), keep=["source"])


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Language identification and the shuffled order of the mix can't be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
