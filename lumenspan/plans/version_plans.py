"""Versions by content, artifacts, normal forms, lanes that fail."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieval as R
from ..sources.artifacts import read_artifact, write_artifact
from ..sources.corpus import ctes, table, view
from ..sources.snapshots import shared_folder
from .registry import query

CONFIG = """'{"limits":{"prompt":' || prompt_tokens // 5 || '},"operation":"' || operation || '","stages":["' || operation || '","' || status || '"]}'"""


@query(ctes("inv") + f""", c AS (SELECT id, run_id, started_at, sha256({CONFIG}) AS checksum FROM inv), f AS (SELECT checksum, min((started_at, id)) AS first, count(*) AS invocations, count(DISTINCT run_id) AS runs FROM c GROUP BY 1)
    SELECT checksum, CAST(row_number() OVER (ORDER BY first) AS BIGINT) AS version, invocations, runs FROM f""")
def config_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each configuration that was ever run is one version, named by its content and numbered as first seen."""
    config = F.struct(F.struct((F.floor(F.col("prompt_tokens") / 5)).cast("long").alias("prompt")).alias("limits"), "operation", F.array("operation", "status").alias("stages"))
    rows = view(spark, sf_dir, "inv").select("id", "run_id", "started_at", F.sha2(F.to_json(config), 256).alias("checksum"))
    found = rows.groupBy("checksum").agg(F.min(F.struct("started_at", "id")).alias("first"), F.count("*").alias("invocations"), F.count_distinct("run_id").alias("runs"))
    number = F.row_number().over(Window.orderBy("first"))  # configurations are written by people, and few
    return found.select("checksum", number.cast("long").alias("version"), "invocations", "runs")


@query("SELECT doc_id, quality, toxic FROM labels")
def artifact_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels written as an artifact and read again, each row checked against its digest."""
    root = shared_folder(spark, "artifacts")
    path = write_artifact(table(spark, sf_dir, "labels"), root, "labels")
    return read_artifact(spark, path, "doc_id long, quality int, toxic int")


@query(r"""SELECT doc_id, md5(regexp_replace(lower(text), '[\p{P}\p{S}\s]', '', 'g')) AS speech, md5(trim(text)) AS strict FROM documents""")
def evaluation_normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as transcripts are compared: without letter case, marks and blanks, or only in canonical form; half of them come decomposed or in full width."""
    narrow = "".join(map(chr, range(0x30, 0x7F)))
    wide = F.translate("text", narrow, "".join(chr(ord(c) + 0xFEE0) for c in narrow))
    decomposed = F.translate(F.regexp_replace("text", "é", "é"), "", "")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(T.normalizer("zh_asr", 1)(F.when(F.col("doc_id") % 2 == 1, wide).otherwise(F.col("text")))).alias("speech"), F.md5(T.normalizer("strict", 1)(decomposed)).alias("strict")
    )


@query(r"""WITH f AS (SELECT conv_id, turn, trim(regexp_replace(replace(lower('GPT 模 型 ' || text || '  第 1 章'), 'ß', 'ss'), '\s+', ' ', 'g')) AS t FROM conversations)
    SELECT conv_id, turn, md5(regexp_replace(regexp_replace(t, '([a-z0-9]) ([一-鿿])', '\1\2', 'g'), '([一-鿿]) ([a-z0-9])', '\1\2', 'g')) AS form FROM f""")
def expression_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expressions as they are compared: folded, blanks collapsed, none between Han and Latin characters."""
    text = F.concat(F.lit("ＧＰＴ 模 型 "), "text", F.lit("  第 １ 章"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(T.normalize_expression(text)).alias("form"))


@query("""WITH v AS (SELECT doc_id AS chunk_id, row_number() OVER (ORDER BY n_chars, doc_id) AS rank FROM documents ORDER BY rank LIMIT 20), l AS (SELECT doc_id AS chunk_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents ORDER BY rank LIMIT 20)
    SELECT 'lexical' AS failed, chunk_id, round(0.7::DOUBLE / (60 + rank), 9) AS score FROM v UNION ALL SELECT 'vector', chunk_id, round(0.1::DOUBLE / (60 + rank), 9) FROM l""")
def failed_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches one of whose lanes fails while it runs: it is left empty, and the other keeps its own weight."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "n_chars", F.try_divide(F.lit(1.0), "n_chars").alias("score"))
    broken = docs.withColumn("score", F.raise_error(F.lit("the index is damaged")).cast("double"))
    lane = lambda df, *order: R.ranked(df.orderBy(*order).limit(20), *order)
    short = lambda df: lane(df, F.asc_nulls_last("n_chars"), F.asc_nulls_last("chunk_id"))
    long = lambda df: lane(df, F.desc_nulls_last("n_chars"), F.asc_nulls_last("chunk_id"))
    tried = lambda build: R.tried_lane(build, shared_folder(spark, "lane"))[0]
    ways = {"lexical": ([tried(lambda: short(docs))], [tried(lambda: long(broken))]), "vector": ([tried(lambda: short(broken))], [tried(lambda: long(docs))])}
    found = [R.search(v, x).select(F.lit(way).alias("failed"), "chunk_id", F.round("score", 9).alias("score")) for way, (v, x) in ways.items()]
    return found[0].unionByName(found[1])
