"""Retrieval over embeddings and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.similarity import cosine, word_similarity_column
from ..operators import retrieval as R
from ..operators.joins import contains_join
from ..sources.corpus import ctes, table, view
from .registry import query

QVEC = "q AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = 0)"
SCORED = QVEC + """, scored AS (SELECT vec_id, label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(qe AS DOUBLE[])) AS s
    FROM embeddings, q WHERE vec_id <> 0)"""


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """One vector, sent to the tasks as a literal."""
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0]


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("vec_id <> 0").select(F.col("vec_id").alias("chunk_id"), "label", "embedding")


@query("WITH " + SCORED + " SELECT vec_id, round(s, 6) AS score FROM scored ORDER BY s DESC, vec_id LIMIT 30")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = R.vector_topk(_vectors(spark, sf_dir), query_vector(spark, sf_dir), 30)
    return top.select(F.col("chunk_id").alias("vec_id"), F.round("score", 6).alias("score"))


@query("WITH " + SCORED + """, top AS (SELECT label, avg(s) AS m FROM scored GROUP BY label ORDER BY round(m, 9) DESC, label LIMIT 3),
    r AS (SELECT s.label, vec_id, s, row_number() OVER (PARTITION BY s.label ORDER BY s DESC, vec_id) AS n FROM scored s JOIN top USING (label))
    SELECT label, vec_id, round(s, 6) AS score, CAST(n AS BIGINT) AS place FROM r WHERE n <= 2""")
def profile_then_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in query_vector(spark, sf_dir)])
    scored = _vectors(spark, sf_dir).select("chunk_id", "label", cosine(F.col("embedding"), q).alias("s"))
    top = scored.groupBy("label").agg(F.avg("s").alias("m")).orderBy(F.desc(F.round("m", 9)), "label").limit(3).select("label")
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("s"), "chunk_id"))
    best = scored.join(top, "label", "left_semi").withColumn("n", place).where("n <= 2")
    return best.select("label", F.col("chunk_id").alias("vec_id"), F.round("s", 6).alias("score"), F.col("n").cast("long").alias("place"))


LEXICAL = """lex AS (SELECT chunk_id, recording_id, length(text) AS n FROM chunk WHERE contains(lower(text), 'the ') AND contains(lower(text), 'benchmark') = FALSE)"""


@query(ctes("chunk") + """ SELECT chunk_id, CASE WHEN strpos(lower(text), 'est') > 0 THEN 1 ELSE 0 END AS exact, n_chars
    FROM chunk ORDER BY exact DESC, n_chars, chunk_id LIMIT 30""")
def lexical_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = F.when(F.instr(F.lower("text"), "est") > 0, 1).otherwise(0)
    return view(spark, sf_dir, "chunk").select("chunk_id", exact.alias("exact"), "n_chars").orderBy(F.desc("exact"), "n_chars", "chunk_id").limit(30)


FUSED = SCORED + """, v AS (SELECT vec_id AS chunk_id, s AS score, row_number() OVER (ORDER BY s DESC, vec_id) AS rank FROM scored ORDER BY rank LIMIT 30),
    v2 AS (SELECT vec_id AS chunk_id, s AS score, row_number() OVER (ORDER BY s DESC, vec_id) AS rank FROM scored WHERE label % 2 = 0 ORDER BY rank LIMIT 30),
    l AS (SELECT doc_id AS chunk_id, 1.0 / n_chars AS score, row_number() OVER (ORDER BY n_chars, doc_id) AS rank FROM documents
        WHERE strpos(lower(text), 'est') > 0 ORDER BY rank LIMIT 30),
    lanes AS (SELECT chunk_id, rank, 0.7 AS w, 'v' AS f FROM v UNION ALL SELECT chunk_id, rank, 0.2, 'v' FROM v2 UNION ALL SELECT chunk_id, rank, 0.1, 'l' FROM l),
    fused AS (SELECT chunk_id, sum(CAST(w AS DOUBLE) / (60 + rank)) AS s, min(rank) AS best_rank, bool_or(f = 'v') AS hv, bool_or(f = 'l') AS hl FROM lanes GROUP BY 1)"""


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two vector lanes and a lexical one, fused."""
    q = query_vector(spark, sf_dir)
    vectors = _vectors(spark, sf_dir)
    lane = lambda rows: R.ranked(R.vector_topk(rows, q, 30), F.desc("score"), "chunk_id")
    docs = table(spark, sf_dir, "documents").where(F.instr(F.lower("text"), "est") > 0)
    words = docs.select(F.col("doc_id").alias("chunk_id"), (1.0 / F.col("n_chars")).alias("score"), "n_chars").orderBy("n_chars", "chunk_id").limit(30)
    return R.fuse([lane(vectors), lane(vectors.where("label % 2 = 0"))], [R.ranked(words, "n_chars", "chunk_id")], 20)


@query("WITH " + FUSED + """ SELECT chunk_id, round(s, 9) AS score, CAST(best_rank AS BIGINT) AS best_rank,
    CASE WHEN hv AND hl THEN 'hybrid' WHEN hv THEN 'vector' ELSE 'lexical' END AS match_type
    FROM fused ORDER BY s DESC, best_rank, CAST(chunk_id AS VARCHAR) LIMIT 20""")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused(spark, sf_dir).select("chunk_id", F.round("score", 9).alias("score"), "best_rank", "match_type")


@query("WITH " + FUSED + """, f AS (SELECT chunk_id, s FROM fused ORDER BY s DESC, best_rank, CAST(chunk_id AS VARCHAR) LIMIT 20),
    e AS (SELECT doc_id AS chunk_id, item_id AS query, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS rank FROM benchmark b
        JOIN documents d ON strpos(d.text, b.text) > 0),
    first AS (SELECT DISTINCT chunk_id FROM e WHERE rank = 1)
    SELECT chunk_id, 0 AS appended FROM f UNION ALL SELECT chunk_id, 1 FROM first WHERE chunk_id NOT IN (SELECT chunk_id FROM f)""")
def protected_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("passage"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    hits = contains_join(docs, "chunk_id", "text", items, "passage").select("query", "chunk_id", F.col("chunk_id").alias("rank"), F.lit(0.0).alias("score"), F.lit(True).alias("is_exact"))
    return R.retain_protected(fused(spark, sf_dir), hits).select("chunk_id", "appended")


@query("WITH " + SCORED + """, v AS (SELECT vec_id AS chunk_id, row_number() OVER (ORDER BY s DESC, vec_id) AS rank FROM scored ORDER BY rank LIMIT 30),
    top AS (SELECT label, avg(s) AS m FROM scored GROUP BY label ORDER BY round(m, 9) DESC, label LIMIT 3),
    b AS (SELECT vec_id, round(s, 6) AS score, row_number() OVER (PARTITION BY s.label ORDER BY s DESC, vec_id) AS n FROM scored s JOIN top USING (label)),
    p AS (SELECT vec_id AS chunk_id, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM b WHERE n <= 2),
    x AS (SELECT doc_id, n_chars, strpos(lower(text), 'est') > 0 AS exact FROM documents ORDER BY exact DESC, n_chars, doc_id LIMIT 30),
    l AS (SELECT doc_id AS chunk_id, row_number() OVER (ORDER BY n_chars, doc_id) AS rank FROM x WHERE exact),
    lanes AS (SELECT chunk_id, rank, 0.7::DOUBLE AS w, 'v' AS f FROM v UNION ALL SELECT chunk_id, rank, 0.2::DOUBLE, 'v' FROM p UNION ALL SELECT chunk_id, rank, 0.1::DOUBLE, 'l' FROM l),
    fused AS (SELECT chunk_id, sum(w / (60 + rank)) AS s, min(rank) AS best_rank, bool_or(f = 'v') AS hv, bool_or(f = 'l') AS hl FROM lanes GROUP BY 1)
    SELECT chunk_id, round(s, 9) AS score, CAST(best_rank AS BIGINT) AS best_rank, CASE WHEN hv AND hl THEN 'hybrid' WHEN hv THEN 'vector' ELSE 'lexical' END AS match_type
    FROM fused ORDER BY s DESC, best_rank, CAST(chunk_id AS VARCHAR) LIMIT 20""")
def hybrid_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan, vector and lexical lanes, top documents and their chunks, fusion: the flagship."""
    best = profile_then_chunks(spark, sf_dir).select(F.col("vec_id").alias("chunk_id"), "score").orderBy(F.desc("score"), "chunk_id")
    lane = R.ranked(best, F.desc("score"), "chunk_id")
    q = query_vector(spark, sf_dir)
    first = R.ranked(R.vector_topk(_vectors(spark, sf_dir), q, 30), F.desc("score"), "chunk_id")
    words = lexical_exact_topk(spark, sf_dir).where("exact = 1").select("chunk_id", F.lit(1.0).alias("score"), "n_chars")
    out = R.fuse([first, lane], [R.ranked(words, "n_chars", "chunk_id")], 20)
    return out.select("chunk_id", F.round("score", 9).alias("score"), "best_rank", "match_type")


@query("""WITH c AS (SELECT doc_id, source, CAST(ceil(octet_length(encode(regexp_replace(text, '[\\x{3400}-\\x{9fff}\\x{f900}-\\x{faff}]', '', 'g'))) / 4.0) AS BIGINT) + 4
        + length(text) - length(regexp_replace(text, '[\\x{3400}-\\x{9fff}\\x{f900}-\\x{faff}]', '', 'g')) AS tokens FROM documents),
    r AS (SELECT doc_id, source, tokens, CAST(sum(tokens) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM c)
    SELECT * FROM r WHERE running <= 16000""")
def rerank_budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source as many documents, in order, as a token budget allows; each has 4 tokens and more."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", T.token_estimate(F.col("text")).alias("tokens"))
    return R.budget_prefix(rows, "tokens", 16_000, ["doc_id"], "source", least=4).select("doc_id", "source", "tokens", "running")


@query(ctes("seg") + """, r AS (SELECT *, max(end_ms) OVER (PARTITION BY recording_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM seg),
    n AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ms > reach THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS island FROM r)
    SELECT recording_id, CAST(island AS BIGINT) AS island, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS members FROM n GROUP BY 1, 2""")
def overlap_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.islands(view(spark, sf_dir, "seg"), "recording_id").select("recording_id", F.col("island").cast("long").alias("island"), "start_ms", "end_ms", "members")


@query(ctes("rec") + """ SELECT id, u.k AS field, u.v AS value FROM rec, LATERAL (VALUES ('status', status), ('location', location),
    ('owner', CAST(owner AS VARCHAR)), ('workspace', CAST(workspace AS VARCHAR)), ('created_at', CAST(CAST(created_at AS DATE) AS VARCHAR))) u(k, v)
    WHERE u.k <> 'location' OR trim(u.v) <> ''""")
def metadata_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = view(spark, sf_dir, "rec")
    fields = {"status": F.col("status"), "location": F.col("location"), "owner": F.col("owner").cast("string"), "workspace": F.col("workspace").cast("string"), "created_at": F.col("created_at").cast("date").cast("string")}
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), v.alias("value")) for k, v in fields.items()]))
    return rec.select("id", rows.alias("r")).select("id", "r.*").where("field <> 'location' OR trim(value) <> ''")


@query(ctes("utt") + """, r AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY utterance_index) AS n, count(*) OVER (PARTITION BY recording_id) AS all_n FROM utt)
    SELECT recording_id, count(*) AS kept, max(all_n) AS total, min(start_ms) AS start_ms, max(end_ms) AS end_ms,
        CAST(least(300, sum(length(cluster) + 2 + length(text)) + count(*) - 1) AS BIGINT) AS body_chars,
        sum(length(cluster) + 2 + length(text)) + count(*) - 1 > 300 OR max(all_n) > 3 AS truncated, string_agg(DISTINCT cluster, ',' ORDER BY cluster) AS labels
    FROM r WHERE n <= 3 GROUP BY 1""")
def scope_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    utt = view(spark, sf_dir, "utt")
    every = Window.partitionBy("recording_id")
    kept = utt.withColumn("n", F.row_number().over(every.orderBy("utterance_index"))).withColumn("all_n", F.count("*").over(every)).where("n <= 3")
    lines = T.render_lines(F.array_sort(F.collect_list(F.struct("n", F.col("cluster").alias("label"), "text"))))
    out = kept.groupBy("recording_id").agg(
        F.count("*").alias("kept"), F.max("all_n").alias("total"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"),
        lines.alias("body"), F.array_join(F.sort_array(F.collect_set("cluster")), ",").alias("labels"),
    )
    return out.select("recording_id", "kept", "total", "start_ms", "end_ms", F.length(F.left("body", F.lit(300))).cast("long").alias("body_chars"), ((F.length("body") > 300) | (F.col("total") > 3)).alias("truncated"), "labels")


@query()
def rows_only_rank_order_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = view(spark, sf_dir, "seg")
    rows = seg.select("recording_id", F.col("ordinal").alias("rank"), "start_ms", "end_ms", F.concat(F.lit("line "), F.col("cluster").cast("string")).alias("text"), F.when(F.col("cluster") == 0, "vector").otherwise("lexical").alias("match_type"))
    return R.merge_in_rank_order(rows)


@query()
def rows_only_word_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    utt = view(spark, sf_dir, "utt")
    return utt.select("recording_id", "utterance_index", F.round(word_similarity_column(F.lit("the station"), F.col("text")), 6).alias("similarity"), (F.instr("text", "the") > 0).alias("is_exact"))
