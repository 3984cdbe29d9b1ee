"""Lifecycles, queues, answer assembly and text forms over the canonical views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieval as R
from ..operators import state as M
from ..sources.corpus import NOW, ctes, table, view
from .registry import oracle_of, query



def _now():
    """The fixed clock; made when a query runs, as columns need a session."""
    return F.expr(NOW.replace("TIMESTAMP", "TIMESTAMP_NTZ"))


@query(ctes("utt") + """, n AS (SELECT recording_id, utterance_index, md5(text) AS h FROM utt WHERE recording_id % 2 = 0 AND utterance_index % 4 <> 3),
    r AS (SELECT * FROM n UNION ALL SELECT recording_id, utterance_index, md5('old ' || text) FROM utt WHERE recording_id % 2 <> 0)
    SELECT recording_id, utterance_index, h AS content_hash, recording_id % 2 <> 0 OR utterance_index % 5 = 0 AS has_vector FROM r""")
def upsert_with_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows replace those of their recordings; a vector of a text that is gone goes too."""
    utt = view(spark, sf_dir, "utt")
    hashed = lambda text: utt.select("recording_id", "utterance_index", F.md5(text).alias("content_hash"))
    old, new = hashed(F.concat(F.lit("old "), "text")), hashed(F.col("text")).where("recording_id % 2 = 0 and utterance_index % 4 <> 3")
    vectors = hashed(F.when(F.expr("recording_id % 2 = 0 and utterance_index % 5 = 0"), F.col("text")).otherwise(F.concat(F.lit("old "), "text")))
    rows, kept = M.replace_pruned(old, new, vectors, "recording_id", "utterance_index")
    key = ["recording_id", "utterance_index", "content_hash"]
    return rows.join(kept.withColumn("has_vector", F.lit(True)), key, "left").select(*key, F.coalesce("has_vector", F.lit(False)).alias("has_vector"))


@query("SELECT doc_id, sha256(text) AS content_hash, CASE WHEN doc_id % 7 = 0 THEN 'new' ELSE 'changed' END AS reason FROM documents WHERE doc_id % 7 = 0 OR doc_id % 10 = 0")
def document_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose stored hash is missing or stale."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = docs.where("doc_id % 7 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit(" old"))).otherwise(F.col("text")), 256).alias("content_hash"))
    due = M.reindex(docs, stored, "doc_id", F.sha2("text", 256)).join(stored.select("doc_id", F.lit(True).alias("known")), "doc_id", "left")
    return due.select("doc_id", "content_hash", F.when(F.col("known"), "changed").otherwise("new").alias("reason"))


LEASE = "CASE WHEN event_id % 4 = 1 THEN created_at + INTERVAL 40 DAY WHEN event_id % 4 = 2 THEN created_at END"


@query(ctes("obx") + f""", p AS (SELECT *, {LEASE} AS lease_until FROM obx WHERE NOT published AND NOT exhausted), h AS (SELECT *, row_number() OVER (PARTITION BY aggregate_id ORDER BY created_at, event_id) AS n FROM p)
    SELECT aggregate_id, event_id FROM h WHERE n = 1 AND (lease_until IS NULL OR lease_until <= {NOW})""")
def leased_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.leased(view(spark, sf_dir, "obx").withColumn("lease_until", F.expr(LEASE)), _now()).select("aggregate_id", "event_id")


@query("""WITH e AS (SELECT user_id, event_id, event_type, event_type = 'purchase' AND event_id % 5 = 0 AS ends FROM events)
    SELECT user_id, CASE WHEN bool_or(ends) THEN min(event_id) FILTER (WHERE ends) ELSE max(event_id) END AS event_id,
    CASE WHEN bool_or(ends) THEN arg_min(event_type, event_id) FILTER (WHERE ends) ELSE arg_max(event_type, event_id) END AS event_type, bool_or(ends) AS terminal FROM e GROUP BY 1""")
def fenced_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return M.fenced(e, "user_id", "event_id", F.expr("event_type = 'purchase' and event_id % 5 = 0"))


@query("""WITH c AS (SELECT user_id, min(event_id) AS since FROM events WHERE event_type = 'error' AND value > 100 GROUP BY 1)
    SELECT user_id, count(*) AS tasks, count(*) FILTER (WHERE event_id > since) AS cancelled FROM events LEFT JOIN c USING (user_id) GROUP BY 1""")
def cancelled_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks that come after their scope was cancelled are cancelled on arrival."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    out = M.cancelled_on_arrival(e, e.where("event_type = 'error' and value > 100").select("user_id", "event_id"), "user_id", "event_id")
    return out.groupBy("user_id").agg(F.count("*").alias("tasks"), F.count_if("cancelled").alias("cancelled"))


@query(f"SELECT event_id, event_type FROM events WHERE event_type NOT IN ('purchase', 'error') OR ts + INTERVAL 604800 SECOND > {NOW}")
def expired_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ended states stay for seven days."""
    e = table(spark, sf_dir, "events").withColumn("ended", F.when(F.col("event_type").isin("purchase", "error"), F.col("ts")))
    return M.expire(e, "ended", _now(), 604_800).select("event_id", "event_type")


@query("""SELECT event_type AS queue, arg_min(event_id, (ts, event_id)) AS claimed, count(*) AS waiting FROM events WHERE event_id % 3 = 1 GROUP BY 1""")
def claimed_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest queued row of each queue, and how long the queue is."""
    queued = table(spark, sf_dir, "events").where("event_id % 3 = 1")
    return queued.groupBy(F.col("event_type").alias("queue")).agg(F.min(F.struct("ts", "event_id"))["event_id"].alias("claimed"), F.count("*").alias("waiting"))


@query("""SELECT o_orderkey AS id, o_orderstatus IN ('O', 'P') AS may_cancel, o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O') AS may_delete FROM orders""")
def status_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is queued or runs may be cancelled; what has ended and has no open child may be deleted."""
    busy = table(spark, sf_dir, "lineitem").where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("id")).distinct().withColumn("busy", F.lit(True))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus").join(busy, "id", "left")
    return o.select("id", F.col("o_orderstatus").isin("O", "P").alias("may_cancel"), ((F.col("o_orderstatus") == "F") & F.col("busy").isNull()).alias("may_delete"))


@query("""WITH t AS (SELECT l_orderkey AS case_id, l_suppkey % 3 AS target, count(*) FILTER (WHERE l_returnflag = 'R') AS corrections FROM lineitem GROUP BY 1, 2)
    SELECT case_id, count(*) AS targets, CASE WHEN count(*) > 2 THEN 'too many targets' WHEN min(corrections) = 0 THEN 'target without correction' ELSE 'valid' END AS verdict FROM t GROUP BY 1""")
def case_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case has one or two targets, and each at least one correction."""
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("case_id"), (F.col("l_suppkey") % 3).alias("target")).agg(F.count_if(F.col("l_returnflag") == "R").alias("corrections"))
    verdict = F.when(F.count("*") > 2, "too many targets").when(F.min("corrections") == 0, "target without correction").otherwise("valid")
    return t.groupBy("case_id").agg(F.count("*").alias("targets"), verdict.alias("verdict"))


@query("""WITH a AS (SELECT conv_id, turn, turn % 6 AS ident, role = 'system' AS abstain, length(text) > 150 AS filled, CASE WHEN turn % 3 = 0 THEN turn + 2 ELSE turn END AS ref FROM conversations),
    d AS (SELECT conv_id, count(*) - count(DISTINCT ident) AS n FROM a GROUP BY 1)
    SELECT conv_id, 'repeated id' AS violation, n FROM d WHERE n > 0
    UNION ALL SELECT conv_id, 'abstains with content', count(*) FROM a WHERE abstain AND filled GROUP BY 1
    UNION ALL SELECT conv_id, 'reference outside the case', count(*) FROM a WHERE NOT EXISTS (SELECT 1 FROM a b WHERE b.conv_id = a.conv_id AND b.turn = a.ref) GROUP BY 1""")
def annotation_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids are unique in a case, an abstention is empty, references stay inside the case."""
    a = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", (F.col("turn") % 6).alias("ident"), (F.col("role") == "system").alias("abstain"), (F.length("text") > 150).alias("filled"),
        F.when(F.col("turn") % 3 == 0, F.col("turn") + 2).otherwise(F.col("turn")).alias("ref"),
    )
    repeated = a.groupBy("conv_id").agg((F.count("*") - F.count_distinct("ident")).alias("n")).where("n > 0")
    full = a.where("abstain and filled").groupBy("conv_id").agg(F.count("*").alias("n"))
    astray = a.join(a.select("conv_id", F.col("turn").alias("ref")), ["conv_id", "ref"], "left_anti").groupBy("conv_id").agg(F.count("*").alias("n"))
    named = [x.select("conv_id", F.lit(name).alias("violation"), "n") for name, x in (("repeated id", repeated), ("abstains with content", full), ("reference outside the case", astray))]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query("SELECT c_custkey AS id, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'archived' ELSE 'deleted' END AS outcome FROM customer")
def archive_or_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has versions is archived, not deleted."""
    used = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).distinct().withColumn("used", F.lit(True))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).join(used, "id", "left").select("id", F.when(F.col("used"), "archived").otherwise("deleted").alias("outcome"))


@query(ctes("utt") + """, k AS (SELECT DISTINCT recording_id, cluster FROM utt), r AS (SELECT DISTINCT recording_id, cluster, 'name ' || cluster AS name FROM utt WHERE recording_id % 2 = 0 UNION ALL SELECT DISTINCT recording_id, 'system', 'name system' FROM utt WHERE recording_id % 2 = 1),
    b AS (SELECT DISTINCT recording_id FROM r WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.recording_id = r.recording_id AND k.cluster = r.cluster))
    SELECT k.recording_id, k.cluster, r.name, b.recording_id IS NOT NULL AS rejected FROM k LEFT JOIN b USING (recording_id) LEFT JOIN r ON r.recording_id = k.recording_id AND r.cluster = k.cluster AND b.recording_id IS NULL""")
def mapping_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names for a recording's clusters; a request that names an unknown cluster is rejected as a whole."""
    known = view(spark, sf_dir, "utt").select("recording_id", "cluster").distinct()
    wanted = known.where("recording_id % 2 = 0").unionByName(known.where("recording_id % 2 = 1").select("recording_id", F.lit("system").alias("cluster")).distinct())
    bad = wanted.join(known, ["recording_id", "cluster"], "left_anti").select("recording_id").distinct()
    names = wanted.join(bad, "recording_id", "left_anti").withColumn("name", F.concat(F.lit("name "), "cluster"))
    out = known.join(names, ["recording_id", "cluster"], "left").join(bad.withColumn("bad", F.lit(True)), "recording_id", "left")
    return out.select("recording_id", "cluster", "name", F.coalesce("bad", F.lit(False)).alias("rejected"))


@query("""SELECT o_custkey AS id, sha256('{"query":"orders of ' || o_custkey || '","scope":[' || string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) || ']}') AS input_hash FROM orders GROUP BY 1""")
def input_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request's hash does not depend on the order of its scope."""
    scope = F.sort_array(F.collect_list("o_orderkey")).alias("scope")
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(scope)
    canonical = F.to_json(F.struct(F.concat(F.lit("orders of "), F.col("id").cast("string")).alias("query"), "scope"))
    return o.select("id", F.sha2(canonical, 256).alias("input_hash"))


#: Fixed value: the namespace of names that are URLs, of the standard on UUIDs.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
_HEX = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', 1 + ({}) % 4, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"


@query(f"WITH s AS (SELECT page_id, sha1(unhex('{URL_NAMESPACE}') || encode(url)) AS h FROM pages) SELECT page_id, " + _HEX.format("('0x' || substr(h, 17, 1))::INTEGER") + " AS uuid FROM s")
def name_uuids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name-based UUIDs (version 5), natively."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode("url", "UTF-8")))
    return table(spark, sf_dir, "pages").select("page_id", h.alias("h")).select("page_id", F.expr(_HEX.format("cast(conv(substr(h, 17, 1), 16, 10) as int)")).alias("uuid"))


@query("""WITH s AS (SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) / len(embedding)) AS rms, list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) AS peak FROM embeddings)
    SELECT vec_id, round(rms, 9) AS rms, round(peak, 9) AS peak, round(least(20 * log10(0.1 / rms), 20 * log10(0.99 / peak)), 6) AS gain_db FROM s WHERE rms > 0""")
def sample_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root mean square and peak of sample windows, and the gain to a tenth that does not clip."""
    x = F.transform("embedding", lambda x: x.cast("double"))
    rms = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v) / F.size("embedding"))
    e = table(spark, sf_dir, "embeddings").select("vec_id", rms.alias("rms"), F.array_max(F.transform(x, F.abs)).alias("peak")).where("rms > 0")
    gain = F.least(20 * F.log10(0.1 / F.col("rms")), 20 * F.log10(0.99 / F.col("peak")))
    return e.select("vec_id", F.round("rms", 9).alias("rms"), F.round("peak", 9).alias("peak"), F.round(gain, 6).alias("gain_db"))


@query("""SELECT label, round(max(s), 6) AS score FROM (SELECT label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS s FROM embeddings WHERE vec_id <> 0) x
    GROUP BY 1 HAVING max(s) >= 0.3 ORDER BY max(s) DESC, label LIMIT 3""")
def best_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best documents of at least 0.30, a document scoring as its best vector."""
    from ..functions.similarity import cosine
    from .retrieval_plans import query_vector

    q = F.array(*[F.lit(float(x)) for x in query_vector(spark, sf_dir)])
    scored = table(spark, sf_dir, "embeddings").where("vec_id <> 0").select("label", cosine(F.col("embedding"), q).alias("s"))
    return scored.groupBy("label").agg(F.max("s").alias("m")).where("m >= 0.3").orderBy(F.desc("m"), "label").limit(3).select("label", F.round("m", 6).alias("score"))


@query(ctes("utt") + """, r AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY length(text) DESC, utterance_index) AS n FROM utt)
    SELECT recording_id, CAST(n AS BIGINT) AS index, CASE WHEN utterance_index % 2 = 0 THEN 'vector' ELSE 'lexical' END AS match_type, round(1.0 / (60 + n), 9)::DOUBLE AS score,
    '/recordings/' || recording_id || '?t=' || start_ms // 1000 || '&end=' || (end_ms + 999) // 1000 AS url FROM r WHERE n <= 5""")
def evidence_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence as it is shown: its number, score, type, and a link to its time."""
    n = F.row_number().over(Window.partitionBy("recording_id").orderBy(F.desc(F.length("text")), "utterance_index"))
    top = view(spark, sf_dir, "utt").withColumn("n", n).where("n <= 5")
    url = F.concat(F.lit("/recordings/"), F.col("recording_id").cast("string"), F.lit("?t="), F.expr("start_ms div 1000").cast("string"), F.lit("&end="), F.expr("(end_ms + 999) div 1000").cast("string"))
    return top.select("recording_id", F.col("n").cast("long").alias("index"), F.when(F.col("utterance_index") % 2 == 0, "vector").otherwise("lexical").alias("match_type"), F.round(1.0 / (60 + F.col("n")), 9).alias("score"), url.alias("url"))


def _lanes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(vector, lexical): two ranked lanes of documents that overlap, by size from either end."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "n_chars")
    a = docs.where("chunk_id % 3 <> 1").orderBy("n_chars", "chunk_id").limit(20).withColumn("score", 1.0 / (1 + F.col("n_chars")))
    b = docs.where("chunk_id % 3 <> 2").orderBy("n_chars", "chunk_id").limit(20).withColumn("score", F.lit(0.5))
    return R.ranked(a, "n_chars", "chunk_id"), R.ranked(b, "n_chars", "chunk_id")


LANES = """d AS (SELECT doc_id AS chunk_id, n_chars FROM documents),
    v AS (SELECT chunk_id, row_number() OVER (ORDER BY n_chars, chunk_id) AS rank FROM d WHERE chunk_id % 3 <> 1 ORDER BY rank LIMIT 20),
    l AS (SELECT chunk_id, row_number() OVER (ORDER BY n_chars, chunk_id) AS rank FROM d WHERE chunk_id % 3 <> 2 ORDER BY rank LIMIT 20),
    f AS (SELECT chunk_id, sum(w / (60 + rank)) AS s, min(rank) AS best FROM (SELECT chunk_id, rank, 0.7::DOUBLE AS w FROM v UNION ALL SELECT chunk_id, rank, 0.1::DOUBLE FROM l) x GROUP BY 1),
    fused AS (SELECT chunk_id, s, row_number() OVER (ORDER BY s DESC, best, CAST(chunk_id AS VARCHAR)) AS n FROM f ORDER BY n LIMIT 20)"""


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    vector, lexical = _lanes(spark, sf_dir)
    return R.fuse([vector], [lexical], 20)


@query(f"""WITH {LANES}, p AS (SELECT chunk_id, rank FROM l WHERE rank <= 10)
    SELECT f.chunk_id, p.chunk_id IS NOT NULL AS by_profile, FALSE AS appended FROM fused f LEFT JOIN p USING (chunk_id) UNION ALL SELECT chunk_id, TRUE, TRUE FROM p WHERE chunk_id NOT IN (SELECT chunk_id FROM fused)""")
def profile_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows found over the document lane are flagged, and those that fusion lost are appended."""
    profile = _lanes(spark, sf_dir)[1].where("rank <= 10").select("chunk_id")
    return R.retain_lane(_fused(spark, sf_dir).select("chunk_id"), profile, "by_profile")


@query(f"""WITH {LANES}, r AS (SELECT chunk_id, row_number() OVER (ORDER BY chunk_id % 17 DESC, chunk_id) AS m FROM fused QUALIFY m <= 8), p AS (SELECT chunk_id, n FROM fused WHERE chunk_id % 5 = 0),
    u AS (SELECT chunk_id, 0 AS g, m AS n FROM r UNION ALL SELECT chunk_id, 1, n FROM p WHERE chunk_id NOT IN (SELECT chunk_id FROM r))
    SELECT chunk_id, g = 1 AS protected, CAST(row_number() OVER (ORDER BY g, n) AS BIGINT) AS index FROM u""")
def rerank_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reranking kept, then protected evidence that it lost, numbered anew."""
    fused = R.ranked(_fused(spark, sf_dir).select("chunk_id", "score", "best_rank"), F.desc("score"), "best_rank", F.col("chunk_id").cast("string"))
    kept = R.ranked(fused.select("chunk_id"), F.desc(F.col("chunk_id") % 17), "chunk_id").where("rank <= 8")
    return R.retain_after_rerank(kept, fused.where("chunk_id % 5 = 0").select("chunk_id", "rank"))


@query(f"""WITH {LANES}, x AS (SELECT 'lexical failed' AS way, chunk_id, 0.7::DOUBLE / (60 + rank) AS s FROM v UNION ALL SELECT 'vector failed', chunk_id, 0.1::DOUBLE / (60 + rank) FROM l UNION ALL SELECT 'hybrid off', chunk_id, 0.7::DOUBLE / (60 + rank) FROM v)
    SELECT way, chunk_id, round(s, 9) AS score FROM x""")
def degraded_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lane that failed is empty and keeps its weight; without hybrid search there is the vector lane only."""
    vector, lexical = _lanes(spark, sf_dir)
    ways = {"lexical failed": R.search([vector], [None]), "vector failed": R.search([None], [lexical]), "hybrid off": R.search([vector], [lexical], hybrid=False)}
    named = [found.select(F.lit(way).alias("way"), "chunk_id", F.round("score", 9).alias("score")) for way, found in ways.items()]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query("""WITH h AS (SELECT conv_id, count(*) FILTER (WHERE role = 'user' AND turn >= 4) AS narrow, count(*) FILTER (WHERE role = 'user') AS wide FROM conversations GROUP BY 1)
    SELECT conv_id, conv_id % 3 <> 0 AND narrow = 0 AS retried, CASE WHEN conv_id % 3 = 0 OR narrow = 0 THEN wide ELSE narrow END AS hits FROM h""")
def retry_without_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that found nothing inside their history scope are run once more without it; others are not."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn")
    requests = table(spark, sf_dir, "conversations").select("conv_id", (F.col("conv_id") % 3 != 0).alias("scoped")).distinct()
    first = requests.join(c, "conv_id", "left").groupBy("conv_id", "scoped").agg(F.count_if(F.col("turn").isNotNull() & (~F.col("scoped") | (F.col("turn") >= 4))).alias("n"))
    again = first.where("scoped and n = 0").select("conv_id").join(c, "conv_id", "left").groupBy("conv_id").agg(F.count("turn").alias("m"))
    return first.join(again, "conv_id", "left").select("conv_id", F.col("m").isNotNull().alias("retried"), F.coalesce("m", "n").alias("hits"))


@query(lambda: "SELECT case_id, count(*) AS evidence, count(*) FILTER (WHERE first_loss = '0') AS lost_first, count(*) FILTER (WHERE first_loss IN ('1', '2', '3')) AS lost_later, count(*) FILTER (WHERE first_loss = 'unknown') AS unknown, "
       "CASE WHEN bool_and(final_covered) THEN 'full' WHEN bool_or(final_covered) THEN 'partial' ELSE 'no_hit' END AS coverage FROM (" + oracle_of("loss_journey") + ") j GROUP BY 1")
def loss_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each case loses its evidence first, and how much of it is covered in the end."""
    from .evaluation_plans import loss_journey

    lost = lambda *stages: F.count_if(F.col("first_loss").isin(*stages))
    coverage = F.when(F.bool_and("final_covered"), "full").when(F.bool_or("final_covered"), "partial").otherwise("no_hit")
    return loss_journey(spark, sf_dir).groupBy("case_id").agg(F.count("*").alias("evidence"), lost("0").alias("lost_first"), lost("1", "2", "3").alias("lost_later"), lost("unknown").alias("unknown"), coverage.alias("coverage"))


@query(lambda: "SELECT split, count(DISTINCT source) AS groups, count(*) AS cases, CAST(sum(n_chars) AS BIGINT) AS duration FROM documents JOIN (" + oracle_of("split_assignment") + ") s USING (source) WHERE split IS NOT NULL GROUP BY 1")
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .evaluation_plans import split_assignment

    rows = table(spark, sf_dir, "documents").select("source", "n_chars").join(split_assignment(spark, sf_dir), "source").where("split is not null")
    return rows.groupBy("split").agg(F.count_distinct("source").alias("groups"), F.count("*").alias("cases"), F.sum("n_chars").alias("duration"))


@query(r"""SELECT doc_id, md5(left(trim(regexp_extract(regexp_replace(text, '^\s*[-*•]\s+', ''), '^([^.!?。！？]*[.!?。！？]?)', 1)), 200)) AS lead FROM documents""")
def first_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text's first sentence without its bullet, 200 characters at most."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.first_sentence(F.col("text"))).alias("lead"))


@query(r"""WITH c AS (SELECT conv_id, turn, '[{"type":"text","text":"' || role || '"},{"type":"image"},{"type":"text","text":" says ' || turn || '"}]' AS j FROM conversations)
    SELECT conv_id, turn, role || ' says ' || turn AS text FROM c JOIN conversations USING (conv_id, turn)""")
def block_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of a message's text blocks."""
    block = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    blocks = F.array(block("text", F.col("role")), block("image", F.lit(None).cast("string")), block("text", F.concat(F.lit(" says "), F.col("turn").cast("string"))))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(blocks).alias("j")).select("conv_id", "turn", T.block_text(F.col("j")).alias("text"))


@query("""SELECT event_id, '{"k":' || CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) || ',"type":"' || event_type || '","tags":["' || event_type || '",' || '"' || user_id % 3 || '"]}' AS merged FROM events""")
def json_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored object with fields set and an array built."""
    k = F.get_json_object("props", "$.k").cast("long")
    made = F.struct(k.alias("k"), F.col("event_type").alias("type"), F.array("event_type", (F.col("user_id") % 3).cast("string")).alias("tags"))
    return table(spark, sf_dir, "events").select("event_id", F.to_json(made).alias("merged"))


@query(ctes("utt") + """, r AS (SELECT recording_id, utterance_index, text, utterance_index // 2 AS segment, start_ms, end_ms FROM utt)
    SELECT recording_id, segment, md5(string_agg(text, '' ORDER BY utterance_index)) AS text, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM r WHERE trim(text) <> '' GROUP BY 1, 2""")
def assembled_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens joined to the segments they belong to, in order; empty segments go."""
    tokens = view(spark, sf_dir, "utt").where("trim(text) <> ''").withColumn("segment", F.expr("utterance_index div 2"))
    whole = F.expr("listagg(text, '') WITHIN GROUP (ORDER BY utterance_index)")
    return tokens.groupBy("recording_id", "segment").agg(F.md5(whole).alias("text"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


@query("""SELECT topic, split_part(topic, '.', 1) AS family, CASE WHEN topic LIKE '%.dlq' THEN 'dead letter' WHEN topic LIKE '%.retry' THEN 'retry' WHEN topic LIKE '%.cancel' THEN 'cancel' ELSE 'work' END AS kind
    FROM (SELECT unnest(""" + repr(list(M.TOPICS)) + ") AS topic) t")
def topic_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("topic")
    kind = F.when(t.endswith(".dlq"), "dead letter").when(t.endswith(".retry"), "retry").when(t.endswith(".cancel"), "cancel").otherwise("work")
    return spark.createDataFrame([(x,) for x in M.TOPICS], "topic string").select("topic", F.split_part("topic", F.lit("."), F.lit(1)).alias("family"), kind.alias("kind"))
