"""Scopes, pages, overlays and fan-outs over the canonical views."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import scopes as S
from ..sources.corpus import ctes, table, view
from .registry import query

LINE = "l_linenumber || ':' || l_partkey || ':' || l_suppkey || ':' || CAST(l_quantity AS BIGINT)"


@query(f"""WITH l AS (SELECT l_orderkey, count(*) AS n, md5(string_agg({LINE}, ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)) AS d FROM lineitem GROUP BY 1)
    SELECT o_orderkey AS id, c_name AS owner, coalesce(n, 0) AS children, coalesce(d, md5('')) AS detail FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN l ON l_orderkey = o_orderkey""")
def detail_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each parent with its owner and its ordered children."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q")).alias("r"))
    lines = F.transform(F.sort_array(F.collect_list("r")), lambda r: F.concat_ws(":", r["l_linenumber"], r["l_partkey"], r["l_suppkey"], r["q"]))
    children = items.groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("children"), F.md5(F.array_join(lines, ",")).alias("detail"))
    parents = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("id"), F.col("c_name").alias("owner"))
    return parents.join(children, "id", "left").select("id", "owner", F.coalesce("children", F.lit(0)).alias("children"), F.coalesce("detail", F.md5(F.lit(""))).alias("detail"))


@query("SELECT event_id, event_type FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 100")
def resume_after_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_id > 500").orderBy("event_id").limit(100).select("event_id", "event_type")


CLUSTERS = "c AS (SELECT recording_id, ordinal // 4 AS chunk_index, list(DISTINCT cluster) AS clusters FROM seg GROUP BY 1, 2), p AS (SELECT DISTINCT recording_id, cluster FROM seg WHERE cluster = 1 AND ordinal % 3 = 0)"


@query(ctes("seg") + f", {CLUSTERS} SELECT recording_id, chunk_index FROM c WHERE EXISTS (SELECT 1 FROM p WHERE p.recording_id = c.recording_id AND list_contains(c.clusters, p.cluster))")
def chunk_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks in which a wanted person's cluster speaks."""
    seg = view(spark, sf_dir, "seg")
    chunks = seg.groupBy("recording_id", F.expr("ordinal div 4").alias("chunk_index")).agg(F.collect_set("cluster").alias("clusters"))
    persons = seg.where("cluster = 1 and ordinal % 3 = 0").select("recording_id", "cluster").distinct()
    return S.members_semi(chunks, persons, "recording_id", "clusters", "cluster").select("recording_id", "chunk_index")


@query(ctes("rec") + """ SELECT id, 'resolved' AS scope FROM rec WHERE id % 50 = 1 AND workspace < 12 UNION ALL SELECT id, 'filters' FROM rec WHERE status = 'F' AND location = 'BUILDING' AND workspace < 12""")
def resolved_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same request with and without a resolved set of recordings."""
    rec, persons = view(spark, sf_dir, "rec"), F.col("workspace") < 12
    others = [F.col("status") == "F", F.col("location") == "BUILDING"]
    of = lambda resolved, name: rec.where(S.recording_scope(resolved, others, persons)).select("id", F.lit(name).alias("scope"))
    return of(F.col("id") % 50 == 1, "resolved").unionByName(of(None, "filters"))


@query("SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 3 = 1 AND conv_id % 10 = 4 AND NOT conv_id % 7 = 0")
def conversation_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", (F.col("conv_id") % 3).alias("workspace"), (F.col("conv_id") % 10).alias("owner"), (F.col("conv_id") % 7 == 0).alias("archived"))
    return c.where("workspace = 1 and owner = 4 and not archived").select("conv_id").distinct()


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 100 OFFSET 9")
def offset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for 5,000 rows from place 30 on, held to what a page may be."""
    return S.offset_page(table(spark, sf_dir, "events"), [F.desc("value"), "event_id"], 5_000, 30).select("event_id", "value")


@query("""WITH n AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n, count(*) OVER (PARTITION BY conv_id) AS c FROM conversations WHERE turn < 6)
    SELECT conv_id, turn, role, c > 3 AS has_more FROM n WHERE n <= 3""")
def keyset_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.keyset_page(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", 6, 3)


@query("""WITH o AS (SELECT o_custkey AS id, list(o_orderkey ORDER BY o_orderkey) AS a, CASE WHEN o_custkey % 5 <> 0 THEN list(o_orderkey ORDER BY o_orderkey) FILTER (WHERE o_orderkey % 3 = 0) END AS b,
        CASE WHEN o_custkey % 2 <> 0 THEN list(o_orderkey ORDER BY o_orderkey) FILTER (WHERE o_orderkey % 4 = 1) END AS c FROM orders GROUP BY o_custkey),
    s AS (SELECT id, list_filter(list_filter(a, lambda x: id % 5 = 0 OR list_contains(coalesce(b, []), x)), lambda x: id % 2 = 0 OR list_contains(coalesce(c, []), x)) AS s FROM o)
    SELECT id, array_to_string(s, ',') AS scope, len(s) = 0 AS match_none FROM s""")
def scope_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own recordings, narrowed by a history scope and a resolved one where these are given."""
    own = F.sort_array(F.collect_list("o_orderkey"))
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(own.alias("a"))
    history, resolved = F.when(F.col("id") % 5 != 0, F.filter("a", lambda x: x % 3 == 0)), F.when(F.col("id") % 2 != 0, F.filter("a", lambda x: x % 4 == 1))
    ids, none = S.compose(F.col("a"), history, resolved)
    return o.select("id", F.array_join(ids, ",").alias("scope"), none.alias("match_none"))


@query("SELECT user_id, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-09 16:00:00' AND ts < TIMESTAMP '2024-01-11 16:00:00' GROUP BY 1")
def local_time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of two local days, half open, by user."""
    e = table(spark, sf_dir, "events").where(S.local_range(F.col("ts"), "2024-01-10 00:00:00", "2024-01-12 00:00:00"))
    return e.groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-24 00:00:00' AND ts < TIMESTAMP '2024-01-31 00:00:00' GROUP BY 1")
def default_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, end = S.bounded_window(None, None, datetime(2024, 1, 31))
    e = table(spark, sf_dir, "events").where((F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") < F.lit(end).cast("timestamp_ntz")))
    return e.groupBy("event_type").agg(F.count("*").alias("n"))


@query("""SELECT d.doc_id, u.purpose FROM labels l JOIN documents d USING (doc_id), (SELECT 'training' AS purpose UNION ALL SELECT 'evaluation') u
    WHERE quality = 1 AND d.doc_id % 11 <> 0 AND CASE WHEN purpose = 'training' THEN d.doc_id % 7 <> 0 ELSE n_chars > 100 END""")
def eligible_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved, unarchived annotations for each purpose they are permitted for."""
    approved = table(spark, sf_dir, "labels").where("quality = 1 and doc_id % 11 <> 0").select("doc_id")
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 7 != 0).alias("train"), (F.col("n_chars") > 100).alias("evaluate")).join(approved, "doc_id")
    uses = F.filter(F.array(F.when(F.col("train"), "training"), F.when(F.col("evaluate"), "evaluation")), lambda x: x.isNotNull())
    return rows.select("doc_id", F.explode(uses).alias("purpose"))


@query("""WITH c AS (SELECT l_orderkey, CASE WHEN bool_or(l_linestatus = 'O') THEN 'open' ELSE 'done' END AS derived FROM lineitem GROUP BY 1)
    SELECT o_orderkey AS id, coalesce(CASE WHEN o_orderkey % 5 = 0 THEN 'live' END, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END, derived, 'unknown') AS status FROM orders LEFT JOIN c ON l_orderkey = o_orderkey""")
def live_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live state over the persisted one over what the children tell."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    live = o.where("id % 5 = 0").select("id", F.lit("live").alias("live"))
    persisted = o.where("id % 3 <> 0").select("id", F.col("o_orderstatus").alias("persisted"))
    derived = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.when(F.bool_or(F.col("l_linestatus") == "O"), "open").otherwise("done").alias("derived"))
    return o.select("id").join(live, "id", "left").join(persisted, "id", "left").join(derived, "id", "left").select("id", F.coalesce("live", "persisted", "derived", F.lit("unknown")).alias("status"))


@query("SELECT doc_id, source, CASE WHEN doc_id % 13 <> 0 THEN md5(text) END AS digest, doc_id % 13 = 0 AS missing FROM documents")
def checkpoint_rehydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates are saved without text and get it back by id; of those gone since, none."""
    docs = table(spark, sf_dir, "documents")
    saved = docs.select("doc_id", "source", "text").drop("text")
    now = docs.where("doc_id % 13 <> 0").select("doc_id", "text")
    return saved.join(now, "doc_id", "left").select("doc_id", "source", F.md5("text").alias("digest"), F.col("text").isNull().alias("missing"))


@query("""SELECT doc_id, '{"rank":' || doc_id % 9 || ',"chunk":{"id":' || doc_id || ',"size":' || n_chars || '}}' AS source FROM documents""")
def source_sanitizing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as they are stored: the nested text is gone, all else stays."""
    chunk = F.struct(F.col("doc_id").alias("id"), "text", F.col("n_chars").alias("size"))
    nested = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 9).alias("rank"), chunk.alias("chunk"))
    return nested.select("doc_id", F.to_json(F.struct("rank", F.col("chunk").dropFields("text").alias("chunk"))).alias("source"))


@query("""SELECT n_name AS nation, c_mktsegment AS segment, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderstatus = 'F' GROUP BY 1, 2""")
def star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").cast("long").alias("q"))
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    out = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return out.groupBy(F.col("n_name").alias("nation"), F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), F.sum("q").alias("quantity"))


@query(ctes("inv") + """, s AS (SELECT event_id AS invocation_id, 'span ' || event_type AS operation FROM events WHERE event_id % 4 = 0)
    SELECT coalesce(s.operation, inv.operation) AS operation, count(*) AS n, CAST(sum(prompt_tokens) AS BIGINT) AS tokens FROM inv LEFT JOIN s ON s.invocation_id = inv.id GROUP BY 1""")
def operation_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A span's operation goes before the invocation's own."""
    spans = table(spark, sf_dir, "events").where("event_id % 4 = 0").select(F.col("event_id").alias("id"), F.concat(F.lit("span "), "event_type").alias("span_operation"))
    joined = view(spark, sf_dir, "inv").join(spans, "id", "left")
    return joined.groupBy(F.coalesce("span_operation", "operation").alias("operation")).agg(F.count("*").alias("n"), F.sum("prompt_tokens").alias("tokens"))


@query(ctes("seg") + """, p AS (SELECT recording_id, cluster, start_ms, end_ms FROM seg WHERE ordinal % 2 = 0 UNION ALL SELECT recording_id, cluster, start_ms, end_ms + 1 FROM seg WHERE ordinal % 5 = 0)
    SELECT p.recording_id, p.cluster, p.start_ms, p.end_ms, min(ordinal) AS first_index FROM p LEFT JOIN seg s ON s.recording_id = p.recording_id AND s.cluster = p.cluster AND s.start_ms = p.start_ms AND s.end_ms = p.end_ms GROUP BY 1, 2, 3, 4""")
def interval_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lowest index of the segment with exactly an interval and cluster; none for an interval that is off by one."""
    key = ["recording_id", "cluster", "start_ms", "end_ms"]
    seg = view(spark, sf_dir, "seg")
    wanted = seg.where("ordinal % 2 = 0").select(*key).unionByName(seg.where("ordinal % 5 = 0").select("recording_id", "cluster", "start_ms", (F.col("end_ms") + 1).alias("end_ms"))).distinct()
    return wanted.join(seg.groupBy(*key).agg(F.min("ordinal").alias("first_index")), key, "left")


@query("""WITH e AS (SELECT conv_id, turn, unnest(CAST(to_json(string_split(text, ' ')) AS VARCHAR[])) AS t, generate_subscripts(string_split(text, ' '), 1) AS p FROM conversations),
    f AS (SELECT conv_id, turn, t, min(p) AS p FROM e WHERE t <> '' GROUP BY 1, 2, 3) SELECT conv_id, turn, md5(string_agg(t, ' ' ORDER BY p)) AS terms FROM f GROUP BY 1, 2""")
def json_array_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct elements of a JSON array in the order of their first place."""
    stored = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(F.split("text", " ")).alias("j"))
    elements = stored.select("conv_id", "turn", F.posexplode(F.from_json("j", "array<string>")).alias("p", "t")).where("t <> ''")
    first = elements.groupBy("conv_id", "turn", "t").agg(F.min("p").alias("p"))
    return first.groupBy("conv_id", "turn").agg(F.md5(F.expr("listagg(t, ' ') WITHIN GROUP (ORDER BY p)")).alias("terms"))


@query(ctes("inv") + """ SELECT run_id, count(*) AS n, string_agg(operation || ':' || completion_tokens, ',' ORDER BY id) AS models FROM inv WHERE completion_tokens IS NOT NULL AND status <> 'failed' GROUP BY 1""")
def run_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The models of each run by position."""
    rows = view(spark, sf_dir, "inv").where("completion_tokens is not null and status <> 'failed'")
    models = F.sort_array(F.collect_list(F.struct("id", "operation", "completion_tokens")))
    names = F.transform(models, lambda m: F.concat_ws(":", m["operation"], m["completion_tokens"].cast("string")))
    return rows.groupBy("run_id").agg(F.count("*").alias("n"), F.array_join(names, ",").alias("models"))


@query(ctes("seg") + " SELECT recording_id, cluster, min(ordinal) AS first_index, max(ordinal) AS last_index, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM seg GROUP BY 1, 2")
def ordinal_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "seg").groupBy("recording_id", "cluster").agg(F.min("ordinal").alias("first_index"), F.max("ordinal").alias("last_index"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


@query("""WITH m AS (SELECT 'quality' AS metric, CAST(quality AS DOUBLE) AS v FROM labels UNION ALL SELECT 'toxic', toxic FROM labels UNION ALL SELECT 'both', CASE WHEN quality = 1 AND toxic = 1 THEN 1.0 ELSE 0 END FROM labels)
    SELECT n.metric, round(coalesce(avg(v), 0), 9) AS mean FROM (VALUES ('quality'), ('toxic'), ('both'), ('absent')) n(metric) LEFT JOIN m USING (metric) GROUP BY 1""")
def macro_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of each metric over cases; 0 for one that no case has."""
    rows = table(spark, sf_dir, "labels").select(F.col("quality").cast("double"), F.col("toxic").cast("double"), F.when(F.expr("quality = 1 and toxic = 1"), 1.0).otherwise(0.0).alias("both"))
    means = rows.agg(*[F.avg(c).alias(c) for c in rows.columns], F.avg(F.lit(None).cast("double")).alias("absent"))
    names = [*rows.columns, "absent"]
    return means.select(*[F.round(F.coalesce(c, F.lit(0.0)), 9).alias(c) for c in names]).unpivot([], names, "metric", "mean")


@query("""WITH m AS (SELECT conv_id AS case_id, turn + 1 AS rank, role AS evidence, 1 + length(role) % 3 AS relevance FROM conversations),
    f AS (SELECT case_id, evidence, relevance, min(rank) AS rank FROM m GROUP BY 1, 2, 3)
    SELECT case_id, count(*) AS covered, round(sum((power(2, relevance) - 1) / log2(rank + 1)), 9) AS dcg FROM f WHERE rank <= 10 GROUP BY 1""")
def gain_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A piece of evidence gains at its first rank only."""
    m = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("case_id"), (F.col("turn") + 1).alias("rank"), F.col("role").alias("evidence"), (1 + F.length("role") % 3).alias("relevance"))
    first = m.groupBy("case_id", "evidence", "relevance").agg(F.min("rank").alias("rank")).where("rank <= 10")
    gain = (F.pow(F.lit(2.0), F.col("relevance")) - 1) / F.log2(F.col("rank") + 1)
    return first.groupBy("case_id").agg(F.count("*").alias("covered"), F.round(F.sum(gain), 9).alias("dcg"))


@query("""WITH g AS (SELECT conv_id, CAST(length(text) AS DOUBLE) AS w, turn % 3 = 0 AS exact, turn % 3 = 1 AS near, turn % 2 = 0 AS found FROM conversations),
    s AS (SELECT conv_id, sum(w) AS gold, sum(CASE WHEN found THEN w ELSE 0 END) AS made, sum(CASE WHEN found AND exact THEN w ELSE 0 END) AS strict, sum(CASE WHEN found AND (exact OR near) THEN w ELSE 0 END) AS relaxed FROM g GROUP BY 1),
    p AS (SELECT conv_id, k, CASE WHEN made = 0 THEN 0 ELSE hit / made END AS p, CASE WHEN gold = 0 THEN 0 ELSE hit / gold END AS r FROM (SELECT conv_id, gold, made, unnest(['strict', 'relaxed']) AS k, unnest([strict, relaxed]) AS hit FROM s) x)
    SELECT conv_id, k AS kind, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 9) AS f1 FROM p""")
def weighted_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted precision, recall and F1, exact matches only and near ones too."""
    from ..operators.evaluation import ratio

    g = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("double").alias("w"))
    total = lambda c: F.sum(F.when(F.expr(c), F.col("w")).otherwise(0.0))
    s = g.groupBy("conv_id").agg(total("true").alias("gold"), total("turn % 2 = 0").alias("made"), total("turn % 6 = 0").alias("strict"), total("turn % 2 = 0 and turn % 3 < 2").alias("relaxed"))
    long = s.unpivot(["conv_id", "gold", "made"], ["strict", "relaxed"], "kind", "hit").withColumn("p", ratio(F.col("hit"), F.col("made"))).withColumn("r", ratio(F.col("hit"), F.col("gold")))
    f1 = ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r"))
    return long.select("conv_id", "kind", F.round("p", 9).alias("precision"), F.round("r", 9).alias("recall"), F.round(f1, 9).alias("f1"))


@query("""SELECT conv_id, bool_or(role = 'user') AS is_target, string_agg(role, ',' ORDER BY t) AS labels FROM (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY 1, 2) f GROUP BY 1""")
def chunk_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a wanted speaker is among a chunk's, and its speakers in the order they come."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "role")))
    labels = F.array_distinct(F.transform(turns, lambda t: t["role"]))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.bool_or(F.col("role") == "user").alias("is_target"), F.array_join(labels, ",").alias("labels"))


@query("""SELECT event_type, event_id, CAST(n AS BIGINT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS n FROM events) e WHERE n <= 50""")
def saved_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 candidates of each case are saved; ranks are limited before their rows are shuffled."""
    n = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id"))
    return table(spark, sf_dir, "events").select("event_type", "event_id", "value").withColumn("n", n).where("n <= 50").select("event_type", "event_id", F.col("n").cast("long").alias("place"))


QUERY_WORDS = ("station", "river", "music", "market")
WANTED = "['" + "', '".join(QUERY_WORDS) + "']"


@query(f"""WITH d AS (SELECT doc_id, strpos(lower(text), 'market') > 0 AS exact, len(list_intersect({WANTED}, list_distinct(string_split(lower(text), ' ')))) AS shared FROM documents)
    SELECT doc_id, exact, round(1 - shared / 4.0, 6)::DOUBLE AS distance FROM d ORDER BY exact DESC, distance, doc_id LIMIT 30""")
def lexical_then_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that hold the query first, then by the share of its words they lack."""
    words = F.array(*map(F.lit, QUERY_WORDS))
    shared = F.size(F.array_intersect(words, F.split(F.lower("text"), " ")))
    scored = table(spark, sf_dir, "documents").select("doc_id", (F.instr(F.lower("text"), "market") > 0).alias("exact"), F.round(1 - shared / 4.0, 6).alias("distance"))
    return scored.orderBy(F.desc("exact"), "distance", "doc_id").limit(30)
