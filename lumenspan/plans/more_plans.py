"""Smaller operators: scopes, formats, parses, retention lanes, registries' defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.joins import BROADCAST_ROWS, interval_join
from ..sources.corpus import ctes, table, view
from .registry import query


@query("""SELECT o_custkey AS id, array_to_string(list_filter(list(o_orderkey ORDER BY o_orderkey DESC), lambda x: x % 3 = 0), ',') AS scope FROM orders GROUP BY 1""")
def scope_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list met with another, in the first one's order."""
    own = F.sort_array(F.collect_list("o_orderkey"), asc=False)
    third = F.filter(own, lambda x: x % 3 == 0)
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.array_join(F.array_intersect(own, third), ",").alias("scope"))


@query("""WITH w AS (SELECT conv_id, turn, text, unnest(string_split(text, ' ')) AS term, generate_subscripts(string_split(text, ' '), 1) AS p FROM conversations),
    k AS (SELECT conv_id, turn, term, min(p) AS p FROM w WHERE length(term) > 6 AND strpos(lower(text), lower(term)) > 0 AND term NOT IN ('station', 'without') GROUP BY 1, 2, 3)
    SELECT conv_id, turn, string_agg(term, ' ' ORDER BY p) AS anchors FROM k GROUP BY 1, 2""")
def faithful_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct terms that both texts hold, in order, without stop terms."""
    terms = F.array_distinct(F.filter(F.split("text", " "), lambda t: (F.length(t) > 6) & (F.instr(F.lower("text"), F.lower(t)) > 0)))
    kept = F.array_except(terms, F.array(F.lit("station"), F.lit("without")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(kept, " ").alias("anchors")).where("anchors <> ''")


@query("""SELECT event_id, CAST(floor(value) AS BIGINT) // 60 || ':' || lpad(CAST(CAST(floor(value) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS clock,
    CASE WHEN value < 100 THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || ' ms' ELSE CAST(CAST(floor(value) AS BIGINT) // 100 AS VARCHAR) || ' s' END AS elapsed FROM events""")
def formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.floor("value")
    clock = F.concat((n / 60).cast("long").cast("string"), F.lit(":"), F.lpad((n % 60).cast("string"), 2, "0"))
    elapsed = F.when(F.col("value") < 100, F.concat(n.cast("string"), F.lit(" ms"))).otherwise(F.concat((n / 100).cast("long").cast("string"), F.lit(" s")))
    return table(spark, sf_dir, "events").select("event_id", clock.alias("clock"), elapsed.alias("elapsed"))


@query("SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' ELSE 'queued' END AS status, o_orderstatus = 'F' AS terminal FROM orders")
def status_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*map(F.lit, ["F", "completed", "O", "processing", "P", "queued"]))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.coalesce(names[F.col("o_orderstatus")], F.lit("queued")).alias("status"), (F.col("o_orderstatus") == "F").alias("terminal"))


@query(ctes("seg") + " SELECT recording_id, ordinal, cluster AS parsed_cluster, start_ms AS parsed_start, end_ms AS parsed_end FROM seg")
def interval_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = view(spark, sf_dir, "seg").select("recording_id", "ordinal", F.concat_ws(":", *[F.col(c).cast("string") for c in ("cluster", "start_ms", "end_ms")]).alias("id"))
    part = lambda i: F.regexp_extract("id", r"^(.*):(\d+):(\d+)$", i).cast("long")
    return seg.select("recording_id", "ordinal", part(1).alias("parsed_cluster"), part(2).alias("parsed_start"), part(3).alias("parsed_end"))


@query("SELECT doc_id, md5(substr(text, 1, 40)) AS head, md5(right(text, 40)) AS tail, length(substr(text, 1, 200)) AS lead FROM documents")
def head_and_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.left("text", F.lit(40))).alias("head"), F.md5(F.right("text", F.lit(40))).alias("tail"), F.length(F.left("text", F.lit(200))).cast("long").alias("lead"))


@query(ctes("seg") + " SELECT recording_id, ordinal FROM seg WHERE (start_ms + end_ms) // 2 >= 5000 AND (start_ms + end_ms) // 2 < 40000")
def midpoint_in_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "seg").where("(start_ms + end_ms) div 2 >= 5000 AND (start_ms + end_ms) div 2 < 40000").select("recording_id", "ordinal")


@query("""WITH w AS (SELECT conv_id, turn, unnest(string_split(lower(text), ' ')) AS term, generate_subscripts(string_split(lower(text), ' '), 1) AS p FROM conversations),
    k AS (SELECT conv_id, term, min(turn * 100000 + p) AS p FROM w WHERE trim(term) <> '' GROUP BY 1, 2) SELECT conv_id, md5(string_agg(term, ' ' ORDER BY p)) AS terms FROM k GROUP BY 1""")
def ordered_distinct_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split(F.lower("text"), " ")).alias("p", "term")).where("trim(term) <> ''")
    first = words.groupBy("conv_id", "term").agg(F.min(F.col("turn") * 100000 + F.col("p")).alias("p"))
    return first.groupBy("conv_id").agg(F.md5(F.expr("listagg(term, ' ') WITHIN GROUP (ORDER BY p)")).alias("terms"))


@query(ctes("seg") + """ SELECT recording_id, ordinal FROM seg a WHERE NOT EXISTS (SELECT 1 FROM seg b WHERE b.recording_id = a.recording_id AND b.ordinal <> a.ordinal AND b.end_ms >= a.start_ms AND b.start_ms <= a.end_ms)""")
def alone_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that no other of the recording meets."""
    seg = view(spark, sf_dir, "seg").select("recording_id", "ordinal", "start_ms", "end_ms")
    met = interval_join(seg, seg, "recording_id").where("ordinal <> r_ordinal").select("recording_id", "ordinal").distinct()
    return seg.join(met, ["recording_id", "ordinal"], "left_anti").select("recording_id", "ordinal")


@query("SELECT conv_id, md5(string_agg(role || ':' || text, '|' ORDER BY turn)) AS history FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) c WHERE n <= 3 GROUP BY 1")
def last_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    last = table(spark, sf_dir, "conversations").withColumn("n", n).where("n <= 3")
    rows = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(":"), "text").alias("t"))))
    return last.groupBy("conv_id").agg(F.md5(F.array_join(F.transform(rows, lambda r: r["t"]), "|")).alias("history"))


@query("""WITH q AS (SELECT item_id, w, min(p) AS p FROM (SELECT item_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS p FROM benchmark) WHERE length(w) > 4 GROUP BY 1, 2),
    k AS (SELECT item_id, w, row_number() OVER (PARTITION BY item_id ORDER BY p) - 1 AS k FROM q), d AS (SELECT DISTINCT doc_id, n_chars, unnest(string_split(text, ' ')) AS w FROM documents),
    v AS (SELECT item_id, doc_id, k AS variant, row_number() OVER (PARTITION BY item_id, k ORDER BY n_chars, doc_id) AS rank, k = 0 AS exact, CASE WHEN k = 0 THEN 1.0 ELSE 0.95 END / n_chars AS score FROM k JOIN d USING (w))
    SELECT item_id, doc_id, CAST(arg_min(variant, (CASE WHEN exact THEN 0 ELSE 1 END, -score, variant, rank)) AS BIGINT) AS variant FROM v GROUP BY 1, 2""")
def alias_variant_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of a document's hits by variants of a query, all its longer words: exact first, then score, variant, rank."""
    hits = word_hits(spark, sf_dir)
    rank = F.row_number().over(Window.partitionBy("item_id", "variant").orderBy("n_chars", "doc_id"))
    score = F.when(F.col("variant") == 0, 1.0).otherwise(0.95) / F.col("n_chars")
    hits = hits.withColumn("rank", rank).withColumn("place", F.struct(F.when(F.col("variant") == 0, 0).otherwise(1), -score, "variant", "rank"))
    return hits.groupBy("item_id", "doc_id").agg(F.min_by("variant", "place").cast("long").alias("variant"))


def word_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, variant, doc_id, n_chars: documents that hold a word of more than 4 characters of a benchmark item, the variants in the item's order; an equi-join over words."""
    longer = F.array_distinct(F.filter(F.split("text", " "), lambda w: F.length(w) > 4))
    words = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(longer).alias("variant", "w"))
    words = F.broadcast(words) if words.count() <= BROADCAST_ROWS else words
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.explode(longer).alias("w")).join(words, "w").drop("w")


#: Answers with an object: bare with others behind it, in a fence, in a fence that names it, or none; texts stand around and inside it.
REPLY = """CASE turn % 4 WHEN 0 THEN role || ' {"k": ' || turn || ', "in": {}} and {' || text || '} end' WHEN 1 THEN 'x {a} ```json\n {"k": {"t": "' || replace(text, '"', '') || '"}}\n``` {b}'
    WHEN 2 THEN '```' || '{"k": ' || turn || '}``` tail' ELSE 'none: ' || text END"""


@query("SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN md5('{\"k\": ' || turn || ', \"in\": {}} and {' || text || '}') WHEN 1 THEN md5('{\"k\": {\"t\": \"' || replace(text, '\"', '') || '\"}}') WHEN 2 THEN md5('{\"k\": ' || turn || '}') ELSE md5('') END AS found FROM conversations")
def json_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(REPLY).alias("reply"))
    return reply.select("conv_id", "turn", F.md5(T.fenced_object(F.col("reply"))).alias("found"))


@query("""SELECT metric, CAST(count(*) AS BIGINT) AS n, round(sum(v), 6) AS total FROM (SELECT event_type, unnest(['value', 'k']) AS metric, unnest([value, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE)]) AS v FROM events) u GROUP BY 1""")
def long_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("value", F.regexp_extract("props", "([0-9]+)", 1).cast("double").alias("k"))
    long = e.unpivot([], ["value", "k"], "metric", "v")
    return long.groupBy("metric").agg(F.count("*").alias("n"), F.round(F.sum("v"), 6).alias("total"))


@query(ctes("chunk") + " SELECT chunk_id, chunk_index FROM chunk WHERE strpos(lower(text), 'est') > 0 ORDER BY chunk_index, chunk_id LIMIT 50 OFFSET 10")
def chunk_browse(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = view(spark, sf_dir, "chunk").where(F.instr(F.lower("text"), "est") > 0)
    return hits.orderBy("chunk_index", "chunk_id").offset(10).limit(50).select("chunk_id", "chunk_index")


@query("""WITH e AS (SELECT event_id, CAST(CAST(floor(value * 37) AS BIGINT) AS VARCHAR) AS t FROM events), p AS (SELECT event_id, t, string_split(translate(t, '023456789', '零二三四五六七八九'), '1') AS parts FROM e),
    m AS (SELECT *, unnest(list_concat([0, (1 << (len(parts) - 1)) - 1], range(1, 16))) AS mask, unnest(range(17)) AS k FROM p),
    v AS (SELECT event_id, k, array_to_string(list_transform(parts, lambda x, i: x || CASE WHEN i = len(parts) THEN '' WHEN (mask >> (i - 1)) & 1 = 1 THEN '幺' ELSE '一' END), '') AS variant FROM m UNION ALL SELECT event_id, -1, t FROM e),
    d AS (SELECT event_id, variant, row_number() OVER (PARTITION BY event_id ORDER BY min(k)) AS n FROM v GROUP BY 1, 2) SELECT event_id, variant, CAST(n AS BIGINT) AS place FROM d WHERE n <= 16""")
def spoken_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as they are said digit by digit."""
    e = table(spark, sf_dir, "events").select("event_id", T.normalize_search(F.floor(F.col("value") * 37).cast("string")).alias("t"))
    e = e.select("event_id", F.posexplode(T.spoken_variants(F.col("t"))).alias("p", "variant"))
    return e.select("event_id", "variant", (F.col("p") + 1).cast("long").alias("place"))
