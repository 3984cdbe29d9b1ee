"""Filters, joins, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import joins as J
from ..sources.corpus import ctes, table, view
from .registry import query

RANGE = "created_at >= TIMESTAMP '1995-01-01' AND created_at < TIMESTAMP '1997-01-01'"


@query(ctes("rec") + f""" SELECT id, owner, location FROM rec WHERE status = 'F' AND (location ILIKE '%auto%' OR location ILIKE '%build%') AND {RANGE}""")
def rec_filter_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = F.expr("location ilike any ('%auto%', '%build%')")
    return view(spark, sf_dir, "rec").where(some & (F.col("status") == "F")).where(RANGE).select("id", "owner", "location")


@query("SELECT s.status, count(o_orderkey) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) s(status) LEFT JOIN orders ON o_orderstatus = s.status GROUP BY 1")
def rec_status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = spark.createDataFrame([(x,) for x in "FOPX"], "status string")
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).count()
    return states.join(counts, "status", "left").select("status", F.coalesce("count", F.lit(0)).cast("long").alias("n"))


ACCESS = """EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_nationkey IN (1, 2))
    OR EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = o_custkey AND s_nationkey = 3)"""


@query(f"SELECT o_orderkey AS id FROM orders WHERE {ACCESS}")
def rec_access_or_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("orders", "customer", "supplier")
    sql = "SELECT o_orderkey AS id FROM orders WHERE " + ACCESS
    for n in names:
        sql = sql.replace(f"FROM {n} ", "FROM {" + n + "} ")
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


@query("SELECT o_orderkey AS id FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment IN ('BUILDING', 'AUTOMOBILE'))")
def rec_edit_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    may = table(spark, sf_dir, "customer").where(F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE"))
    return table(spark, sf_dir, "orders").join(may, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select(F.col("o_orderkey").alias("id"))


@query("SELECT o_orderkey AS id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def rec_missing_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select(F.col("o_orderkey").alias("id"))


@query("""SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderkey % 10 <> 0)
    UNION SELECT DISTINCT l_suppkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_suppkey % 7 <> 0)""")
def orphan_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    orders, suppliers = table(spark, sf_dir, "orders").where("o_orderkey % 10 <> 0"), table(spark, sf_dir, "supplier").where("s_suppkey % 7 <> 0")
    a = items.select(F.col("l_orderkey").alias("id")).distinct().join(orders, F.col("id") == F.col("o_orderkey"), "left_anti")
    b = items.select(F.col("l_suppkey").alias("id")).distinct().join(suppliers, F.col("id") == F.col("s_suppkey"), "left_anti")
    return a.union(b).distinct()


@query(ctes("utt") + """, m AS (SELECT DISTINCT recording_id, cluster, CASE WHEN recording_id % 3 = 0 THEN NULL ELSE 'name ' || cluster END AS name FROM utt WHERE cluster <> 'system'),
    p AS (SELECT DISTINCT cluster, 'profile ' || cluster AS profile FROM utt WHERE cluster = 'user')
    SELECT u.recording_id, u.utterance_index, coalesce(CASE WHEN u.recording_id % 5 = 0 THEN profile END, name, u.cluster) AS label
    FROM utt u LEFT JOIN m ON m.recording_id = u.recording_id AND m.cluster = u.cluster LEFT JOIN p ON p.cluster = u.cluster""")
def display_name_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    utt = view(spark, sf_dir, "utt")
    names = utt.where("cluster <> 'system'").select("recording_id", "cluster").distinct().withColumn("name", F.when(F.col("recording_id") % 3 != 0, F.concat(F.lit("name "), "cluster")))
    profiles = utt.where("cluster = 'user'").select("cluster").distinct().withColumn("profile", F.concat(F.lit("profile "), "cluster"))
    out = utt.join(names, ["recording_id", "cluster"], "left").join(F.broadcast(profiles), "cluster", "left")  # one row at most: the distinct value of a single role
    label = F.coalesce(F.when(F.col("recording_id") % 5 == 0, F.col("profile")), "name", "cluster")
    return out.select("recording_id", "utterance_index", label.alias("label"))


@query(ctes("chunk") + " SELECT chunk_id, length(coalesce(nullif(CASE WHEN chunk_id % 3 = 0 THEN '' ELSE text END, ''), 'fallback')) AS n FROM chunk")
def lexical_text_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    original = F.when(F.col("chunk_id") % 3 == 0, "").otherwise(F.col("text"))
    return view(spark, sf_dir, "chunk").select("chunk_id", F.length(F.coalesce(F.nullif(original, F.lit("")), F.lit("fallback"))).cast("long").alias("n"))


HITS = "hits AS (SELECT recording_id, min(utterance_index) AS first_index, max(utterance_index) AS last_index FROM utt WHERE length(text) > 200 GROUP BY 1)"


@query(ctes("utt") + f""", {HITS} SELECT u.recording_id, count(*) AS lines, min(u.start_ms) AS start_ms, max(u.end_ms) AS end_ms,
    md5(string_agg(u.cluster || ': ' || u.text, chr(10) ORDER BY u.utterance_index)) AS body
    FROM utt u JOIN hits h ON h.recording_id = u.recording_id AND u.utterance_index BETWEEN greatest(0, first_index - 1) AND last_index + 1 GROUP BY 1""")
def context_window_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import render_lines

    utt = view(spark, sf_dir, "utt")
    hits = utt.where("length(text) > 200").groupBy("recording_id").agg(F.min("utterance_index").alias("first_index"), F.max("utterance_index").alias("last_index"), F.first("recording_id").alias("hit_id"))
    rows = J.context_window(hits, utt, "recording_id", "utterance_index", 1)
    lines = render_lines(F.array_sort(F.collect_list(F.struct("utterance_index", F.col("cluster").alias("label"), "text"))))
    return rows.groupBy("recording_id").agg(F.count("*").alias("lines"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.md5(lines).alias("body"))


@query("""WITH g AS (SELECT l_orderkey AS chunk_id, list(DISTINCT l_suppkey) AS members FROM lineitem GROUP BY 1)
    SELECT chunk_id, s_suppkey AS member, s_nationkey AS nation FROM g JOIN supplier ON list_contains(members, s_suppkey)""")
def membership_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("chunk_id")).agg(F.collect_set("l_suppkey").alias("members"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("member"), F.col("s_nationkey").alias("nation"))
    return J.membership_join(groups, "members", suppliers, "member").select("chunk_id", "member", "nation")


@query(ctes("seg") + """ SELECT a.recording_id, a.ordinal AS a, b.ordinal AS b, round(CAST(greatest(0, least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms)) AS DOUBLE)
    / greatest(1, b.end_ms - b.start_ms), 9) AS ratio FROM seg a JOIN seg b ON a.recording_id = b.recording_id AND a.ordinal < b.ordinal
    AND a.end_ms >= b.start_ms AND a.start_ms <= b.end_ms""")
def interval_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.similarity import overlap_ratio

    seg = view(spark, sf_dir, "seg")
    met = J.interval_join(seg, seg, "recording_id").where("ordinal < r_ordinal")
    ratio = overlap_ratio(F.col("start_ms"), F.col("end_ms"), F.col("r_start_ms"), F.col("r_end_ms"))
    return met.select("recording_id", F.col("ordinal").alias("a"), F.col("r_ordinal").alias("b"), F.round(ratio, 9).alias("ratio"))


TOK = "tok AS (SELECT recording_id, ordinal, start_ms + 700 AS start_ms, end_ms + 700 AS end_ms FROM seg WHERE ordinal % 2 = 0)"


@query(ctes("seg") + f""", {TOK}, o AS (SELECT t.recording_id, t.ordinal, s.ordinal AS turn, least(t.end_ms, s.end_ms) - greatest(t.start_ms, s.start_ms) AS overlap,
    t.end_ms - t.start_ms AS n, s.start_ms AS s0, s.end_ms AS e0 FROM tok t JOIN seg s ON s.recording_id = t.recording_id WHERE least(t.end_ms, s.end_ms) > greatest(t.start_ms, s.start_ms)),
    r AS (SELECT *, row_number() OVER w AS place, lead(overlap) OVER w AS second FROM o WINDOW w AS (PARTITION BY recording_id, ordinal ORDER BY overlap DESC, s0, e0))
    SELECT recording_id, ordinal, turn, overlap, CASE WHEN CAST(overlap AS DOUBLE) / n < 0.6 OR (coalesce(second, 0) > 0 AND overlap - second < 100) THEN 'ambiguous' ELSE 'matched' END AS status
    FROM r WHERE place = 1""")
def argmax_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = view(spark, sf_dir, "seg")
    tokens = seg.where("ordinal % 2 = 0").select("recording_id", "ordinal", (F.col("start_ms") + 700).alias("start_ms"), (F.col("end_ms") + 700).alias("end_ms"))
    out = J.argmax_overlap(tokens, seg.select("recording_id", F.col("ordinal").alias("turn"), "start_ms", "end_ms"), "recording_id", ["recording_id", "ordinal"])
    return out.select("recording_id", "ordinal", F.col("r_turn").alias("turn"), "overlap", "status")


@query(ctes("seg") + """, p AS (SELECT recording_id, max(end_ms) + 250 AS point_ms FROM seg GROUP BY 1),
    d AS (SELECT p.recording_id, point_ms, ordinal, row_number() OVER (PARTITION BY p.recording_id ORDER BY
        CASE WHEN start_ms <= point_ms AND point_ms < end_ms THEN 0 ELSE least(abs(point_ms - start_ms), abs(point_ms - end_ms)) END, start_ms, end_ms) AS n
        FROM p JOIN seg s ON s.recording_id = p.recording_id)
    SELECT recording_id, point_ms, ordinal FROM d WHERE n = 1""")
def nearest_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = view(spark, sf_dir, "seg")
    points = seg.groupBy("recording_id").agg((F.max("end_ms") + 250).alias("point_ms"))
    return J.nearest(points, seg, "recording_id", ["recording_id", "point_ms"]).select("recording_id", "point_ms", F.col("r_ordinal").alias("ordinal"))


@query("""WITH g AS (SELECT conv_id, turn, length(text) // 4 AS s, length(text) // 2 AS e FROM conversations), p AS (SELECT conv_id, turn, length(text) // 3 AS s, length(text) AS e FROM conversations)
    SELECT g.conv_id, g.turn, g.s AS gold_start, p.s AS found_start FROM g JOIN p ON g.conv_id = p.conv_id AND g.turn = p.turn AND g.s < p.e AND p.s < g.e""")
def span_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    part = lambda a, b, p: c.select("conv_id", "turn", F.expr(f"length(text) div {a}").alias(f"{p}s"), F.expr(f"length(text) div {b}").alias(f"{p}e"))
    met = part(4, 2, "g").join(part(3, 1, "p"), ["conv_id", "turn"]).where("gs < pe AND ps < ge")
    return met.select("conv_id", "turn", F.col("gs").alias("gold_start"), F.col("ps").alias("found_start"))


@query("SELECT l_orderkey AS recording_id, l_quantity AS q, min(l_linenumber) AS first_line FROM lineitem GROUP BY 1, 2")
def exact_interval_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("recording_id"), F.col("l_quantity").alias("q")).agg(F.min("l_linenumber").alias("first_line"))


@query("""WITH k AS (SELECT DISTINCT item_id, unnest(list_filter(string_split(text, ' '), lambda w: length(w) > 4)) AS w FROM benchmark), d AS (SELECT DISTINCT doc_id, n_chars, unnest(string_split(text, ' ')) AS w FROM documents),
    h AS (SELECT item_id, w AS word, doc_id, row_number() OVER (PARTITION BY item_id, w ORDER BY n_chars, doc_id) AS n FROM k JOIN d USING (w)) SELECT item_id, word, doc_id, CAST(n AS BIGINT) AS place FROM h WHERE n <= 3""")
def lateral_topk_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every longer word of every benchmark item the three shortest documents that hold it."""
    longer = F.array_distinct(F.filter(F.split("text", " "), lambda w: F.length(w) > 4))
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.explode(longer).alias("word"))
    asked = F.broadcast(asked) if asked.count() <= J.BROADCAST_ROWS else asked
    hits = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.explode(longer).alias("word")).join(asked, "word")
    n = F.row_number().over(Window.partitionBy("item_id", "word").orderBy("n_chars", "doc_id"))
    return hits.withColumn("n", n).where("n <= 3").select("item_id", "word", "doc_id", F.col("n").cast("long").alias("place"))


@query("SELECT id AS doc_id FROM (SELECT doc_id AS id FROM documents WHERE lang = 'en' UNION SELECT vec_id FROM embeddings UNION SELECT doc_id FROM labels WHERE toxic = 1) EXCEPT SELECT item_id FROM benchmark")
def set_union_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id"), table(spark, sf_dir, "embeddings").select("vec_id"), table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")]
    return parts[0].union(parts[1]).union(parts[2]).distinct().join(table(spark, sf_dir, "benchmark"), F.col("doc_id") == F.col("item_id"), "left_anti")


@query("""SELECT o_custkey AS id, CAST(len(list_intersect(list(DISTINCT o_orderstatus), ['F', 'P'])) AS BIGINT) AS shared,
    len(list(DISTINCT o_orderstatus)) = 3 AS complete FROM orders GROUP BY 1""")
def set_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.collect_set("o_orderstatus")
    both = F.size(F.array_intersect(own, F.array(F.lit("F"), F.lit("P"))))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(both.cast("long").alias("shared"), (F.size(own) == 3).alias("complete"))


@query("SELECT conv_id, turn, role FROM conversations WHERE turn < 5 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return table(spark, sf_dir, "conversations").where("turn < 5").withColumn("n", n).where("n <= 2").select("conv_id", "turn", "role")


@query("SELECT o_orderkey AS id, o_custkey AS owner, CAST(n AS BIGINT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) o WHERE n = 2")
def newest_with_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    return table(spark, sf_dir, "orders").withColumn("n", n).where("n = 2").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), F.col("n").cast("long").alias("place"))


@query("""SELECT u.conv_id, u.turn, a.turn AS answer_turn FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
    WHERE u.role = 'user' AND a.role = 'assistant'""")
def message_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    answers = c.where("role = 'assistant'").select(F.col("conv_id").alias("c"), F.col("turn").alias("answer_turn"))
    return c.where("role = 'user'").join(answers, (F.col("c") == F.col("conv_id")) & (F.col("answer_turn") == F.col("turn") + 1)).select("conv_id", "turn", "answer_turn")


@query("SELECT o_orderkey AS id FROM orders WHERE FALSE")
def empty_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where(F.lit(False)).select(F.col("o_orderkey").alias("id"))
