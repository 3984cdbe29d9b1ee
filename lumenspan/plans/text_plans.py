"""Text, distance and sequence functions over documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity as D
from ..functions import text as T
from ..operators import folds
from ..operators import sequences as Q
from ..sources.corpus import ctes, table, view
from .registry import query


@query(r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '\p{P}', ' ', 'g'), '\s+', ' ', 'g'))) AS digest FROM documents")
def normalize_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second document is written in full width first, which its normal form undoes."""
    narrow = "".join(map(chr, range(0x30, 0x7F)))
    wide = F.translate("text", narrow, "".join(chr(ord(c) + 0xFEE0) for c in narrow))
    text = F.when(F.col("doc_id") % 2 == 1, wide).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize_search(text)).alias("digest"))


@query("""SELECT doc_id, md5(concat_ws(chr(10), CASE WHEN doc_id % 2 = 0 THEN source END, lang || ' ' || source, CASE WHEN doc_id % 3 = 0 THEN 'context' END, text)) AS digest FROM documents""")
def retrieval_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    topic, context = F.when(F.col("doc_id") % 2 == 0, F.col("source")), F.when(F.col("doc_id") % 3 == 0, F.lit("context"))
    body = T.retrieval_text(F.col("text"), topic, F.array("lang", "source", "lang", F.lit(" ")), context)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(body).alias("digest"))


@query(r"""WITH p AS (SELECT doc_id, regexp_replace(regexp_replace(text, '([0-9])\.([0-9])', '\1' || chr(2) || '\2', 'g'), '([0-9])\.([0-9])', '\1' || chr(2) || '\2', 'g') AS t FROM documents),
    s AS (SELECT doc_id, list_filter(string_split(replace(replace(replace(t, '.', '.' || chr(1)), '。', '。' || chr(1)), chr(2), '.'), chr(1)), lambda x: trim(x) <> '') AS s FROM p)
    SELECT doc_id, len(s) AS pieces, md5(array_to_string(s, chr(1))) AS digest FROM s""")
def sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sentences each text has, and a digest of them all."""
    pieces = T.sentences(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(pieces).cast("long").alias("pieces"), F.md5(F.array_join(pieces, "\u0001")).alias("digest"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
    SELECT doc_id, count(*) FILTER (WHERE regexp_matches(line, '^#{1,6} ')) AS headings, count(*) FILTER (WHERE NOT regexp_matches(line, '^#{1,6} ')) AS lines FROM l GROUP BY 1""")
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("l"))
    heading = lambda x: x.rlike("^#{1,6} ")
    return lines.select("doc_id", F.size(F.filter("l", heading)).cast("long").alias("headings"), F.size(F.filter("l", lambda x: ~heading(x))).cast("long").alias("lines"))


CITED = "concat('see [', item_id % 7, '] and [', item_id % 3, '], [', item_id % 7, ']')"


@query(f"""WITH c AS (SELECT item_id, {CITED} AS t FROM benchmark), e AS (SELECT item_id, unnest(regexp_extract_all(t, '\\[([0-9]+)\\]', 1)) AS n, generate_subscripts(regexp_extract_all(t, '\\[([0-9]+)\\]', 1), 1) AS p FROM c),
    f AS (SELECT item_id, n, min(p) AS p FROM e GROUP BY 1, 2) SELECT item_id, string_agg(n, ',' ORDER BY p) AS cited FROM f GROUP BY 1""")
def citation_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.cited(F.expr(CITED)), ",").alias("cited"))


@query("SELECT doc_id, md5('<' || substr(text, 1, 3) || '>' || substr(text, 4, 7) || '[x]' || substr(text, 16)) AS digest FROM documents WHERE length(text) >= 20")
def overlay_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = lambda at, n, new: F.struct(F.lit(at).alias("start"), F.substring("text", at + 1, n).alias("old"), new.alias("new"))
    spans = F.array(span(10, 5, F.lit("[x]")), span(0, 3, F.concat(F.lit("<"), F.substring("text", 1, 3), F.lit(">"))))
    return table(spark, sf_dir, "documents").where("length(text) >= 20").select("doc_id", F.md5(T.splice(F.col("text"), spans)).alias("digest"))


@query("""WITH c AS (SELECT doc_id, octet_length(encode(text)) AS b, len(regexp_extract_all(text, '[\\x{3400}-\\x{9fff}\\x{f900}-\\x{faff}]')) AS n FROM documents)
    SELECT doc_id, n + CAST(ceil((b - 3 * n) / 4.0) AS BIGINT) + 4 AS tokens FROM c""")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


#: DuckDB's distance counts bytes: characters beyond ASCII stand for control characters that no turn holds, one for one.
PAIRS = """odd AS (SELECT coalesce(string_agg(DISTINCT c, ''), '') AS c FROM (SELECT unnest(string_split(regexp_replace(text, '[\\x00-\\x7f]', '', 'g'), '')) AS c FROM conversations) x),
    plain AS (SELECT conv_id, turn, translate(text, odd.c, substr(array_to_string(list_transform(list_concat(range(1, 9), range(11, 13), range(14, 32)), lambda i: chr(CAST(i AS INTEGER))), ''), 1, length(odd.c))) AS a FROM conversations, odd),
    pairs AS (SELECT *, lag(a) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM plain)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring turns, whole and with all characters."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("a"))
    return c.withColumn("b", F.lag("a").over(Window.partitionBy("conv_id").orderBy("turn"))).where("b is not null")


@query(f"WITH {PAIRS} SELECT conv_id, turn, CAST(levenshtein(a, b) AS DOUBLE) / greatest(1, length(a)) <= 0.8 AS close FROM pairs WHERE b IS NOT NULL")
def edit_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("conv_id", "turn", (F.levenshtein("a", "b") / F.greatest(F.lit(1), F.length("a")) <= 0.8).alias("close"))


@query(f"""WITH {PAIRS}, e AS (SELECT conv_id, levenshtein(a, b) AS e, length(a) AS n FROM pairs WHERE b IS NOT NULL)
    SELECT conv_id, round(CAST(sum(e) AS DOUBLE) / sum(n), 9) AS micro, round(avg(CAST(e AS DOUBLE) / n), 9) AS macro FROM e WHERE n > 0 GROUP BY 1""")
def cer_micro_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = pairs(spark, sf_dir).select("conv_id", F.levenshtein("a", "b").alias("e"), F.length("a").alias("n")).where("n > 0")
    return e.groupBy("conv_id").agg(F.round(F.sum("e") / F.sum("n"), 9).alias("micro"), F.round(F.avg(D.error_rate(F.col("e"), F.col("n"))), 9).alias("macro"))


@query(f"WITH {PAIRS} SELECT conv_id, turn, CAST(levenshtein(a, b) AS BIGINT) AS edits, CAST(length(a) - length(b) AS BIGINT) AS longer FROM pairs WHERE b IS NOT NULL")
def edit_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the three operations; their sum is the distance and deletions less insertions the lengths' difference."""
    e = pairs(spark, sf_dir).withColumn("o", D.character_edits("a", "b"))
    return e.select("conv_id", "turn", F.expr("o.substitutions + o.deletions + o.insertions").cast("long").alias("edits"), F.expr("o.deletions - o.insertions").cast("long").alias("longer"))


@query(f"WITH {PAIRS} SELECT conv_id, turn, levenshtein(a, b) / greatest(1, length(b))::DOUBLE <= 0.35 AS corrected FROM pairs WHERE b IS NOT NULL")
def guarded_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A correction within 0.35 of the original's length is taken, any other keeps the original."""
    return pairs(spark, sf_dir).select("conv_id", "turn", T.is_near(F.col("b"), F.col("a")).alias("corrected"))


@query("""WITH c AS (SELECT conv_id, turn, regexp_replace(lower(text), '[a-m]', 'a', 'g') AS t FROM conversations)
    SELECT conv_id, turn, len(list_filter(range(1, length(t)), lambda i: substr(t, i, 2) = 'aa')) AS starts FROM c""")
def overlapping_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often two letters of the alphabet's first half follow each other; such pairs overlap."""
    t = F.regexp_replace(F.lower("text"), "[a-m]", "a")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(T.overlapping_starts(t, F.lit("aa"))).cast("long").alias("starts"))


@query("""WITH f AS (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY t) - 1 AS i FROM f)
    SELECT conv_id, role, 'Speaker ' || chr(CAST(65 + i AS INTEGER)) AS label FROM r""")
def speaker_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    first = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("t"))
    i = F.row_number().over(Window.partitionBy("conv_id").orderBy("t")) - 1
    return first.withColumn("i", i).select("conv_id", "role", T.speaker_label(F.col("i")).alias("label"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_type(props, '$.k') IS NOT NULL AS present, epoch_us(ts) // 1000000 * 1000 + event_id % 1000 AS sequence FROM events""")
def json_and_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    return table(spark, sf_dir, "events").select("event_id", k.cast("long").alias("k"), k.isNotNull().alias("present"), (seconds * 1000 + F.col("event_id") % 1000).alias("sequence"))


@query("SELECT doc_id, sha256(text) AS content_hash, sha256(lang || ':' || source) AS identity FROM documents")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"), F.sha2(F.concat("lang", F.lit(":"), "source"), 256).alias("identity"))


@query("""SELECT vec_id, abs(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) - 1) < 0.001 AS is_unit FROM embeddings""")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = F.sqrt(D.dot(F.col("embedding"), F.col("embedding")))
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.abs(norm - 1) < 0.001).alias("is_unit"))


@query("""SELECT conv_id, md5(string_agg(trim(text), chr(10) ORDER BY turn)) AS digest FROM conversations WHERE trim(text) <> '' GROUP BY 1""")
def full_original_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("trim(text) <> ''")
    return rows.groupBy("conv_id").agg(F.md5(F.expr("listagg(trim(text), '\n') WITHIN GROUP (ORDER BY turn)")).alias("digest"))


@query(ctes("seg") + """, o AS (SELECT recording_id, list({'s': start_ms, 'e': end_ms, 'c': cluster} ORDER BY start_ms, end_ms, cluster) AS l FROM seg GROUP BY 1),
    f AS (SELECT recording_id, list_reduce(list_transform(l, lambda x: [x]), lambda a, x: CASE WHEN a[-1].c = x[1].c AND x[1].s - a[-1].e <= 3000 AND x[1].e - a[-1].s <= 80000
        THEN list_concat(a[:-2], [{'s': a[-1].s, 'e': x[1].e, 'c': a[-1].c}]) ELSE list_concat(a, x) END) AS m FROM o), u AS (SELECT recording_id, unnest(m) AS m FROM f)
    SELECT recording_id, m.s AS start_ms, m.e AS end_ms, m.c AS cluster FROM u""")
def speaker_merge_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.merge_adjacent(view(spark, sf_dir, "seg")).select("recording_id", "start_ms", "end_ms", "cluster")


@query()
def rows_only_smoothed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.smooth_segments(view(spark, sf_dir, "seg").select("recording_id", "start_ms", "end_ms", "cluster"))


@query()
def rows_only_speech_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.speech_windows(view(spark, sf_dir, "seg").select("recording_id", "start_ms", "end_ms", "ordinal"))


@query()
def rows_only_search_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.search_chunks(view(spark, sf_dir, "utt"))


@query(ctes("utt").replace("WITH ", "WITH RECURSIVE ", 1) + """, n AS (SELECT recording_id, length(text) AS n, row_number() OVER (PARTITION BY recording_id ORDER BY utterance_index) AS i FROM utt),
    r(recording_id, i, batch, total) AS (SELECT recording_id, i, 0, n FROM n WHERE i = 1
        UNION ALL SELECT n.recording_id, n.i, CASE WHEN total + n > 3000 THEN batch + 1 ELSE batch END, CASE WHEN total + n > 3000 THEN n ELSE total + n END FROM r JOIN n ON n.recording_id = r.recording_id AND n.i = r.i + 1)
    SELECT recording_id, CAST(batch AS BIGINT) AS batch, count(*) AS rows, CAST(max(total) AS BIGINT) AS total FROM r GROUP BY 1, 2""")
def budget_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    utt = view(spark, sf_dir, "utt").select("recording_id", "utterance_index", F.length("text").alias("n"))
    return folds.budget_batches(utt, "recording_id", "utterance_index", "n", 3000)


@query()
def rows_only_indel_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("conv_id", "turn", F.round(D.indel_ratio_column("a", "b"), 6).alias("ratio"))
