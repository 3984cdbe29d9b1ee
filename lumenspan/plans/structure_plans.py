"""Aligned tokens and turns, sections and search documents, contexts and objects in texts, rolling chunks, reranking."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import alignment, documents, folds
from ..operators import retrieval as R
from ..operators import sequences as Q
from ..operators.evaluation import match_gold
from ..operators.joins import BROADCAST_ROWS
from ..sources.corpus import ctes, table, view
from ..sources.snapshots import Versions, shared_folder
from .registry import query

WORD = r"[\p{L}\p{N}]+"


def spoken_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an aligner would give for each turn: words in lower case without anything between them, some run together, some turns misheard."""
    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("pos", "word"))
    joined = words.withColumn("token", F.when(F.col("pos") % 7 == 5, F.col("pos") - 1).otherwise(F.col("pos")))
    tokens = joined.groupBy("conv_id", "turn", "token").agg(F.expr("listagg(word, '') WITHIN GROUP (ORDER BY pos)").alias("text"))
    misheard = (F.col("turn") % 5 == 4) & (F.col("token") == 0)
    return tokens.select(F.col("conv_id").alias("recording_id"), F.col("turn").alias("window_index"), F.col("token").cast("long").alias("token_index"), F.when(misheard, F.concat(F.lit("zz zz"), "text")).otherwise(F.col("text")).alias("text"))


@query(r"""WITH p AS (SELECT conv_id, turn, regexp_extract(text, '^[^\p{L}\p{N}]*') AS head, regexp_extract_all(text, '[\p{L}\p{N}]+[^\p{L}\p{N}]*') AS p, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM conversations),
    u AS (SELECT conv_id, turn, head, unnest(p) AS p, unnest(w) AS w, generate_subscripts(p, 1) - 1 AS pos FROM p),
    t AS (SELECT conv_id, turn, CASE WHEN pos % 7 = 5 THEN pos - 1 ELSE pos END AS token, string_agg(CASE WHEN pos = 0 THEN head ELSE '' END || p, '' ORDER BY pos) AS piece, string_agg(w, '' ORDER BY pos) AS said FROM u GROUP BY 1, 2, 3)
    SELECT conv_id AS recording_id, turn AS window_index, CAST(token AS BIGINT) AS token_index, CASE WHEN turn % 5 <> 4 THEN piece WHEN token = 0 THEN 'zz zz' || said ELSE said END AS restored FROM t""")
def restored_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned tokens with the punctuation, blanks and capitals of the text they were made of."""
    windows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("recording_id"), F.col("turn").alias("window_index"), "text")
    return alignment.restore_texts(spoken_tokens(spark, sf_dir), windows).select("recording_id", "window_index", "token_index", "restored")


#: Words with times: each begins where its turn's text has it, 60 ms a character, some late so that they reach into the next turn, some without duration.
TIMED = """SELECT recording_id, utterance_index * 100000 + pos AS token_index, word || ' ' AS text, lower(word) AS raw, begins AS start_ms,
        CASE WHEN pos % 11 = 3 THEN begins ELSE begins + 60 * length(word) END AS end_ms
    FROM (SELECT *, start_ms + 60 * place + CASE WHEN pos % 5 = 2 THEN 330 ELSE 0 END AS begins
        FROM (SELECT *, sum(length(word) + 1) OVER (PARTITION BY recording_id, utterance_index ORDER BY pos) - length(word) - 1 AS place FROM {words}) AS placed) AS timed WHERE trim(word) <> ''"""


@query(ctes("utt") + ", words AS (SELECT recording_id, utterance_index, start_ms, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM utt), tokens AS (" + TIMED.format(words="words") + """),
    turns AS (SELECT recording_id, utterance_index AS turn, start_ms, CASE WHEN utterance_index % 4 = 3 THEN start_ms + 400 ELSE end_ms END AS end_ms FROM utt),
    met AS (SELECT k.recording_id, k.token_index, k.text, k.raw, t.turn, row_number() OVER (PARTITION BY k.recording_id, k.token_index ORDER BY
            CASE WHEN k.end_ms > k.start_ms THEN greatest(0, least(k.end_ms, t.end_ms) - greatest(k.start_ms, t.start_ms)) ELSE CAST(t.start_ms <= k.start_ms AND k.start_ms < t.end_ms AS BIGINT) END DESC,
            CASE WHEN least(k.end_ms, t.end_ms) > greatest(k.start_ms, t.start_ms) OR (k.end_ms = k.start_ms AND t.start_ms <= k.start_ms AND k.start_ms < t.end_ms) THEN 0
                WHEN t.start_ms <= (k.start_ms + k.end_ms) // 2 AND (k.start_ms + k.end_ms) // 2 < t.end_ms THEN 0
                ELSE least(abs((k.start_ms + k.end_ms) // 2 - t.start_ms), abs((k.start_ms + k.end_ms) // 2 - t.end_ms)) END, t.start_ms, t.end_ms) AS n
        FROM tokens k JOIN turns t USING (recording_id))
    SELECT recording_id, turn, start_ms, end_ms, md5(string_agg(text, '' ORDER BY token_index)) AS text, md5(string_agg(raw, '' ORDER BY token_index)) AS original_text
    FROM met JOIN turns USING (recording_id, turn) WHERE n = 1 GROUP BY 1, 2, 3, 4""")
def assembled_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns put together from the words whose times fall into them, polished and raw; some turns are cut short."""
    utt = view(spark, sf_dir, "utt")
    words = utt.select("recording_id", "utterance_index", "start_ms", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    tokens = spark.sql(TIMED, words=words)
    turns = utt.select("recording_id", F.col("utterance_index").alias("turn"), "start_ms", F.when(F.col("utterance_index") % 4 == 3, F.col("start_ms") + 400).otherwise(F.col("end_ms")).alias("end_ms"))
    told = alignment.attribute(tokens, turns)
    tokens = tokens.join(told, ["recording_id", "token_index"])
    out = alignment.assemble(tokens, turns, tokens.select("recording_id", "token_index", "turn", F.col("raw").alias("text")))
    return out.select("recording_id", "turn", "start_ms", "end_ms", F.md5("text").alias("text"), F.md5("original_text").alias("original_text"))


#: Documents as summaries: of every four lines the first is a heading, the first of all speaks of the whole in every third document, and in every fifth there is text before it.
SUMMARIES = """SELECT doc_id, source AS title, CASE WHEN doc_id % 7 = 6 THEN ' ' ELSE {joined} END AS text FROM {lines} AS l GROUP BY doc_id, source"""
MARKED = """CASE WHEN pos % 4 <> 0 THEN CASE WHEN pos % 4 = 2 THEN '---' || chr(10) || '* ' ELSE '' END || line WHEN pos = 0 AND doc_id % 5 = 0 THEN line || chr(10) || chr(10) || 'more before'
    WHEN pos = 0 AND doc_id % 3 = 0 THEN '### 全局总结' ELSE '## *' || left(line, 30) || '*' END"""


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, title and text of every document, written as a summary with headings."""
    lines = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return spark.sql(SUMMARIES.replace("{joined}", f"listagg({MARKED}, chr(10)) WITHIN GROUP (ORDER BY pos)"), lines=lines)


MADE = f"""raw AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL),
    made AS ({SUMMARIES.format(joined=f"string_agg({MARKED}, chr(10) ORDER BY pos)", lines="raw")}),
    line AS (SELECT doc_id, unnest(list_concat([''], string_split(text, chr(10)))) AS line, generate_subscripts(list_concat([''], string_split(text, chr(10))), 1) AS pos FROM made),
    head AS (SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(13)) AS raw, CASE WHEN regexp_matches(line, '^\\s{{0,3}}#{{1,6}}\\s+.+') THEN trim(regexp_replace(regexp_extract(line, '^\\s{{0,3}}#{{1,6}}\\s+(.+?)\\s*#*\\s*$', 1), '[*_`]', '', 'g')) END AS heading FROM line),
    num AS (SELECT *, raw IN ('', '---') AS blank, count(heading) OVER (PARTITION BY doc_id ORDER BY pos) AS section, lag(raw IN ('', '---')) OVER (PARTITION BY doc_id ORDER BY pos) AS after_blank FROM head),
    sec AS (SELECT doc_id, section, max(heading) AS heading, trim(coalesce(string_agg(CASE WHEN after_blank THEN chr(10) || chr(10) ELSE chr(10) END || trim(regexp_replace(raw, '[*_`]', '', 'g')), '' ORDER BY pos) FILTER (WHERE heading IS NULL AND NOT blank), ''), ' ' || chr(10)) AS body
        FROM num GROUP BY 1, 2)"""


@query(f"WITH {MADE} SELECT doc_id, CAST(section AS BIGINT) AS section, heading, md5(body) AS body FROM sec")
def document_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and body of every section of every document, and what stands before the first."""
    return documents.sections(summaries(spark, sf_dir)).select("doc_id", "section", "heading", F.md5("body").alias("body"))


@query(f"""WITH {MADE}, named AS (SELECT *, heading LIKE '%全局总结' AS whole FROM sec WHERE section > 0),
    lead AS (SELECT *, regexp_replace(array_to_string(list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(x)), lambda x: x <> ''), ' '), '^[*+-]\\s+', '') AS flat FROM named),
    first AS (SELECT *, trim(CASE WHEN regexp_matches(flat, '[。！？!?；;]') THEN regexp_extract(flat, '^[^。！？!?；;]*[。！？!?；;]') ELSE left(flat, 200) END) AS l FROM lead),
    part AS (SELECT doc_id, arg_min(body, section) FILTER (WHERE whole AND body <> '') AS whole, arg_min(body, section) FILTER (WHERE body <> '') AS filled,
            string_agg('- ' || heading, chr(10) ORDER BY section) FILTER (WHERE NOT whole) AS headings, string_agg('- ' || heading || '：' || l, chr(10) ORDER BY section) FILTER (WHERE NOT whole AND l <> '') AS leads FROM first GROUP BY 1),
    para AS (SELECT s.doc_id, whole, headings, leads, trim(regexp_extract(CASE WHEN s.body <> '' THEN s.body ELSE coalesce(filled, '') END || chr(10) || chr(10), '(?s)^(.*?)\\n\\s*\\n', 1)) AS para FROM sec s LEFT JOIN part p USING (doc_id) WHERE s.section = 0),
    over AS (SELECT *, rtrim(left(coalesce(whole, para), 320), ' ' || chr(10)) AS overview FROM para)
    SELECT m.doc_id, md5(CASE WHEN trim(m.text) = '' THEN '录音标题：' || trim(m.title) ELSE rtrim(left(concat_ws(chr(10) || chr(10), '录音标题：' || trim(m.title), CASE WHEN overview <> '' THEN '全局概述：' || chr(10) || overview END,
        '内容结构：' || chr(10) || headings, '章节要点：' || chr(10) || leads), 512), ' ' || chr(10)) END) AS document FROM made m JOIN over o USING (doc_id)""")
def document_search_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search text of at most 512 characters for every document: title, overview, headings and what each section begins with."""
    made = documents.search_documents(summaries(spark, sf_dir), "title", count=lambda c: F.length(c))
    return made.select("doc_id", F.md5("document").alias("document"))


#: Answers with an object in them: nested, with braces and quotes inside its strings, and in every fifth turn not closed.
ANSWER = """'so: ' || left('{"role": "' || role || '", "note": "} \\\\" {' || turn || '", "args": {"n": {"turn": ' || turn || '}}}', CASE WHEN turn % 5 = 4 THEN 40 ELSE 1000 END) || ' or {}' || text"""


@query("WITH a AS (SELECT conv_id, turn, " + ANSWER.replace("\\\\", "\\") + r""" AS answer FROM conversations),
    c AS (SELECT *, generate_subscripts(string_split(answer, ''), 1) AS i, unnest(string_split(answer, '')) AS ch FROM a),
    q AS (SELECT conv_id, turn, answer, i, ch, sum(CASE WHEN ch = '"' AND NOT coalesce(substr(answer, i - 1, 1) = '\', false) THEN 1 ELSE 0 END) OVER w % 2 = 1 AS quoted FROM c WHERE i >= strpos(answer, '{') WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)),
    d AS (SELECT *, sum(CASE WHEN quoted THEN 0 WHEN ch = '{' THEN 1 WHEN ch = '}' THEN -1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY i) AS depth FROM q),
    e AS (SELECT conv_id, turn, min(i) FILTER (WHERE ch = '}' AND NOT quoted AND depth = 0) AS e FROM d GROUP BY 1, 2)
    SELECT conv_id, turn, md5(substr(answer, strpos(answer, '{'), e - strpos(answer, '{') + 1)) AS found FROM a JOIN e USING (conv_id, turn)""")
def balanced_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first whole JSON object in every answer."""
    answers = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(ANSWER).alias("answer"))
    return answers.select("conv_id", "turn", F.md5(documents.first_object(F.col("answer"))).alias("found"))


@query()
def rows_only_unique_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences around the middle word of every document that stand nowhere else in it."""
    docs = table(spark, sf_dir, "documents").where("length(text) > 0")
    start = (F.length("text") / 2).cast("int")
    return docs.select("doc_id", documents.unique_context(F.col("text"), start, F.lit(1)).alias("context"))


@query(ctes("utt").replace("WITH ", "WITH RECURSIVE ", 1) + """, n AS (SELECT recording_id, start_ms, end_ms, length(cluster) + 2 + length(text) AS n, row_number() OVER (PARTITION BY recording_id ORDER BY utterance_index) AS i FROM utt),
    r(recording_id, i, chunk, begun, end_ms, used) AS (SELECT recording_id, i, 1, start_ms, end_ms, n FROM n WHERE i = 1
        UNION ALL SELECT n.recording_id, n.i, CASE WHEN n.end_ms - begun > 120000 OR used + n > 2500 THEN chunk + 1 ELSE chunk END, CASE WHEN n.end_ms - begun > 120000 OR used + n > 2500 THEN n.start_ms ELSE begun END, n.end_ms,
            CASE WHEN n.end_ms - begun > 120000 OR used + n > 2500 THEN n ELSE used + n END FROM r JOIN n ON n.recording_id = r.recording_id AND n.i = r.i + 1)
    SELECT recording_id, CAST(chunk AS BIGINT) AS chunk_index, min(begun) AS start_ms, max(end_ms) AS end_ms, count(*) AS utterances, CAST(max(used) AS BIGINT) AS chars FROM r GROUP BY 1, 2""")
def rolling_summary_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs of a rolling summary: utterances in order, as many as two minutes and the model's room allow."""
    room = folds.rolling_budget(context=5_300, answer=500, memory=500, floor=1_000)  # 3,500 by the context, 2,500 at most
    return folds.rolling_chunks(view(spark, sf_dir, "utt"), F.length("cluster") + 2 + F.length("text"), min(room, 2_500), 120_000)


#: Documents that share a long word with a benchmark item, shortest first.
CANDIDATES = """WITH q AS (SELECT DISTINCT item_id, unnest(string_split(text, ' ')) AS w FROM benchmark), d AS (SELECT DISTINCT doc_id, n_chars, unnest(string_split(text, ' ')) AS w FROM documents),
    m AS (SELECT item_id, doc_id, n_chars, count(*) AS shared FROM q JOIN d USING (w) WHERE length(w) > 5 GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, n_chars, doc_id) AS rank FROM m)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, query, candidate_id, text, rank: for every benchmark item the documents that share a long word with it, most words first."""
    words = lambda df, i: df.select(i, F.explode(F.array_distinct(F.split("text", " "))).alias("w")).where("length(w) > 5")
    items, docs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    asked = words(items, "item_id")
    asked = F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked
    shared = words(docs, "doc_id").join(asked, "w").groupBy("item_id", "doc_id").agg(F.count("*").alias("shared"))
    met = shared.join(docs.select("doc_id", "n_chars"), "doc_id").select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("candidate_id"), "shared", "n_chars")
    best = R.top_of_each(met, "query_id", [F.desc("shared"), "n_chars", "candidate_id"], 60)
    return best.join(docs.select(F.col("doc_id").alias("candidate_id"), "text"), "candidate_id").join(items.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), "query_id")


def shared_words(queries: pd.Series, texts: pd.Series) -> pd.Series:
    """A scorer: which share of a query's words the text has."""
    return pd.Series([len(set(q.split(" ")) & set(t.split(" "))) / len(set(q.split(" "))) for q, t in zip(queries, texts, strict=True)])


@query(CANDIDATES + """, c AS (SELECT k.*, ceil(octet_length(encode(b.text || ' ' || d.text)) / 4.0) AS tokens, len(list_intersect(string_split(b.text, ' '), string_split(d.text, ' '))) / len(list_distinct(string_split(b.text, ' ')))::DOUBLE AS s
        FROM k JOIN benchmark b USING (item_id) JOIN documents d USING (doc_id) WHERE rank <= 60),
    u AS (SELECT *, CASE WHEN rank <= 40 AND sum(tokens) OVER (PARTITION BY item_id ORDER BY rank) <= 24000 THEN s END AS score FROM c),
    o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN score IS NULL THEN 1 ELSE 0 END, score DESC, CASE WHEN score IS NOT NULL THEN CAST(doc_id AS VARCHAR) END, rank) AS index FROM u)
    SELECT item_id AS query_id, doc_id AS candidate_id, round(score, 9) AS score, CAST(index AS BIGINT) AS index FROM o WHERE index <= 50""")
def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every benchmark item its candidates in the order of a scorer, those beyond the token budget after them."""
    tokens = F.ceil(F.octet_length(F.concat("query", F.lit(" "), "text")) / F.lit(4.0)).cast("long")
    out = R.rerank(candidates(spark, sf_dir), shared_words, tokens, budget=24_000, most=40, limit=50)
    return out.select("query_id", "candidate_id", F.round("score", 9).alias("score"), "index")


@query("SELECT doc_id, quality, 1 AS version, TRUE AS reused FROM labels")
def frozen_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as they were frozen: previewed, frozen, and frozen again, which finds the first version by its content."""
    versions = Versions(spark, shared_folder(spark, "cases"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    first = versions.freeze(labels, versions.preview(labels))
    again = versions.freeze(labels.orderBy("quality", "doc_id"), versions.preview(labels))
    return versions.read().select("doc_id", "quality", F.lit(first.version).alias("version"), F.lit(again == first).alias("reused"))


#: Every sixth word of a turn is followed by a mark, of which only the numbers up to 2 plus a part of the turn are known.
@query(r"""WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) - 1 AS i FROM conversations),
    m AS (SELECT *, CASE WHEN i % 6 = 5 THEN length(w) % 7 END AS n FROM w),
    f AS (SELECT conv_id, turn, n, row_number() OVER (PARTITION BY conv_id, turn ORDER BY min(i)) AS place FROM m WHERE n BETWEEN 1 AND 2 + turn % 4 GROUP BY 1, 2, 3),
    u AS (SELECT conv_id, turn, count(DISTINCT n) AS unknown FROM m WHERE n IS NOT NULL AND NOT n BETWEEN 1 AND 2 + turn % 4 GROUP BY 1, 2)
    SELECT conv_id, turn, md5(string_agg(w || CASE WHEN place IS NOT NULL THEN '[' || place || ']' ELSE '' END, ' ' ORDER BY i)) AS answer,
        coalesce((SELECT string_agg(n, ',' ORDER BY place) FROM f WHERE f.conv_id = m.conv_id AND f.turn = m.turn), '') AS cited, coalesce(max(unknown), 0) AS unknown
    FROM m LEFT JOIN f USING (conv_id, turn, n) LEFT JOIN u USING (conv_id, turn) GROUP BY conv_id, turn""")
def renumbered_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers whose citation marks are counted anew by first appearance, marks of unknown sources taken out."""
    marked = F.array_join(F.transform(F.split("text", " "), lambda w, i: F.when(i % 6 == 5, F.concat(w, F.lit("["), F.length(w) % 7, F.lit("]"))).otherwise(w)), " ")
    known = F.sequence(F.lit(1), (2 + F.col("turn") % 4).cast("int"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.renumbered(marked, known).alias("r"))
    return rows.select("conv_id", "turn", F.md5("r.text").alias("answer"), F.array_join(F.transform("r.cited", lambda n: n.cast("string")), ",").alias("cited"), F.size("r.unknown").cast("long").alias("unknown"))


@query(ctes("seg") + """, alone AS (SELECT * FROM seg s WHERE end_ms > start_ms AND NOT EXISTS (SELECT 1 FROM seg o WHERE o.recording_id = s.recording_id AND o.ordinal <> s.ordinal AND o.end_ms > o.start_ms AND o.start_ms < s.end_ms AND s.start_ms < o.end_ms))
    SELECT recording_id, ordinal, CAST(k AS BIGINT) AS window, start_ms + 2000 * k AS start_ms, least(end_ms, start_ms + 2000 * (k + 1)) AS end_ms FROM (SELECT *, unnest(range((end_ms - start_ms + 1999) // 2000)) AS k FROM alone)""")
def lone_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that nothing else is said over, in stretches of two seconds whose level can be measured."""
    return Q.lone_windows(view(spark, sf_dir, "seg"))


@query()
def rows_only_topic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search chunks that keep to sections of four turns, each with a topic, terms and a context."""
    utt = view(spark, sf_dir, "utt")
    four = utt.withColumn("section", F.expr("utterance_index div 4"))
    first = F.expr("min_by(text, utterance_index)")
    sections = four.groupBy("recording_id", "section").agg(F.min("utterance_index").alias("first_index"), F.max("utterance_index").alias("last_index"), F.split_part(first, F.lit(" "), F.lit(1)).alias("topic"), F.slice(F.split(first, " "), 2, 3).alias("terms"), F.lit("context").alias("search_context"))
    return Q.search_chunks(utt, sections)


#: Each turn is gold under its number; what was retrieved covers a turn and the first part of the next, and names a chunk, quotes it, or neither.
EVIDENCE = """SELECT recording_id AS case_id, recording_id, utterance_index AS evidence_id, utterance_index AS chunk_id, start_ms, end_ms, CAST(1 + utterance_index % 3 AS BIGINT) AS relevance, substr(text, 1, 40) AS quote FROM {utt} AS u WHERE text <> ''"""
FOUND = """SELECT recording_id AS case_id, recording_id, utterance_index AS rank, CASE WHEN utterance_index % 3 = 0 THEN utterance_index ELSE -1 END AS chunk_id,
    CASE WHEN utterance_index % 3 = 1 THEN start_ms ELSE end_ms - 1 END AS start_ms, CASE WHEN utterance_index % 3 = 1 THEN end_ms + 900 ELSE end_ms END AS end_ms, concat('... ', replace(text, ' ', '  ')) AS text FROM {utt} AS u WHERE text <> ''"""


@query(ctes("utt") + ", g AS (" + EVIDENCE.format(utt="utt") + "), f AS (" + FOUND.format(utt="utt") + r"""), m AS (SELECT f.case_id, f.rank, g.evidence_id, g.relevance,
        greatest(0, least(f.end_ms, g.end_ms) - greatest(f.start_ms, g.start_ms)) / greatest(1, g.end_ms - g.start_ms)::DOUBLE AS overlap, f.chunk_id = g.chunk_id AS same,
        strpos(trim(regexp_replace(f.text, '\s+', ' ', 'g')), trim(regexp_replace(g.quote, '\s+', ' ', 'g'))) > 0 AS quoted FROM f JOIN g USING (case_id)),
    k AS (SELECT *, CASE WHEN same THEN 3 WHEN overlap >= 0.5 THEN 2 WHEN quoted THEN 1 END AS p FROM m)
    SELECT case_id, rank, evidence_id, relevance, ['quote', 'time_overlap', 'checksum'][p] AS kind, row_number() OVER (PARTITION BY case_id, rank ORDER BY p DESC, relevance DESC, overlap DESC, evidence_id DESC) = 1 AS primary_match FROM k WHERE p IS NOT NULL""")
def gold_by_every_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold that retrieved stretches cover by chunk, by time, or by quoting it, and the primary one of each rank."""
    utt = view(spark, sf_dir, "utt")
    return match_gold(spark.sql(FOUND, utt=utt), spark.sql(EVIDENCE, utt=utt)).withColumnRenamed("primary", "primary_match")
