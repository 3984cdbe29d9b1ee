"""The registered queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table


def piece_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    return identify(table(spark, sf_dir, "documents"), piece_model())


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), piece_model())


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_pii

    return find_pii(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"
    )


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_join import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import near_groups

    return near_groups(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import vector_codes

    return vector_codes(table(spark, sf_dir, "embeddings"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("n_grams", "llr")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def _vector_codes_sql(rounds: int = 2) -> str:
    sql = """
        WITH v AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS (SELECT vec_id, label, part, x[len(x) * part // 16 + 1 : len(x) * (part + 1) // 16] AS v FROM (SELECT *, unnest(range(16)) AS part FROM v)),
        s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v ORDER BY vec_id LIMIT 64),
        b0 AS (SELECT part, e, v AS c FROM p JOIN s USING (vec_id)),"""
    for k in range(rounds + 1):
        sql += f"""
        a{k} AS (
            SELECT vec_id, label, p.part, v, min(64 * list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) + e) AS m
            FROM p JOIN b{k} ON p.part = b{k}.part GROUP BY vec_id, label, p.part, v),"""
        if k < rounds:
            sql += f"""
        t{k} AS (SELECT part, CAST(m AS BIGINT) & 63 AS e, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{k}),
        u{k} AS (SELECT part, e, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM t{k} GROUP BY part, e, i),
        n{k} AS (SELECT part, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM u{k} GROUP BY part, e),
        b{k + 1} AS (SELECT part, e, coalesce(n{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN n{k} USING (part, e)),"""
    return sql + f"""
        r AS (
            SELECT vec_id, label, string_agg(printf('%02x', CAST(m AS BIGINT) & 63), '' ORDER BY part) AS code, CAST(sum(CAST(m AS BIGINT) >> 6) AS BIGINT) AS error
            FROM a{rounds} GROUP BY vec_id, label)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
            (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) FROM b{rounds}) AS codebooks_sha256 FROM r"""


ORACLE = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op6_warc": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
        q AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS first_id FROM p)
        SELECT page_id, n AS payload_bytes, d AS payload_digest,
               CASE WHEN n >= 1000 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id <> first_id THEN first_id END AS refers_to
        FROM q""",
    "op7_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                ('0x' || substr(md5('7:' || doc_id), 1, 15))::BIGINT AS o FROM documents),
        s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
        w AS (
            SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight,
                source_size * 2.0::DOUBLE AS cap FROM s),
        l AS (
            SELECT *, ((SELECT sum(source_size) FROM s) * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0)) / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER b, 0)) AS level
            FROM w WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        t AS (
            SELECT source, source_size, CASE WHEN f.level IS NULL THEN cap ELSE least(cap, f.level * weight) END AS target
            FROM l, (SELECT arg_min(level, cap / weight) FILTER (WHERE cap > level * weight) AS level FROM l) f),
        q AS (
            SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS cum
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        p AS (SELECT *, (cum + e * source_size) / target AS v FROM q, (SELECT unnest([0, 1]) AS e) WHERE size > 0 AND target > 0),
        r AS (
            SELECT *, sum(size) OVER (ORDER BY v, source NULLS LAST, o, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS through FROM p),
        n AS (SELECT doc_id, count(*) AS times FROM r WHERE through <= (SELECT sum(target) FROM t) GROUP BY doc_id)
        SELECT q.doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(size * coalesce(times, 0) AS BIGINT) AS taken
        FROM q LEFT JOIN n ON q.doc_id = n.doc_id""",
    "op8_embedding_join": """
        WITH RECURSIVE v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
        r(a, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a),
        m AS (SELECT a, min(c) AS c FROM r GROUP BY a),
        n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, c = vec_id AS kept FROM embeddings JOIN m ON m.a = vec_id LEFT JOIN n ON n.a = vec_id""",
    "op9_repeats": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        c AS (SELECT doc_id, b, substr(h, 2 * b + 1, 298) AS h FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49, 100)) AS b FROM d)),
        w AS (SELECT doc_id, b + j AS i, substr(h, 2 * j + 1, 100) AS s FROM (SELECT doc_id, b, h, unnest(range(least(100, len(h) // 2 - 49))) AS j FROM c)),
        f AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
        t AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM w JOIN f USING (s) WHERE doc_id > m),
        g AS (SELECT doc_id, i, sum(CASE WHEN i <= before + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM t),
        r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY doc_id, g),
        p AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM r),
        k AS (
            SELECT doc_id, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept, count(*) AS n
            FROM p JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, len(h) // 2 AS n_bytes, (len(h) - len(coalesce(kept, h))) // 2 AS n_removed, coalesce(n, 0) AS n_spans,
            sha256(unhex(coalesce(kept, h))) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)""",
    "op10_ngram_join": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, 1 + greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 75 * (x.n + y.n - c)),
        r(a, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a),
        m AS (SELECT a, min(c) AS c FROM r GROUP BY a)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id FROM d JOIN m ON m.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op11_collocations": r"""
        WITH d AS (
            SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
        t AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
        g AS (
            SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
            FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k)) GROUP BY 1, 2, 3 HAVING count(*) >= 100),
        c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM g WHERE k > 1),
        s AS (
            SELECT c.lang, c.k, c.phrase, a, cut, l.f AS l, r.f AS r, t.n,
                CAST((1000 * CAST(a AS HUGEINT) * CAST(t.n AS HUGEINT)) // (CAST(l.f AS HUGEINT) * CAST(r.f AS HUGEINT)) AS BIGINT) AS score
            FROM c JOIN g l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:cut], ' ') JOIN g r ON r.lang = c.lang AND r.phrase = array_to_string(w[cut + 1:], ' ')
                JOIN t ON t.lang = c.lang),
        m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        z AS (
            SELECT * FROM m WHERE NOT EXISTS (
                SELECT 1 FROM g WHERE g.lang = m.lang AND g.k > m.k AND 100 * g.f >= 100 * m.a AND contains(' ' || g.phrase || ' ', ' ' || m.phrase || ' ')))
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
        FROM z QUALIFY rank <= 2000""",
    "op12_vector_codes": _vector_codes_sql(),
    "op13_quality_rules": r"""
        WITH b AS (
            SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
        d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        v AS (SELECT DISTINCT w, hex(encode(w)) AS h FROM (SELECT unnest(w) AS w FROM d)),
        c AS (
            SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
                lambda a, x: xor(a >> 8, t[1 + (xor(a, x) & 255)]))) AS c FROM v, b),
        o AS (SELECT doc_id, i, c FROM (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM d) JOIN c USING (w)),
        p AS (SELECT doc_id, i, c, lag(c) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM o),
        g AS (
            SELECT doc_id, ((c * 1640531527) & 4294967295) >> 16 AS bucket FROM p
            UNION ALL SELECT doc_id, ((before * 625341585 + c * 461845907) & 4294967295) >> 16 FROM p WHERE before IS NOT NULL),
        q AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
        n AS (SELECT bucket, count(*) AS r, count(q.doc_id) AS t FROM g LEFT JOIN q USING (doc_id) GROUP BY bucket),
        m AS (SELECT bucket, t, (r + 1) / ((SELECT sum(r) FROM n) + 65536)::DOUBLE AS r FROM n),
        w AS (SELECT bucket, CAST(floor(ln((t + 655360 * r) / ((SELECT sum(t) FROM n) + 655360)::DOUBLE / r) * 1000 + 0.5) AS BIGINT) AS weight FROM m),
        s AS (SELECT doc_id, sum(weight) AS s, count(*) AS n FROM g JOIN w USING (bucket) GROUP BY doc_id),
        f AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS f FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
        u AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, f) AS n FROM f) WHERE n > 1),
        e AS (
            SELECT doc_id, sum(least(5, coalesce(j - i, 5))) AS n_repeat_words
            FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM u) GROUP BY doc_id),
        l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
        a AS (
            SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(array_to_string(w, '')) AS BIGINT) AS word_chars,
                CAST(len(text) - len(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
                CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
            FROM l LEFT JOIN e USING (doc_id)),
        k AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM a)
        SELECT k.*, NOT base_failed AND coalesce(s >= -60 * n, true) AS kept FROM k LEFT JOIN s USING (doc_id)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
