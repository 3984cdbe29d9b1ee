"""Personal data: exact patterns, and terms that corpus co-occurrence shows to disclose an entity.

The patterns find e-mail addresses, IP addresses, card and phone numbers.
Each distinct value is a protected entity.  Words near its occurrences are
terms; a term discloses an entity when their pointwise mutual information,
estimated from all documents, is close to the entity's own information.  Such
terms are generalised, or removed when they all but name the entity.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

KINDS = ("email", "ip", "card", "phone", "term")
#: Words on either side of an entity that count as its context.
WINDOW = 8
#: Shorter words are no terms.
LEAST_LETTERS = 4
#: Different contexts in which a term must stand beside an entity; copies of one passage are one context.
SUPPORT = 3
#: Share of an entity's information from which a term is generalised, and from which it is removed.
GENERALISE, REMOVE = 0.9, 0.97
#: Candidate terms up to this many are sent to every task that counts documents; more are counted by a join.
BROADCAST_TERMS = 200_000

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\W\d_]+")
DIGITS = re.compile(r"[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses, found from each @ so that long runs without one cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all pattern matches, by start and then kind; a failing match is dropped."""
    out = [(s, 0, e) for s, e in emails(text)]
    for m in IP.finditer(text):
        if all(len(p := g.lstrip("0")) < 3 or len(p) == 3 and int(p) <= 255 for g in m.groups()):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(DIGITS.findall(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def entity_of(text: str, start: int, end: int) -> int:
    return xxhash.xxh64_intdigest(text[start:end].lower()) >> 1


def _words_before(text: str, start: int) -> list[tuple[int, int]]:
    """The last WINDOW words before a place, looked for in a stretch that widens until it holds them whole."""
    reach = 40 * WINDOW
    while True:
        low = max(0, start - reach)
        found = [(m.start() + low, m.end() + low) for m in TERM.finditer(text[low:start])]
        if low and found and found[0][0] == low:
            del found[0]  # it may begin earlier
        if not low or len(found) >= WINDOW:
            return found[-WINDOW:]
        reach *= 4


def contexts(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, str, int, int, int]]:
    """(entity, term, start, end, context) for the words around each span; entity and context are hashes."""
    out = []
    for start, _, end in spans:
        entity = entity_of(text, start, end)
        before = _words_before(text, start)
        after = [m.span() for m in itertools.islice(TERM.finditer(text, end), WINDOW)]
        words = [(text[s:e].lower(), s, e) for s, e in before + after]
        context = xxhash.xxh64_intdigest(" ".join(w for w, _, _ in words)) >> 1
        for w, s, e in words:
            if len(w) >= LEAST_LETTERS and not any(s < b and a < e for a, _, b in spans):
                out.append((entity, w, s, e, context))
    return out


SPAN = pa.struct([("s", pa.int64()), ("k", pa.int32()), ("e", pa.int64())])
TERMS = pa.struct([("entity", pa.int64()), ("term", pa.string()), ("s", pa.int64()), ("e", pa.int64()), ("context", pa.int64())])
FOUND = (
    "doc_id long, row long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
    "base array<struct<s: long, k: int, e: long>>, entities array<long>, "
    "terms array<struct<entity: long, term: string, s: long, e: long, context: long>>"
)


def find_base(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The patterns' spans and the terms around them for every row; row is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            spans = [base_spans(t) for t in texts]
            counts = [Counter(k for _, k, _ in x) for x in spans]
            shas = [hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in x).encode()).hexdigest() for x in spans]
            rows = [xxhash.xxh64_intdigest(t) >> 1 if x else 0 for t, x in zip(texts, spans, strict=True)]
            terms = [contexts(t, x) if x else [] for t, x in zip(texts, spans, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(rows, pa.int64()),
                    *[pa.array([c[k] for c in counts], pa.int64()) for k in range(4)],
                    pa.array(shas, pa.string()),
                    pa.array([[{"s": s, "k": k, "e": e} for s, k, e in x] for x in spans], pa.list_(SPAN)),
                    pa.array([sorted({entity_of(t, s, e) for s, _, e in x}) for t, x in zip(texts, spans, strict=True)], pa.list_(pa.int64())),
                    pa.array([[dict(zip(("entity", "term", "s", "e", "context"), y, strict=True)) for y in x] for x in terms], pa.list_(TERMS)),
                ],
                [x.split()[0] for x in FOUND.split(", base array")[0].split(", ")] + ["base", "entities", "terms"],
            )

    return small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, FOUND)


def document_counts(docs: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, df): in how many of all documents each of the terms occurs.

    Each task counts its documents' distinct words and sends a row for each
    word once.  Up to BROADCAST_TERMS terms are sent to the tasks as a set;
    more are joined to the counts.
    """
    n = terms.count()
    small = frozenset(r["term"] for r in terms.collect()) if n <= BROADCAST_TERMS else None
    bound = docs.sparkSession.sparkContext.broadcast(small)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only, counts = bound.value, Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])
            counts.clear()
            return batch

        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = set(TERM.findall((text or "").lower()))
                counts.update(words if only is None else words & only)
            if len(counts) > 300_000:
                yield out()
        if counts:
            yield out()

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("df"))
    return counted if small is not None else counted.join(terms, "term", "left_semi")


def disclosing(found: DataFrame, docs: DataFrame, text_col: str = "text", support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """(entity, term, disclosure) of the pairs at or above the threshold.

    disclosure = PMI(term; entity) / information(entity), all frequencies
    being numbers of documents (rows, copies included): of the entity, of the
    term, and of both where the term is near the entity.  A row gives each
    entity and pair once, so rows are combined before they meet.  Different
    contexts count for the support of a pair only.
    """
    total = found.count()
    near = found.where(F.size("terms") > 0)
    contexts_ = near.select(F.explode("terms").alias("t")).select("t.entity", "t.term", "t.context").distinct().groupBy("entity", "term").agg(F.count("*").alias("contexts"))
    once = F.array_distinct(F.transform("terms", lambda t: F.struct(t["entity"].alias("entity"), t["term"].alias("term"))))
    both = near.select(F.explode(once).alias("t")).groupBy("t.entity", "t.term").agg(F.count("*").alias("both"))
    pairs = written(contexts_.where(F.col("contexts") >= support).join(both, ["entity", "term"]).select("entity", "term", "both"), "pairs")
    entities = found.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("ef"))
    df = written(document_counts(docs, written(pairs.select("term").distinct(), "terms"), text_col), "frequencies")
    n = F.lit(float(max(total, 1)))
    information = F.log2(n / F.col("ef"))
    pmi = F.log2(F.col("both") * n / (F.greatest("df", "both") * F.col("ef")))
    measured = pairs.join(entities, "entity").join(df, "term").withColumn("disclosure", F.when(information > 0, F.least(F.lit(1.0), pmi / information)).otherwise(0.0))
    return measured.where(F.col("disclosure") >= generalise).select("entity", "term", "disclosure")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and the spans as an array, for every row.

    Null counts as empty, which has no span.  Offsets are in code points of
    the whole text.  Terms lie in contexts of a base span only, so a document
    without one has no span at all.  Rows repeated with the same id and text
    get the same spans; an empty table gives an empty result; other columns
    are not read.
    """
    found = written(find_base(docs, id_col, text_col), "base")
    revealing = written(disclosing(found, docs, text_col), "disclosing")
    marks = (
        found.where(F.size("terms") > 0).select("doc_id", "row", F.explode("terms").alias("t")).select("doc_id", "row", "t.entity", "t.term", "t.s", "t.e")
        .join(revealing, ["entity", "term"])
        .groupBy("doc_id", "row", "s", "e").agg(F.max("disclosure").alias("disclosure"))
        .groupBy(F.col("doc_id").alias("d2"), F.col("row").alias("r2"))
        .agg(F.collect_list(F.struct(F.col("s"), F.lit(4).alias("k"), F.col("e"))).alias("more"), F.collect_list(F.struct("s", "e", "disclosure")).alias("levels"))
    )
    bare = found.where(F.size("terms") == 0).select("*", F.lit(None).cast("array<struct<s:bigint,k:int,e:bigint>>").alias("more"), F.lit(None).cast("array<struct<s:bigint,e:bigint,disclosure:double>>").alias("levels"))
    rich = found.where(F.size("terms") > 0).join(marks, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("row") == F.col("r2")), "left").select(*found.columns, "more", "levels")
    every = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<s:bigint,k:int,e:bigint>>"))))
    names = F.array(*map(F.lit, KINDS))
    text = F.transform(every, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string")))
    return bare.unionByName(rich).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.array_join(text, ",").alias("spans"), every.alias("span_list"), "levels"
    )


def sanitised(text: str, spans: list[tuple[int, int, int]], levels: dict[tuple[int, int], float]) -> str:
    """The text with base spans replaced by their kind and disclosing terms generalised or removed.

    Of overlapping spans the one that starts first, then the longest, is
    replaced; the others fall inside it or are cut to what is left.
    """
    out, at = [], 0
    for s, k, e in sorted(spans, key=lambda x: (x[0], -x[2])):
        if e <= at:
            continue
        out.append(text[at : max(at, s)])
        if k < 4:
            out.append(f"[{KINDS[k].upper()}]")
        elif levels.get((s, e), 0.0) < REMOVE:
            out.append("[TERM]")
        at = e
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the sanitised text of every row that has a span."""
    found = find_pii(docs, id_col, text_col).where(F.size("span_list") > 0).select(F.col("doc_id").alias("d"), "span_list", "levels")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    clean = F.udf(
        lambda t, spans, levels: sanitised(t or "", [(x["s"], x["k"], x["e"]) for x in spans], {(x["s"], x["e"]): x["disclosure"] for x in levels or []}),
        "string", useArrow=True,
    )
    return texts.join(found, F.col("doc_id").eqNullSafe(F.col("d"))).select("doc_id", clean("text", "span_list", "levels").alias("text"))
