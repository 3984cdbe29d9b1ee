"""Quality rules: base statistics of texts and hashed n-gram log-likelihood ratios, in SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, marked, marks, written

SYMBOLS = "#*$%&|<>"
#: Words of a window that may repeat.
WINDOW = 5
LEAST_WORDS = 10
#: Words in repeated windows beyond this share, in hundredths, fail the base rules.
MOST_REPEATED = 20
#: Buckets of the two multinomials; a table of so many numbers is the model, whatever the input.
BUCKETS = 1 << 16
#: Strength of the target's prior, in n-grams: the raw corpus's distribution, so that a bucket little seen says little.
PRIOR = 10 * BUCKETS
#: Thousandths of a nat; a weight is so many of them, whole, so that sums are exact in any order.
UNIT = 1000
#: A document is kept from this mean weight of its n-grams.
THRESHOLD = -60


def _words(text: Column) -> Column:
    """The runs of characters other than the six ASCII blanks."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def _bucket(mixed: Column) -> Column:
    """The upper 16 of the lower 32 bits."""
    return F.shiftrightunsigned(mixed.bitwiseAND(F.lit(0xFFFFFFFF)), 32 - (BUCKETS.bit_length() - 1))


def _one(c: Column) -> Column:
    return _bucket(c * F.lit(1_640_531_527))


def _codes(words: str) -> Column:
    return F.transform(words, lambda w: F.crc32(w.cast("binary")))


def _beside(left: str, right: str, by: int, what) -> Column:
    """what(x, y) of each item of left and the one of right that stands ``by`` places further on."""
    n = F.greatest(F.lit(0), F.least(F.size(left), F.size(right) - by))
    return F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(1 + by), n), what)


def _pairs(codes: str) -> Column:
    """A number for each two words in a row; its bucket is that of the two."""
    return _beside(codes, codes, 1, lambda c, d: c * F.lit(625_341_585) + d * F.lit(461_845_907))


def _counts(texts: DataFrame) -> DataFrame:
    """(bucket, r, t): n-grams of one and two words of all rows (text, trusted), and of the trusted ones; combined before their shuffle."""
    coded = texts.select("trusted", _words(F.col("text")).alias("words")).select("trusted", _codes("words").alias("codes")).select("trusted", "codes", _pairs("codes").alias("pairs"))
    buckets = F.concat(F.transform("codes", _one), F.transform("pairs", _bucket))
    return coded.select("trusted", F.explode(buckets).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("r"), F.count_if("trusted").alias("t"))


def train(docs: DataFrame, trusted: DataFrame) -> list[int]:
    """The weight of each bucket: UNIT times the logarithm of target over raw probability, rounded.

    docs has doc_id and text; every row counts in the raw corpus, and in the
    target too if trusted (doc_id) holds its id.  Which rows are trusted is
    told without a shuffle of texts: a bitmap marks all trusted ids and a few
    others, and a second bitmap, of those others, marks them and a few trusted
    ones; only rows that both mark are joined.  Without trusted text all
    weights are 0.  The result has BUCKETS numbers.
    """
    key, of = F.xxhash64("doc_id"), F.xxhash64("__id")
    docs = docs.where("text is not null")
    ids = written(trusted.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("__id")).distinct(), "trusted")
    first = marks(ids.select(of), ids.count())
    others = marked(docs.where("doc_id is not null").select("doc_id"), key, first).where("__hit").select(F.col("doc_id").alias("__id")).join(ids, "__id", "left_anti").distinct()
    others = written(others, "marked-in-vain")
    both = marked(marked(docs, key, first).withColumnRenamed("__hit", "__first"), key, marks(others.select(of), others.count()))
    told = both.select("doc_id", "text", (F.col("__first") & ~F.col("__hit")).alias("trusted"), (F.col("__first") & F.col("__hit")).alias("doubtful"))
    doubtful = told.where("doubtful").join(ids, F.col("doc_id") == F.col("__id"), "left_semi").select("text", F.lit(True).alias("trusted"))
    counts = written(_counts(told.select("text", "trusted")).unionByName(_counts(doubtful).withColumn("r", F.lit(0).cast("long"))), "counts")
    counts_ = counts.groupBy("bucket").agg(F.sum("r").alias("r"), F.sum("t").alias("t"))
    n = counts.agg(F.sum("r").alias("raw"), F.sum("t").alias("target")).first()
    raw_n, target_n = n["raw"] or 0, n["target"] or 0
    p = (F.col("r") + 1) / F.lit(float(raw_n + BUCKETS))
    weight = lambda r, t: F.floor(F.log((t + PRIOR * r) / float(target_n + PRIOR) / r) * UNIT + 0.5)
    own = {r["bucket"]: r["w"] for r in counts_.select("bucket", weight(p, F.col("t")).alias("w")).collect()}  # BUCKETS rows at most
    unseen = counts.sparkSession.range(1).select(weight(F.lit(1.0), F.lit(0.0)).alias("w")).first()["w"]
    for table in (ids, others, counts):
        discard(table)
    return [own.get(b, unseen) for b in range(BUCKETS)]


def _statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, codes, pairs, n_words and the base statistics of every row."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    window = lambda i: F.concat_ws(" ", *[F.get("words", i + k) for k in range(WINDOW)])
    windows = F.sort_array(F.transform(F.sequence(F.lit(0), F.col("n_words") - WINDOW), lambda i: F.struct(window(i).alias("s"), i.alias("i"))))
    same = lambda x, at: F.coalesce(F.get("windows", at)["s"] == x["s"], F.lit(False))
    twice = F.sort_array(F.transform(F.filter("windows", lambda x, k: F.when(k > 0, same(x, k - 1)).otherwise(False) | same(x, k + 1)), lambda x: x["i"]))
    covered = F.aggregate(F.transform("twice", lambda p, k: F.coalesce(F.least(F.get("twice", k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda a, b: a + b)
    out = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).withColumn("words", _words(F.col("text")))
    out = out.withColumn("lines", lines).select(
        "doc_id", "words", F.size("words").alias("n_words"), _codes("words").alias("codes"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    # windows whose keys are all different are all different; only other texts look at the windows themselves
    out = out.withColumn("pairs", _pairs("codes")).withColumn("fours", _beside("pairs", "pairs", 2, lambda x, y: F.xxhash64(x, y)))
    out = out.withColumn("keys", _beside("fours", "codes", WINDOW - 1, lambda x, y: F.xxhash64(x, y))).drop("fours")
    out = out.withColumn("windows", F.when(F.size("keys") > F.size(F.array_distinct("keys")), windows)).drop("keys", "words")
    out = out.withColumn("twice", twice).drop("windows")
    return out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("twice")


def apply_rules(docs: DataFrame, weights: list[int], id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_grams and llr of every row.

    Null text has no word.  A document fails the base rules with fewer than
    LEAST_WORDS words, or with more than MOST_REPEATED hundredths of its words
    in windows of WINDOW words that it has twice or more.  Of the others those
    stay whose n-grams of one and two words have a mean weight of at least
    ``threshold``; the comparison is of whole numbers, so it never depends on
    the order of a sum.  llr is that mean in nats, null without a word.

    Each row is judged by itself, without a shuffle: repeated rows, repeated
    and null ids get a row each, and other columns are not read.
    """
    weight = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<bigint>")  # folded to one array when the plan is made
    total = lambda items, bucket: F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a + F.get(weight, bucket(x)))
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    out = _statistics(docs, id_col, text_col).withColumn("sum", total("codes", _one) + total("pairs", _bucket)).withColumn("base_failed", failed)
    grams = F.greatest(F.col("n_words") * 2 - 1, F.lit(0)).cast("long")
    return out.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("sum") >= grams * threshold)).alias("kept"), grams.alias("n_grams"), F.try_divide(F.col("sum") / UNIT, grams).alias("llr"),
    )


def quality_rules(docs: DataFrame, labels: DataFrame, label_col: str = "quality", threshold: int = THRESHOLD) -> DataFrame:
    """apply_rules with weights learned from docs; the trusted target is the documents with a label of 1.

    A document labelled more than once is trusted if one label is 1.  Labels
    that are null, or of no document, say nothing.
    """
    trusted = labels.where(F.col(f"`{label_col}`") == 1).select("doc_id")
    weights = train(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), trusted)
    return apply_rules(docs, weights, threshold=threshold)
