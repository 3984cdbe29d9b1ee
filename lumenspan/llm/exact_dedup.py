"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import among, apart, attach, written

PREFIX_CHARS = 128


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep=F.max) -> tuple[DataFrame, int]:
    """Groups of two or more equal texts: (text_sha256, group_size, keep_id), and the number of rows.

    keep chooses the id that stays, the largest or the smallest.

    1. Rows are counted by length in bytes; lengths that occur once are done.
    2. Of rows with a surviving length, prefixes are hashed and counted.
    3. The whole text is hashed only for rows whose length and prefix survive.

    Each step's survivors reach the next scan as a bitmap sized by their
    number, so texts are never shuffled; another row with a survivor's bit is
    only read once more than needed, and the full hash decides.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("__id"), text.alias("__t"), F.octet_length(text).alias("__n"))
    by_length = written(rows.groupBy("__n").agg(F.count("*").alias("c")), "lengths")
    total, several = by_length.agg(F.sum("c"), F.count_if(F.col("c") > 1)).first()
    rows = among(rows, F.xxhash64("__n"), by_length.where("c > 1").select(F.xxhash64("__n")), several)
    prefix = F.xxhash64(F.col("__n"), F.substring("__t", 1, PREFIX_CHARS))
    by_prefix = written(rows.groupBy(prefix.alias("p")).agg(F.count("*").alias("c")).where("c > 1").select("p"), "prefixes")
    rows = among(rows, prefix, by_prefix, by_prefix.count())
    groups = (
        rows.groupBy(F.sha2("__t", 256).alias("text_sha256"))
        .agg(F.count("*").alias("group_size"), keep("__id").alias("keep_id"))
        .where("group_size > 1")
    )
    return written(groups, "copies"), total or 0


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as empty and so equals
    it.  Of equal texts the row with the largest id stays; a null id loses to
    any other, and in a group of null ids only, keep_id is null and all rows
    are kept.  Rows repeated with the same id and text are all marked like the
    first.  An empty table gives an empty result; columns other than the two
    named are not looked at.
    """
    groups, total = duplicate_groups(docs, id_col, text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("text_sha256")
    )
    out = attach(rows, groups, "text_sha256", "group_size", total, F.col("doc_id"))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but one row of each group of equal texts, columns as they were.

    The row with the largest id stays.  Where that id itself is repeated with
    the same text, one of its rows stays.  Rows are filtered in place by a
    bitmap of the ids and hashes that go; only rows that it marks, which are
    those that go and a few others, are shuffled with their texts.
    """
    groups, total = duplicate_groups(docs, id_col, text_col)
    names = docs.columns
    sha = F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), sha.alias("text_sha256"), F.col(f"`{id_col}`").alias("__id"))
    members = attach(rows.select("__id", "text_sha256"), groups, "text_sha256", "group_size", total, F.col("__id")).where("group_size is not null")
    # of a group go all ids but one, and of that one all rows but one
    verdicts = members.groupBy("__id", "text_sha256").agg(F.count("*").alias("n"), F.first("keep_id").alias("keep"))
    verdicts = verdicts.select(F.col("__id").alias("__g"), F.col("text_sha256").alias("__s"), F.col("__id").eqNullSafe(F.col("keep")).alias("__one"), "n")
    verdicts = written(verdicts.where("not __one or n > 1").drop("n"), "verdicts")
    clean, doubtful = apart(rows, F.xxhash64("__id", "text_sha256"), verdicts.select(F.xxhash64("__g", "__s")), verdicts.count())
    meets = F.col("__id").eqNullSafe(F.col("__g")) & (F.col("text_sha256") == F.col("__s"))
    judged = doubtful.join(verdicts, meets, "left")
    left = clean.select("__row").unionByName(judged.where("__one is null").select("__row"))
    if not verdicts.where("__one").isEmpty():
        left = left.unionByName(judged.where("__one").groupBy("__id", "text_sha256").agg(F.first("__row").alias("__row")).select("__row"))
    return left.select(*[F.col("__row").getField(c).alias(c) for c in names])
