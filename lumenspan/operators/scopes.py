"""Scopes and pages: which rows a request may see, and which of them it gets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def all_of(*conditions: Column | None) -> Column:
    """The conjunction of the conditions that are given; true for none."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def recording_scope(resolved: Column | None, others: list[Column], persons: Column | None) -> Column:
    """A resolved set of recordings takes the place of the other filters, not of those on persons."""
    return all_of(resolved, persons) if resolved is not None else all_of(*others, persons)


def members_semi(chunks: DataFrame, persons: DataFrame, key: str, array: str, member: str) -> DataFrame:
    """Chunks whose array holds a person's cluster of the same recording; an equi-join on exploded members decides."""
    exploded = chunks.select("*", F.explode(array).alias(member))
    hit = exploded.join(persons, [key, member], "left_semi").drop(member)
    return hit.distinct()


def compose(*scopes: Column) -> tuple[Column, Column]:
    """(ids, match_none) of scopes that narrow each other in order; a null scope does not narrow, an empty result matches nothing."""
    ids = reduce(lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.array_intersect(a, b)), scopes)
    return ids, ids.isNotNull() & (F.size(ids) == 0)


def clamped(value: int, least: int, most: int) -> int:
    return max(least, min(most, value))


def offset_page(rows: DataFrame, order: list, limit: int, offset: int, most: int = 100, far: int = 9) -> DataFrame:
    """A page by offset, limit held in 1..most and offset in 0..far."""
    return rows.orderBy(*order).offset(clamped(offset, 0, far)).limit(clamped(limit, 1, most))


def keyset_page(rows: DataFrame, key: str, sequence: str, before: int, limit: int) -> DataFrame:
    """The last ``limit`` rows of each key before a sequence, with has_more; one row more is kept to tell."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(sequence)))
    page = rows.where(F.col(sequence) < before).withColumn("__n", place).where(F.col("__n") <= limit + 1)
    more = F.max("__n").over(Window.partitionBy(key)) > limit
    return page.withColumn("has_more", more).where(F.col("__n") <= limit).drop("__n")


def local_range(column: Column, start: str, end: str, zone: str = "Asia/Shanghai") -> Column:
    """Whether a UTC time without zone lies in a half-open range of local times."""
    instant = lambda t: F.to_utc_timestamp(F.lit(t).cast("timestamp_ntz"), zone).cast("timestamp_ntz")
    return (column >= instant(start)) & (column < instant(end))


def bounded_window(start, end, now, days: int = 7, most_days: int = 31):
    """(start, end) of a query: the last ``days`` if not given; ValueError if empty or longer than ``most_days``."""
    from datetime import timedelta

    end = now if end is None else end
    start = end - timedelta(days=days) if start is None else start
    if start >= end or end - start > timedelta(days=most_days):
        raise ValueError("the window is empty or too long")
    return start, end
