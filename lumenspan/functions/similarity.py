"""Distances: cosine natively, edit operations and word trigrams as Arrow functions."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _places(items: list) -> dict:
    """For each item a number with a bit set at each of its places."""
    out: dict = {}
    for i, x in enumerate(items):
        out[x] = out.get(x, 0) | 1 << i
    return out


def edit_counts(reference: list, hypothesis: list) -> tuple[int, int, int]:
    """Substitutions, deletions, insertions of a least edit; of equal ways a substitution, then a deletion, goes first.

    Columns of the distance table are pairs of bit vectors (Myers, Hyyro) with
    a bit for each item of the reference.  The way back from the end reads
    where a diagonal step is free and where the distance grows downwards; the
    columns it needs are made again from every step-th, so memory is that of
    about 4 sqrt(n) columns.
    """
    m, n = len(reference), len(hypothesis)
    places, mask = _places(reference), (1 << m) - 1
    step = math.isqrt(n) + 1

    def columns(vp: int, vn: int, items: list):
        for h in items:
            eq = places.get(h, 0)
            d0 = (((eq & vp) + vp) ^ vp) | eq | vn
            hp, hn = (vn | ~(d0 | vp)) & mask, d0 & vp
            hp, hn = (hp << 1 | 1) & mask, (hn << 1) & mask
            vp, vn = (hn | ~(d0 | hp)) & mask, hp & d0
            yield d0, vp, vn

    starts = [(mask, 0)]
    for j, (_, vp, vn) in enumerate(columns(mask, 0, hypothesis), 1):
        if j % step == 0:
            starts.append((vp, vn))
    s = d = 0
    i, j, low, block = m, n, n, []
    while i and j:
        if j <= low:
            low = (j - 1) // step * step
            block = list(columns(*starts[low // step], hypothesis[low:j]))
        d0, vp, _ = block[j - low - 1]
        if reference[i - 1] == hypothesis[j - 1]:
            i, j = i - 1, j - 1
        elif not d0 >> i - 1 & 1:
            s, i, j = s + 1, i - 1, j - 1
        elif vp >> i - 1 & 1:
            d, i = d + 1, i - 1
        else:
            j -= 1
    return s, d + i, n - (m - d - i)


EDITS = StructType([StructField(c, IntegerType()) for c in ("substitutions", "deletions", "insertions")])


@F.pandas_udf(EDITS)
def character_edits(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([edit_counts(list(r or ""), list(h or "")) for r, h in zip(reference, hypothesis, strict=True)], columns=["substitutions", "deletions", "insertions"])


@F.pandas_udf(EDITS)
def word_edits(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([edit_counts((r or "").split(), (h or "").split()) for r, h in zip(reference, hypothesis, strict=True)], columns=["substitutions", "deletions", "insertions"])


def error_rate(errors: Column, units: Column) -> Column:
    """errors / units; of an empty reference 0 without errors and 1 with."""
    return F.when(units == 0, F.when(errors == 0, 0.0).otherwise(1.0)).otherwise(errors / units)


def trigrams(word: str) -> list[str]:
    padded = f"  {word} "
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


def word_similarity(query: str, text: str) -> float:
    """Greatest similarity between the query's trigram set and a contiguous stretch of the text's trigrams."""
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    wanted = {g for w in words(query) for g in trigrams(w)}
    grams = [g for w in words(text) for g in trigrams(w)]
    if not wanted or not grams:
        return 0.0
    places = [i for i, g in enumerate(grams) if g in wanted]
    best = 0.0
    for a, start in enumerate(places):  # a best stretch starts and ends at a shared trigram
        seen, shared, at = set(), 0, start
        for end in places[a:]:
            while at <= end:
                if grams[at] not in seen:
                    seen.add(grams[at])
                    shared += grams[at] in wanted
                at += 1
            best = max(best, shared / (len(wanted) + len(seen) - shared))
            if len(seen) - shared > len(wanted) / max(best, 0.01):
                break
    return best


@F.pandas_udf(DoubleType())
def word_similarity_column(query: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([word_similarity(q or "", t or "") for q, t in zip(query, text, strict=True)])


def indel_ratio(a: str, b: str) -> float:
    """100 * 2 * longest common subsequence / summed lengths; 100 for two empty strings.

    A row of the table is a bit vector with a bit for each character of a, 0 where the length grows.
    """
    if not a and not b:
        return 100.0
    places, mask = _places(a), (1 << len(a)) - 1
    row = mask
    for y in b:
        same = row & places.get(y, 0)
        row = (row + same | row - same) & mask
    return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


@F.pandas_udf(DoubleType())
def indel_ratio_column(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)])


def overlap_ratio(start: Column, end: Column, anchor_start: Column, anchor_end: Column) -> Column:
    """Overlap over the anchor's length, which counts as 1 at least."""
    return F.greatest(F.lit(0), F.least(end, anchor_end) - F.greatest(start, anchor_start)) / F.greatest(F.lit(1), anchor_end - anchor_start)
