"""Windows of a text that are like a needle: the longest common subsequence by bit vectors, all starts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def window_lengths(n: int) -> tuple[int, int]:
    """Least and greatest length of the windows that a needle of n characters is compared with."""
    slack = max(2, n // 3)
    return max(1, n - slack), n + slack


def place_bits(needle: str) -> dict[str, int]:
    """For each character of the needle a number with a bit set at each of its places."""
    bits: dict[str, int] = {}
    for i, c in enumerate(needle):
        bits[c] = bits.get(c, 0) | 1 << i
    return bits


def windows_of(n: int, at: np.ndarray, room: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(starts, length, similarities) of the windows whose indel similarity is at least the threshold, a length at a time.

    at holds the bits of each character in its needle of n characters, and
    room the characters from there to the end of its text: many texts may
    stand side by side, each with a needle of its own.  Similarity is 200 times
    the longest common subsequence over the summed lengths.  Step m adds to
    every start the character m places on: a row of the table is a bit vector,
    with a 0 where the subsequence grows, so one step is a few operations on
    the vectors of all starts.  Needles beyond 63 characters take Python's
    whole numbers in place of machine words.
    """
    least, most = window_lengths(n)
    kind, size, full = at.dtype, len(at), (1 << n) - 1
    row, mask = np.full(size, full, kind), np.uint64(full) if kind == np.uint64 else full
    for m in range(1, min(most, int(room.max(initial=0))) + 1):
        row = row[: size - m + 1]
        same = row & at[m - 1 :]
        row = ((row + same) | (row - same)) & mask
        if m >= least:
            left = np.bitwise_count(row) if kind == np.uint64 else np.array([x.bit_count() for x in row])
            score = 200.0 * (n - left.astype(np.int64)) / (n + m)
            starts = np.flatnonzero((score >= threshold) & (room[: size - m + 1] >= m))
            if len(starts):
                yield starts, m, score[starts]


def alike_windows(needle: str, text: str, threshold: float) -> list[tuple[int, int, float]]:
    """(start, end, similarity) of all windows whose indel similarity is at least the threshold, by start, then end."""
    n, size = len(needle), len(text)
    if not n or not size:
        return []
    bits = place_bits(needle)
    at = np.array([bits.get(c, 0) for c in text], np.uint64 if n < 64 else object)
    found = windows_of(n, at, size - np.arange(size), threshold)
    return sorted((s, s + m, x) for starts, m, scores in found for s, x in zip(starts.tolist(), scores.tolist(), strict=True))


WINDOWS = "array<struct<start:int,end:int,similarity:double>>"


def alike_windows_of(needles: list[str], texts: list[str], threshold: float) -> list[list[tuple[int, int, float]]]:
    """alike_windows() of each needle and its text; those of needles of one length at once."""
    out: list[list[tuple[int, int, float]]] = [[] for _ in needles]
    by_length: dict[int, list[int]] = {}
    for i, needle in enumerate(needles):
        if len(needle) >= 64:
            out[i] = alike_windows(needle, texts[i], threshold)
        elif needle and texts[i]:
            by_length.setdefault(len(needle), []).append(i)
    for n, own in by_length.items():
        for first in range(0, len(own), 2000):
            some, at = own[first : first + 2000], []
            for i in some:
                bits = place_bits(needles[i])
                at += [bits.get(c, 0) for c in texts[i]]
            size = np.array([len(texts[i]) for i in some])
            which, end = np.repeat(np.arange(len(some)), size), np.cumsum(size)
            place = np.arange(len(at))
            for starts, m, scores in windows_of(n, np.array(at, np.uint64), end[which] - place, threshold):
                k = which[starts]
                for i, s, x in zip(k.tolist(), (starts - (end - size)[k]).tolist(), scores.tolist(), strict=True):
                    out[some[i]].append((s, s + m, x))
    return [sorted(x) for x in out]


def alike(needle: Column, text: Column, threshold: float) -> Column:
    """alike_windows() of two columns; no windows for null."""

    @F.pandas_udf(WINDOWS)
    def run(needles: pd.Series, texts: pd.Series) -> pd.Series:
        found = alike_windows_of([a or "" for a in needles], [b or "" for b in texts], threshold)
        return pd.Series([[{"start": s, "end": e, "similarity": x} for s, e, x in own] for own in found])

    return run(needle, text)
