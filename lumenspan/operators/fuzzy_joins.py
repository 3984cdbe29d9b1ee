"""Approximate substring search: needles meet texts over pieces, where the texts are or in a join, and only what meets is compared."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from ..functions.fuzzy import alike, alike_windows, place_bits, window_lengths, windows_of
from .joins import BROADCAST_ROWS

#: Needles up to which every task has them all; beyond, texts and needles meet in a join.
MOST_NEEDLES = 10_000
#: Characters searched at once, hits of pieces looked at at once, and bits of the table of pieces.
BATCH_CHARS, BATCH_HITS, TABLE_BITS = 1 << 19, 1 << 20, 18
#: Pieces of a needle that an occurrence leaves whole at least, where the needle is long enough; one allows the longest, and so rarest, pieces.
WHOLE = 1


def _pieces(needles: DataFrame, threshold: float) -> DataFrame:
    """needle_id, needle, most, edits, width, needed, at, piece of every piece of every needle.

    A window of m characters that is alike enough has a subsequence of at
    least threshold * (n + m) / 200 characters in common with the needle.  So
    m is at most n * (200 / threshold - 1), and n + m less twice the
    subsequence, the single characters taken out or put in, is at most
    ``edits``.  Each of these spoils one piece at most: of p pieces side by
    side p - edits stay whole.
    """
    n, share = F.length("needle"), (100.0 - threshold) / 100
    most = F.least(n + F.greatest(F.lit(2), F.floor(n / 3)), F.floor(n * (200.0 / threshold - 1) + 1e-9)).cast("int")
    rows = needles.where(n > 0).select("needle_id", "needle", n.alias("n"), most.alias("most"))
    rows = rows.withColumn("edits", F.floor((F.col("n") + F.col("most")) * share + 1e-9).cast("int"))
    rows = rows.withColumn("width", F.greatest(F.lit(1), F.floor(F.col("n") / (F.col("edits") + WHOLE))).cast("int"))
    rows = rows.withColumn("count", F.floor(F.col("n") / F.col("width")).cast("int")).withColumn("needed", F.greatest(F.lit(1), F.col("count") - F.col("edits")))
    return rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("count") - 1))).select(
        "needle_id", "needle", "most", "edits", "width", "needed", (F.col("i") * F.col("width")).alias("at"),
        F.substring(F.col("needle"), F.col("i") * F.col("width") + 1, F.col("width")).alias("piece"),
    )


def _grams(texts: DataFrame, widths: list[int]) -> DataFrame:
    """text_id, width, place, piece of all stretches of the given widths; texts themselves are not repeated."""
    chars = texts.select("text_id", F.split("text", "").alias("c"))
    stretch = lambda w: F.transform(
        F.sequence(F.lit(0), F.size("c") - w),
        lambda i: F.struct(F.lit(w).alias("width"), i.alias("place"), F.concat(*[F.get("c", i + k) for k in range(w)]).alias("piece")),
    )
    empty = F.array().cast("array<struct<width:int,place:int,piece:string>>")
    every = F.concat(*[F.when(F.size("c") >= w, stretch(w)).otherwise(empty) for w in widths])
    return chars.select("text_id", F.explode(every).alias("g")).select("text_id", "g.*")


def _bounds(n: int, threshold: float) -> tuple[int, int, int, int]:
    """Of a needle of n characters and a window alike enough: edits, characters put in and taken out, and pairs of neighbours lost, at most.

    With d characters taken out and i put in, the window has n - d + i
    characters and n - d in common with the needle.  A character taken out
    loses two pairs of neighbours, one put in loses one.
    """
    slack = window_lengths(n)[1] - n
    ways = [(d, min(slack + d, int(np.floor(200.0 * (n - d) / threshold - 2 * n + d + 1e-9)))) for d in range(n)]
    ways = [(d, i) for d, i in ways if i >= 0] or [(0, 0)]
    return max(d + i for d, i in ways), max(i for _, i in ways), max(d for d, _ in ways), max(2 * d + i for d, i in ways)


def _mix(x: np.ndarray, bits: int) -> np.ndarray:
    return (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


def _pairs(flat: np.ndarray) -> list[np.ndarray]:
    """For every character and the next one 128 bits, as two halves, with one set."""
    bit = _mix(flat[:-1] * np.uint64(0x10001) + flat[1:], 7)
    one, none = np.uint64(1) << (bit & np.uint64(63)), np.uint64(0)
    return [np.where(bit < 64, one, none), np.where(bit < 64, none, one)]


class _Search:
    """Needles as tables: their pieces by hash, and the pairs of neighbours that their occurrences keep.

    An occurrence leaves one of edits + 1 pieces of its needle whole.  Where a
    piece stands, the stretch around it must hold all pairs of neighbours of
    the needle but for a few, and then all its characters in order but for a
    few; these tests let some stretches pass that hold no occurrence, and none
    that does is lost.  The windows of what remains are compared.
    """

    def __init__(self, needles: list[str], threshold: float):
        self.needles, self.threshold = needles, threshold
        known = sorted(set("".join(needles)))
        self.classes = np.zeros(0x110000, np.uint32)  # from 1; 0 for characters that no needle has
        self.classes[[ord(c) for c in known]] = np.arange(len(known)) + 1
        self.n = np.array([len(x) for x in needles])
        of = {n: _bounds(n, threshold) for n in set(self.n.tolist())}
        edits, self.more, self.out, self.lost = (np.array([of[n][k] for n in self.n.tolist()]) for k in range(4))
        self.spans = np.maximum(1, self.n + 2 * self.more - 1)  # pairs of neighbours around a piece
        self.level = np.frexp(self.spans.astype(float))[1] - 1
        self.pad = int((self.n + 2 * self.more).max()) + 1
        self.overlap = window_lengths(int(self.n.max()))[1]
        self.pairs = np.zeros((2, len(needles)), np.uint64)
        self.bits = np.zeros((len(needles), len(known) + 1), np.uint64)
        entries: dict[int, list[tuple[int, int, int]]] = {}
        for q, needle in enumerate(needles):
            own = self._classes(needle)
            if len(own) > 1:
                self.pairs[:, q] = [np.bitwise_or.reduce(x) for x in _pairs(own)]
            for c, b in place_bits(needle).items() if len(own) < 64 else ():
                self.bits[q, self.classes[ord(c)]] = b
            count = min(len(own), int(edits[q]) + 1)
            cuts = [len(own) * k // count for k in range(count + 1)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                entries.setdefault(y - x, []).append((int(self._hashes(own[x:y], y - x)[0]), q, x))
        self.tables = {}
        for width, rows in entries.items():
            h, q, at = np.array(sorted(rows)).T
            first = np.searchsorted(h, np.arange((1 << TABLE_BITS) + 1)).astype(np.int32)
            self.tables[width] = np.diff(first) > 0, first, q, at

    def _classes(self, text: str) -> np.ndarray:
        return self.classes[np.frombuffer(text.encode("utf-32-le"), np.uint32)].astype(np.uint64)

    def _hashes(self, flat: np.ndarray, width: int) -> np.ndarray:
        h = flat[: len(flat) - width + 1]
        for k in range(1, width):
            h = h * np.uint64(0xD6E8FEB86659FD93) + flat[k : len(flat) - width + 1 + k]
        return _mix(h ^ (h >> np.uint64(29)), TABLE_BITS)

    def _candidates(self, flat: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(needle, place of a piece, where the needle would begin) of the pieces whose stretch may hold an occurrence."""
        levels = [_pairs(flat)]  # the bits of 1, 2, 4 and more pairs in a row
        for k in range(int(self.level.max())):
            levels.append([x.copy() for x in levels[-1]])
            for x, y in zip(*levels[-2:], strict=True):
                y[: -(1 << k)] |= x[1 << k :]
        for width, (filled, first, needle, at) in self.tables.items():
            h = self._hashes(flat[self.pad : -self.pad], width).astype(np.int64)
            place = np.flatnonzero(filled[h])
            h = h[place]
            times = (first[h + 1] - first[h]).astype(np.int64)
            place, ends, done = place + self.pad, np.cumsum(times), 0
            while done < len(place):
                before = int(ends[done - 1]) if done else 0
                stop = max(done + 1, int(np.searchsorted(ends, before + BATCH_HITS, side="right")))
                own, reps = slice(done, stop), times[done:stop]
                entry = np.arange(int(ends[stop - 1]) - before) + np.repeat(first[h[own]] - (ends[own] - reps - before), reps)
                q, p = needle[entry], np.repeat(place[own], reps)
                b = p - at[entry]
                for level in np.unique(self.level[q]).tolist():
                    of = np.flatnonzero(self.level[q] == level)
                    k = q[of]
                    lo = b[of] - self.more[k]
                    last = np.maximum(lo, lo + self.spans[k] - (1 << level))
                    gone = sum(np.bitwise_count(x[k] & ~(y[lo] | y[last])) for x, y in zip(self.pairs, levels[level], strict=True))
                    keep = of[gone <= self.lost[k]]
                    yield q[keep], p[keep], b[keep]
                done = stop

    def _close(self, q: np.ndarray, b: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """The numbers of the candidates whose stretch has a subsequence long enough in common with the needle."""
        kept, bits, classes = [np.flatnonzero(self.n[q] >= 64)], self.bits.ravel(), self.bits.shape[1]
        for n in np.unique(self.n[q]).tolist():
            of = np.flatnonzero(self.n[q] == n)
            for first in range(0, len(of) if n < 64 else 0, BATCH_HITS >> 4):
                some = of[first : first + (BATCH_HITS >> 4)]
                own, at, mask = q[some] * classes, b[some] - self.more[q[some]], np.uint64((1 << n) - 1)
                row = np.full(len(some), mask)
                for i in range(n + 2 * int(self.more[q[some[0]]])):
                    same = row & bits[own + flat[at + i]]
                    row = ((row + same) | (row - same)) & mask
                kept.append(some[np.bitwise_count(row) <= self.out[q[some]]])
        return np.concatenate(kept)

    def occurrences(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(needle, text, start, end, similarity) of all windows of some texts that are alike a needle, once each, in any order."""
        sizes = np.array([len(t) for t in texts])
        begin = self.pad + np.cumsum(sizes + 1) - sizes - 1
        flat = np.zeros(int(begin[-1] + sizes[-1]) + 1 + self.pad, np.uint64)
        flat[self.pad : -self.pad] = self._classes("\0".join(texts) + "\0")
        flat[begin + sizes] = 0
        q, place, b = (np.concatenate(x) for x in zip(*self._candidates(flat), (np.zeros(0, np.int64),) * 3, strict=True))
        close = self._close(q, b, flat.astype(np.int64))
        q, place, b = q[close], place[close], b[close]
        text = np.searchsorted(begin, place, side="right") - 1
        lo, hi = np.maximum(b - self.more[q], begin[text]), np.minimum(b + self.n[q] + self.more[q], begin[text] + sizes[text])
        order = np.lexsort((lo, q))
        order = order[lo[order] < hi[order]]
        q, text, lo, hi = q[order], text[order], lo[order], hi[order]
        # stretches of a needle that overlap become one
        far = np.maximum.accumulate(hi + q * len(flat))
        head = np.flatnonzero(np.r_[True, lo[1:] + q[1:] * len(flat) >= far[:-1]][: len(q)])
        hi = (far[np.r_[head[1:], len(q)] - 1] - q[head] * len(flat)) if len(q) else hi
        q, text, lo = q[head], text[head], lo[head]
        for n in np.unique(self.n[q]).tolist():
            of = np.flatnonzero(self.n[q] == n)
            if n >= 64:
                for i in of.tolist():
                    away = int(begin[text[i]])
                    rows = alike_windows(self.needles[q[i]], texts[text[i]][lo[i] - away : hi[i] - away], self.threshold)
                    if rows:
                        s, e, x = (np.array(c) for c in zip(*rows, strict=True))
                        yield np.full(len(rows), q[i]), np.full(len(rows), text[i]), s + lo[i] - away, e + lo[i] - away, x
                continue
            ends = np.cumsum(hi[of] - lo[of])
            for some in np.split(of, np.flatnonzero(np.diff(ends // BATCH_HITS)) + 1):
                size = hi[some] - lo[some]
                which = np.repeat(some, size)
                at = np.arange(len(which)) + np.repeat(lo[some] - (np.cumsum(size) - size), size)
                for s, m, x in windows_of(n, self.bits[q[which], flat[at]], hi[which] - at, self.threshold):
                    t = text[which[s]]
                    start = at[s] - begin[t]
                    yield q[which[s]], t, start, start + m, x


def _searched(texts: DataFrame, needles: pa.Table, threshold: float, schema: StructType) -> DataFrame:
    """fuzzy_occurrences() of needles that every task has: texts stay where they are, and long ones are searched a slice at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _Search(needles.column("needle").to_pylist(), threshold)

        def found(batch: pa.RecordBatch, slices: list[tuple[int, int, str]]) -> Iterator[pa.RecordBatch]:
            row, offset = np.array([x[0] for x in slices]), np.array([x[1] for x in slices])
            for q, t, start, end, x in search.occurrences([x[2] for x in slices]):
                own = start < BATCH_CHARS  # what starts later starts in the next slice
                q, t, start, end, x = q[own], t[own], start[own], end[own], x[own]
                columns = [needles.column("needle_id").take(pa.array(q)).combine_chunks(), batch.column(0).take(pa.array(row[t])), pa.array((start + offset[t]).astype(np.int32)), pa.array((end + offset[t]).astype(np.int32)), pa.array(x)]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

        for batch in batches:
            slices, held = [], 0
            for i, text in enumerate(batch.column(1).to_pylist()):
                for offset in range(0, len(text), BATCH_CHARS):
                    slices.append((i, offset, text[offset : offset + BATCH_CHARS + search.overlap]))
                    held += len(slices[-1][2])
                    if held >= BATCH_CHARS:
                        yield from found(batch, slices)
                        slices, held = [], 0
            if slices:
                yield from found(batch, slices)

    texts.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")  # texts may be long
    return texts.select("text_id", "text").where("text is not null").mapInArrow(run, schema)


def fuzzy_occurrences(needles: DataFrame, texts: DataFrame, threshold: float = 80.0) -> DataFrame:
    """needle_id, text_id, start, end, similarity of every window of every text that is alike a needle.

    needles has needle_id and needle, texts has text_id and text; ids are
    unique.  A window has the needle's length give or take a third, 2 at
    least, and an indel similarity of ``threshold`` (over 0) or more.  Whole
    texts are searched and all occurrences returned, overlapping ones too.
    Null and empty needles and texts have none.

    Up to MOST_NEEDLES needles go to every task, which searches its texts.
    More of them meet texts over pieces in an equi-join: the places where
    enough pieces of a needle lie about right form regions; texts are joined
    to the regions, and a region alone is compared.
    """
    if not threshold > 0:
        raise ValueError("the threshold must be over 0: else every window is alike")
    some = needles.select("needle_id", "needle").where(F.length("needle") > 0).limit(MOST_NEEDLES + 1).toArrow()
    if some.num_rows <= MOST_NEEDLES:
        schema = StructType().add("needle_id", needles.schema["needle_id"].dataType).add("text_id", texts.schema["text_id"].dataType)
        schema = schema.add("start", IntegerType()).add("end", IntegerType()).add("similarity", DoubleType())
        return _searched(texts, some, threshold, schema) if some.num_rows else texts.sparkSession.createDataFrame([], schema)
    pieces = _pieces(needles, threshold).cache()
    try:
        widths = sorted(r["width"] for r in pieces.select("width").distinct().collect())
        if not widths:
            return texts.select("text_id").limit(0).selectExpr("cast(null as bigint) as needle_id", "text_id", "0 as start", "0 as end", "0D as similarity")
        needed = sorted(r["needed"] for r in pieces.select("needed").distinct().collect())
        few = pieces.count() <= BROADCAST_ROWS
    finally:
        pieces.unpersist()
    near = lambda df: F.broadcast(df) if few else df
    met = _grams(texts.where("text is not null"), widths).join(near(pieces.drop("needle")), ["width", "piece"])
    # a piece says where the needle would begin; of an occurrence that begins at s, enough say so within edits of s
    begins = met.select("needle_id", "text_id", "needed", "edits", "most", (F.col("place") - F.col("at")).alias("begin"))
    by = Window.partitionBy("needle_id", "text_id").orderBy("begin")
    last = F.coalesce(*[F.when(F.col("needed") == k, F.lead("begin", k - 1).over(by)) for k in needed])
    dense = begins.withColumn("last", last).where(F.col("last") - F.col("begin") <= 2 * F.col("edits"))
    spans = dense.select("needle_id", "text_id", F.greatest(F.lit(0), F.col("last") - F.col("edits")).alias("lo"), (F.col("begin") + F.col("edits") + F.col("most")).alias("hi"))
    by = Window.partitionBy("needle_id", "text_id").orderBy("lo", "hi")
    before = F.max("hi").over(by.rowsBetween(Window.unboundedPreceding, -1))
    regions = spans.withColumn("new", F.when(F.col("lo") < before, 0).otherwise(1)).withColumn("region", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    regions = regions.groupBy("needle_id", "text_id", "region").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    regions = regions.join(near(needles.select("needle_id", "needle")), "needle_id")
    own = texts.select("text_id", "text").join(regions, "text_id").select("needle_id", "text_id", "needle", "lo", F.substring(F.col("text"), F.col("lo") + 1, F.col("hi") - F.col("lo")).alias("stretch"))
    found = own.withColumn("w", F.explode(alike(F.col("needle"), F.col("stretch"), threshold)))
    return found.select("needle_id", "text_id", (F.col("lo") + F.col("w.start")).alias("start"), (F.col("lo") + F.col("w.end")).alias("end"), F.col("w.similarity").alias("similarity"))
