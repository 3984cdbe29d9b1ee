"""Order-dependent folds over sorted streams: what a task holds is the open row of a key, however long the key is."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits of merged segments in milliseconds; of rolling summaries in milliseconds and characters.
MERGE_GAP, MERGE_LENGTH = 3_000, 80_000
ROLLING_MS, ROLLING_CHARS, ROLLING_FLOOR, ROLLING_RESERVE = 1_800_000, 24_000, 3_000, 1_800


def first_beyond(values: np.ndarray, at: int, stop: int, limit: float) -> int:
    """The first place of at..stop whose value is beyond the limit, else stop; looked for in steps that double, so the work follows what is passed."""
    step = 16
    while at < stop:
        over = np.flatnonzero(values[at : min(stop, at + step)] > limit)
        if len(over):
            return at + int(over[0])
        at, step = at + step, 2 * step
    return stop


def stretches(parted: np.ndarray, start: np.ndarray, end: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last row of the greatest stretches that no parting cuts and that last ``length`` at most, from the left."""
    cuts = np.r_[np.flatnonzero(parted), len(start)]
    first, last = [], []
    for at, stop in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        while at < stop:
            cut = first_beyond(end, at + 1, stop, start[at] + length)
            first.append(at)
            last.append(cut - 1)
            at = cut
    return np.array(first, np.int64), np.array(last, np.int64)


def parted(key: np.ndarray, start: np.ndarray, end: np.ndarray, who: np.ndarray, gap: int) -> np.ndarray:
    """Whether each row stands apart from the one before: another key, another cluster, or too wide a gap."""
    out = np.ones(len(key), bool)
    out[1:] = (key[1:] != key[:-1]) | (who[1:] != who[:-1]) | (start[1:] - end[:-1] > gap)
    return out


def _streamed(rows: DataFrame, key: str, order: list, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def _numpy(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


def merge_adjacent(segments: DataFrame, key: str = "recording_id", gap: int = MERGE_GAP, length: int = MERGE_LENGTH) -> DataFrame:
    """Neighbours of one cluster merge while the gap and the whole length allow; rows of (key, start_ms, end_ms, cluster).

    Rows stream past in order of start, end and cluster; merged rows leave as
    soon as they are closed, and the open one waits for the next batch.  A null
    cluster merges with nothing.
    """
    schema = f"{key} {segments.schema[key].dataType.simpleString()}, start_ms long, end_ms long, cluster {segments.schema['cluster'].dataType.simpleString()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types, held = None, None, None
        for batch in batches:
            names, types = batch.schema.names, batch.schema.types
            rows = _numpy(batch)
            if held:
                rows = [np.r_[h, x] for h, x in zip(held, rows, strict=True)]
            if not len(rows[0]):
                continue
            k, s, e, w = rows
            first, last = stretches(parted(k, s, e, w, gap), s, e, length)
            whole = [k[first], s[first], e[last], w[first]]
            held = [x[-1:] for x in whole]
            yield _batch([x[:-1] for x in whole], names, types)
        if held:
            yield _batch(held, names, types)

    rows = segments.select(key, F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"), "cluster")
    return _streamed(rows, key, ["start_ms", "end_ms", "cluster"], run, schema)


def _batch(columns: list[np.ndarray], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t, from_pandas=True) for c, t in zip(columns, types, strict=True)], names)


def budget_batches(rows: DataFrame, key: str, order: str, size: str, budget: int) -> DataFrame:
    """(key, batch, rows, total) of batches in order that start anew where a row would overflow the budget; a larger row is alone."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, open_ = [key, "batch", "rows", "total"], None  # key, batch, rows, total of the open batch
        types = None
        for batch in batches:
            types = [batch.schema.types[0], pa.int64(), pa.int64(), pa.int64()]
            k, n = _numpy(batch)
            out = []
            edges = np.r_[np.flatnonzero(np.r_[True, k[1:] != k[:-1]]), len(k)] if len(k) else np.zeros(1, np.int64)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if open_ and open_[0] != k[a]:
                    out.append(open_)
                    open_ = None
                through = np.r_[0, np.cumsum(n[a:b])]
                at = 0
                while at < b - a:
                    held = open_[3] if open_ else 0
                    cut = int(np.searchsorted(through, through[at] + budget - held, "right")) - 1 if budget >= held else at
                    if open_ and cut <= at:
                        out.append(open_)
                        open_ = (open_[0], open_[1] + 1, 0, 0)
                        held = 0
                        cut = int(np.searchsorted(through, through[at] + budget, "right")) - 1
                    cut = max(cut, at + 1)
                    number, count, total = (open_[1], open_[2], held) if open_ else (0, 0, 0)
                    open_ = (k[a], number, count + cut - at, total + int(through[cut] - through[at]))
                    at = cut
            yield _batch([np.array([r[i] for r in out], object) for i in range(4)], names, types)
        if open_:
            yield _batch([np.array([x], object) for x in open_], names, types)

    chosen = rows.select(key, F.col(order).alias("__o"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("__n"))
    ordered = chosen.repartition(key).sortWithinPartitions(key, "__o").select(key, "__n")
    return ordered.mapInArrow(run, f"{key} {kind}, batch long, rows long, total long")


def rolling_budget(context: int, answer: int, memory: int, most: int = ROLLING_CHARS, floor: int = ROLLING_FLOOR, reserve: int = ROLLING_RESERVE) -> int:
    """Characters of a chunk: at most ``most``, and what the model's context leaves beside answer, memory and reserve, but not less than the floor."""
    return min(most, max(floor, context - answer - memory - reserve))


def rolling_chunks(utterances: DataFrame, size: Column, most_chars: int, most_ms: int = ROLLING_MS, key: str = "recording_id", order: str = "utterance_index") -> DataFrame:
    """key, chunk_index (from 1), start_ms, end_ms, utterances, chars of the inputs of a rolling summary.

    A chunk closes before an utterance that would end later than ``most_ms``
    after the chunk's start, or make it longer than ``most_chars``; a longer
    utterance is alone.  end_ms is that of the chunk's last utterance.  One
    pass over the utterances in order; the open chunk is all that is held.
    """
    kind = utterances.schema[key].dataType.simpleString()
    names = [key, "chunk_index", "start_ms", "end_ms", "utterances", "chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, open_ = None, None
        for batch in batches:
            types = [batch.schema.types[0], *[pa.int64()] * 5]
            k, s, e, n = _numpy(batch)
            out, at = [], 0
            while at < len(k):
                if open_ and open_[0] != k[at]:
                    out.append(open_)
                    open_ = None
                same = first_beyond((k[at:] != k[at]).astype(np.int8), 0, len(k) - at, 0) + at
                if open_ is None:
                    open_ = (k[at], 1, int(s[at]), int(s[at]), 0, 0)
                begin = open_[2]
                late = first_beyond(e, at, same, begin + most_ms)
                through = np.cumsum(n[at:late])
                cut = at + int(np.searchsorted(through, most_chars - open_[5], "right"))
                if open_[4] == 0:
                    cut = max(cut, at + 1)  # the first one is taken whatever it is
                if cut > at:
                    open_ = (*open_[:3], int(e[cut - 1]), open_[4] + cut - at, open_[5] + int(n[at:cut].sum()))
                if cut < same:
                    out.append(open_)
                    open_ = (k[cut], open_[1] + 1, int(s[cut]), int(s[cut]), 0, 0)
                at = cut
            yield _batch([np.array([r[i] for r in out], object) for i in range(6)], names, types)
        if open_:
            yield _batch([np.array([x], object) for x in open_], names, types)

    rows = utterances.select(key, F.col(order).alias("__o"), F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"), size.cast("long").alias("__n"))
    ordered = rows.repartition(key).sortWithinPartitions(key, "__o").drop("__o")
    return ordered.mapInArrow(run, f"{key} {kind}, chunk_index long, start_ms long, end_ms long, utterances long, chars long")


def whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """(columns, where each key begins) of many whole keys at a time, from a stream sorted by its first column.

    The last key of a batch waits for the next; so a task holds a batch and
    one key.
    """
    held: list[list[np.ndarray]] = []

    def out(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        k = columns[0]
        return columns, np.flatnonzero(np.r_[True, k[1:] != k[:-1]])

    for batch in batches:
        columns = _numpy(batch)
        k = columns[0]
        if not len(k):
            continue
        if held and k[0] == k[-1] == held[0][0][0]:
            held.append(columns)
            continue
        last = int(np.flatnonzero(k != k[-1])[-1]) + 1 if k[0] != k[-1] else 0
        done = [[c[:last] for c in columns]]
        if held:
            done = [*held, *done]
        held = [[c[last:] for c in columns]]
        joined = [np.concatenate(x) for x in zip(*done, strict=True)]
        if len(joined[0]):
            yield out(joined)
    if held:
        yield out([np.concatenate(x) for x in zip(*held, strict=True)])
