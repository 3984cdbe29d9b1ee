"""Sequence operators over time-ordered segments; order-dependent ones run per recording."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .folds import MERGE_GAP, MERGE_LENGTH, parted, stretches, whole_keys

#: Limits in milliseconds.
SHORT, WINDOW_TARGET, WINDOW_MOST, WINDOW_OVERLAP = 2_000, 30_000, 80_000, 500


def _sandwiched(key: np.ndarray, start: np.ndarray, end: np.ndarray, who: np.ndarray, short: int, gap: int) -> np.ndarray:
    """Places of short segments between two near ones of one other cluster; of several in a row every second, from the first on.

    Giving a segment to its neighbours makes it one of them, so that the next
    one, which then follows its own cluster, stands between two others no more.
    """
    n = len(start)
    if n < 3:
        return np.zeros(0, int)
    near = (start[1:] - end[:-1] <= gap) & (key[1:] == key[:-1])
    fits = np.zeros(n, bool)
    fits[1:-1] = (who[:-2] == who[2:]) & (who[1:-1] != who[2:]) & (end[1:-1] - start[1:-1] <= short) & near[:-1] & near[1:]
    place = np.arange(n)
    before = np.maximum.accumulate(np.where(fits, -1, place))
    return np.flatnonzero(fits & ((place - before) % 2 == 1))


def smooth(key: np.ndarray, start: np.ndarray, end: np.ndarray, who: np.ndarray, short: int = SHORT, gap: int = MERGE_GAP, length: int = MERGE_LENGTH) -> tuple[list[np.ndarray], np.ndarray]:
    """Segments joined and short ones between two of one other cluster given to it, until none is given; and the keys of those given.

    The rows of many keys lie behind each other, in order; a key's neighbours
    are its own only, so all keys go through the rounds together.
    """
    line, given_keys = [key, start, end, who.copy()], []
    while True:
        key, start, end, who = line
        first, last = stretches(parted(key, start, end, who, gap), start, end, length)
        line = [key[first], start[first], end[last], who[first]]
        given = _sandwiched(*line, short, gap)
        if not len(given):
            return line, np.concatenate(given_keys) if given_keys else key[:0]
        given_keys.append(line[0][given])
        line[3][given] = line[3][given - 1]


def smooth_segments(segments: DataFrame, **limits) -> DataFrame:
    """recording_id, start_ms, end_ms, cluster, absorbed of the smoothed segments of each recording; many recordings at a time."""

    def run(batches):
        for columns, _ in whole_keys(batches):
            (key, start, end, who), given = smooth(*columns, **limits)
            names, count = np.unique(given, return_counts=True)
            absorbed = np.zeros(len(key), np.int64)
            if len(names):
                at = np.minimum(np.searchsorted(names, key), len(names) - 1)
                absorbed = np.where(names[at] == key, count[at], 0)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, start, end, who, absorbed)], ["recording_id", "start_ms", "end_ms", "cluster", "absorbed"])

    rows = segments.select("recording_id", "start_ms", "end_ms", "cluster").repartition("recording_id").sortWithinPartitions("recording_id", "start_ms", "end_ms")
    return rows.mapInArrow(run, "recording_id long, start_ms long, end_ms long, cluster long, absorbed long")


def per_group(rows: DataFrame, order: list[str], run, schema: str) -> DataFrame:
    """run(key, columns of one key in order) -> list of tuples, for each value of the first column; many small groups share one batch."""
    key, names = rows.columns[0], [c.split()[0] for c in schema.split(", ")]

    def stream(batches):
        for columns, begin in whole_keys(batches):
            out = []
            for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(columns[0])], strict=True):
                out += run(columns[0][a], [c[a:b] for c in columns[1:]])
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=names), preserve_index=False)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(stream, schema)


def windows(rows: list[tuple[int, int]], target: int = WINDOW_TARGET, most: int = WINDOW_MOST, overlap: int = WINDOW_OVERLAP) -> list[tuple[int, int, int, int, int]]:
    """(input start, input end, core start, core end, segments seen at the core's end) of speech windows.

    Cores follow each other without gaps from the first segment's start.  A
    core ends with the segment that brings it to the target length; a segment
    that would make it longer than ``most`` is first brought nearer by as many
    cores of exactly the target as that takes.  Windows reach over their cores
    by the overlap.
    """
    target, overlap = max(1, target), max(0, overlap)
    most, edges, seen, reach, n = max(target, most), [], [], 0, 0
    for n, (start, end) in enumerate(sorted(r for r in rows if r[0] < r[1])):
        if not edges:
            edges, reach = [start], start
        forced = max(0, -((most - (end - edges[-1])) // target))
        edges += [edges[-1] + target * i for i in range(1, forced + 1)]
        seen += [n] * forced
        reach = max(reach, end)
        if reach >= edges[-1] + target:
            edges.append(reach)
            seen.append(n + 1)
    if edges and reach > edges[-1]:
        edges.append(reach)
        seen.append(n + 1)
    return [(max(0, a - overlap), b + overlap, a, b, k) for a, b, k in zip(edges, edges[1:], seen, strict=False)]


def speech_windows(segments: DataFrame, **limits) -> DataFrame:
    """recording_id, window_index, the bounds of each recording's windows, and segments: the ordinals of those in its core.

    A segment is in the cores it meets, but a core that is cut before a long
    segment does not have that one.  ordinal, if segments have none, is the
    place in order of start and end.
    """

    def run(key: int, columns: list[np.ndarray]) -> list[tuple]:
        start, end, ordinal = (c[columns[1] > columns[0]] for c in columns)
        out, first = [], 0
        latest = np.maximum.accumulate(end) if len(end) else end
        for i, (a, b, c, d, seen) in enumerate(windows(list(zip(start.tolist(), end.tolist(), strict=True)), **limits)):
            first = first + int(np.searchsorted(latest[first:], c, "right"))  # all before have ended
            inside = first + np.flatnonzero((end[first:seen] > c) & (start[first:seen] < d))
            out.append((key, i, a, b, c, d, ordinal[inside].tolist()))
        return out

    schema = "recording_id long, window_index long, input_start_ms long, input_end_ms long, core_start_ms long, core_end_ms long, segments array<long>"
    ordinal = F.col("ordinal") if "ordinal" in segments.columns else F.row_number().over(Window.partitionBy("recording_id").orderBy("start_ms", "end_ms"))
    return per_group(segments.select("recording_id", "start_ms", "end_ms", ordinal.cast("long").alias("ordinal")), ["start_ms", "end_ms"], run, schema)


class Chunks:
    """Chunks of whole sentences of one recording's utterances, which come in order.

    A chunk closes where the section changes, and before its search text (topic,
    terms and context, then the speakers' lines) would have too many tokens, or
    it too much time or too many utterances.  Only the open chunk is held.
    """

    def __init__(self, count_tokens, most_tokens: int = 800, most_ms: int = 180_000, most_utterances: int = 30):
        self.count, self.most = count_tokens, (most_tokens, most_ms, most_utterances)
        self.held: list[tuple[dict, str]] = []

    @staticmethod
    def lines(pieces: list[tuple[dict, str]]) -> str:
        lines: dict[int, list[str]] = {}
        for u, s in pieces:
            lines.setdefault(u["utterance_index"], [u["label"], ""])[1] += s
        return "\n".join(f"{label}: {t.strip()}" for label, t in lines.values())

    @staticmethod
    def terms(u: dict) -> list[str]:
        terms = u.get("terms")
        return list(dict.fromkeys(t.strip() for t in (terms if terms is not None else []) if t.strip()))

    def search_text(self, pieces: list[tuple[dict, str]]) -> str:
        u = pieces[0][0]
        head = [(u.get("topic") or "").strip(), " ".join(self.terms(u)), (u.get("search_context") or "").strip()]
        return "\n".join([*filter(None, head), self.lines(pieces)])

    def _full(self, piece: tuple[dict, str]) -> bool:
        tokens, ms, utterances = self.most
        more = [*self.held, piece]
        return piece[0]["end_ms"] - self.held[0][0]["start_ms"] > ms or len({u["utterance_index"] for u, _ in more}) > utterances or self.count(self.search_text(more)) > tokens

    def close(self) -> list[dict]:
        if not self.held:
            return []
        first, own = self.held[0][0], list(dict.fromkeys(u["utterance_index"] for u, _ in self.held))
        out = {
            "text": self.lines(self.held), "search_text": self.search_text(self.held), "start_ms": first["start_ms"], "end_ms": self.held[-1][0]["end_ms"],
            "utterances": own, "section": first.get("section"), "topic": (first.get("topic") or "").strip() or None, "terms": self.terms(first),
        }
        self.held = []
        return [out]

    def add(self, u: dict) -> list[dict]:
        out = self.close() if self.held and self.held[0][0].get("section") != u.get("section") else []
        for piece in _SENTENCE_END.split(u["text"] or ""):
            if piece.strip():
                if self.held and self._full((u, piece)):
                    out += self.close()
                self.held.append((u, piece))
        return out


_SENTENCE_END = re.compile(r"(?<=。)|(?<=(?<![0-9])\.)|(?<=\.)(?![0-9])")


def bounded_chunks(utterances: list[dict], count_tokens, **limits) -> list[dict]:
    """The chunks of one recording's utterances."""
    chunks = Chunks(count_tokens, **limits)
    out = [c for u in utterances for c in chunks.add(u)]
    return out + chunks.close()


def estimated_tokens(text: str) -> int:
    cjk = sum("㐀" <= c <= "鿿" or "豈" <= c <= "﫿" for c in text)
    other = sum(len(c.encode()) for c in text if not ("㐀" <= c <= "鿿" or "豈" <= c <= "﫿"))
    return cjk + -(-other // 4)


def search_chunks(utterances: DataFrame, sections: DataFrame | None = None, **limits) -> DataFrame:
    """recording_id, chunk_index, text, search_text, start_ms, end_ms, utterances, section, topic, terms of each recording's chunks.

    sections has recording_id, section, first_index, last_index, topic, terms
    (array) and search_context; they do not overlap, and utterances outside of
    all are left out.  Without sections a recording is one.  Rows stream past
    in order; a task holds the open chunk, however long the recording.
    """
    names = ["recording_id", "utterance_index", "label", "text", "start_ms", "end_ms"]
    rows = utterances.select("recording_id", "utterance_index", F.col("cluster").alias("label"), "text", "start_ms", "end_ms")
    if sections is None:
        rows = rows.select(*names, F.lit(None).cast("long").alias("section"), F.lit(None).cast("string").alias("topic"), F.array().cast("array<string>").alias("terms"), F.lit(None).cast("string").alias("search_context"))
    else:
        own = sections.select(F.col("recording_id").alias("__r"), "section", "first_index", "last_index", "topic", "terms", "search_context")
        rows = rows.join(own, (F.col("recording_id") == F.col("__r")) & F.col("utterance_index").between(F.col("first_index"), F.col("last_index"))).select(*names, F.col("section").cast("long").alias("section"), "topic", "terms", "search_context")
    keys = ["chunk_index", "text", "search_text", "start_ms", "end_ms", "utterances", "section", "topic", "terms"]
    kinds = ["long", "string", "string", "long", "long", "array<long>", "long", "string", "array<string>"]
    arrow = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}

    def table(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], arrow[k]) for c, k in zip(["recording_id", *keys], ["long", *kinds], strict=True)], ["recording_id", *keys])

    def run(batches):
        chunks, key, n = Chunks(estimated_tokens, **limits), None, 0

        def named(found: list[dict]) -> list[dict]:
            nonlocal n
            n += len(found)
            return [c | {"recording_id": key, "chunk_index": n - len(found) + i} for i, c in enumerate(found)]

        for batch in batches:
            out, columns = [], batch.schema.names
            for values in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if values[0] != key:
                    out += named(chunks.close())
                    key, n = values[0], 0
                out += named(chunks.add(dict(zip(columns, values, strict=True))))
            yield table(out)
        yield table(named(chunks.close()))

    schema = ", ".join(["recording_id long", *[f"{c} {k}" for c, k in zip(keys, kinds, strict=True)]])
    return rows.repartition("recording_id").sortWithinPartitions("recording_id", "utterance_index").mapInArrow(run, schema)


#: Fixed value: the longest stretch whose level is measured at once, in milliseconds.
ANALYSIS_MS = 2_000


def lone_windows(segments: DataFrame, most: int = ANALYSIS_MS, key: str = "recording_id", name: str = "ordinal") -> DataFrame:
    """key, name, window (from 0), start_ms, end_ms: segments that no other of their key overlaps, in stretches of ``most`` at most.

    In order of start, a segment overlaps another if one before it ends after
    its start or the next begins before its end; so two neighbours say it, and
    no pairs are made.  Segments without duration are left out.
    """
    by = Window.partitionBy(key).orderBy("start_ms", "end_ms", name)
    rows = segments.where("end_ms > start_ms").select(key, name, "start_ms", "end_ms")
    reach, following = F.max("end_ms").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lead("start_ms").over(by)
    alone = rows.withColumn("__reach", reach).withColumn("__next", following).where("coalesce(__reach <= start_ms, true) and coalesce(__next >= end_ms, true)")
    cut = alone.select(key, name, "end_ms", F.posexplode(F.sequence(F.col("start_ms"), F.col("end_ms") - 1, F.lit(most).cast("long"))).alias("window", "start_ms"))
    return cut.select(key, name, F.col("window").cast("long").alias("window"), "start_ms", F.least(F.col("end_ms"), F.col("start_ms") + most).alias("end_ms"))


def topological_order(parents: dict[str, set[str]]) -> list[str]:
    """Nodes by levels, by name within a level; ValueError for a cycle or an unknown parent."""
    left, done, out = dict(parents), set(), []
    while left:
        ready = sorted(n for n, p in left.items() if p <= done)
        if not ready:
            raise ValueError("cycle or unknown parent among " + ", ".join(sorted(left)))
        out += ready
        done |= set(ready)
        for n in ready:
            del left[n]
    return out


def pick_apart(rows: list[tuple[int, int, float, str]]) -> list[tuple[int, int, float, str]]:
    """Best interval of each group by score, then greedily those that do not overlap a better one; (start, end, score, group)."""
    best: dict[str, tuple[int, int, float, str]] = {}
    for r in rows:
        if r[3] not in best or (r[2], -r[0]) > (best[r[3]][2], -best[r[3]][0]):
            best[r[3]] = r
    out: list[tuple[int, int, float, str]] = []
    for r in sorted(best.values(), key=lambda r: (-r[2], r[0], r[3])):
        if all(r[1] <= o[0] or o[1] <= r[0] for o in out):
            out.append(r)
    return sorted(out)
