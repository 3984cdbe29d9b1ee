"""Repeated byte strings across documents, by run-length compressed Burrows-Wheeler indexes.

Every string of WINDOW bytes belongs to the cell of its minimizer, the least
hash among its GRAM-byte grams, so equal strings meet in one cell wherever
they stand.  Cells whose minimizer occurs in one document only cannot hold a
repeat.  The stretches of text in the other cells are collected.  Each task
ranks its cells' different stretches by document and builds run-length indexes
(the runs of the transform, with text positions sampled at both ends of each
run) of the stretches of smaller documents.  Those of larger documents are
streamed through them from their ends, carrying length and place of the
longest match; strings whose matching length reaches WINDOW are marked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, discard, small_batches, written
from .exact_dedup import duplicate_groups

WINDOW = 50
#: Matching lengths are told apart up to here, in whole words of eight bytes.
REACH = 56
GRAM = 28
#: Grams of this length split the stretches of cells that very many documents share.
HOT_GRAM = 40
#: Places of one minimizer in one task from which its cell is split.
HOT_PLACES = 20_000
#: Entries that a task packs at once, or so many for each part: blocks, each with costs of its own, then grow with the input and not with its square (up to MOST_PLACES).
HELD_PLACES, HELD_A_PART = 400_000, 1_500
HELD_STRETCHES, STRETCHES_A_PART = 50_000, 150
#: What a task holds at most, so that its memory has a bound; beyond, blocks become smaller.
MOST_PLACES, MOST_STRETCHES = 3_000_000, 300_000
#: Windows of one stretch at most.
LONGEST = 128
#: Bytes indexed and streamed at once.
INDEX_BYTES = 1 << 20
BATCH_BYTES = 1 << 17
#: Ranges of removed bytes reach the documents as a broadcast up to this size, and by a join beyond.
BROADCAST_BYTES = 48 << 20
SEPARATOR = 255  # not a byte of UTF-8

U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def minimizers(flat: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> np.ndarray:
    """For each window of bytes the least hash of its grams; doubling steps make hashes and minima."""
    if len(flat) < window:
        return np.zeros(0, U)
    levels, size, h, m = {1: flat.astype(U) + U(1)}, 1, None, 0x9E3779B97F4A7C15
    h = levels[1]
    while size * 2 <= gram:
        h = h[:-size] * U(m) + h[size:]
        h ^= h >> U(29)
        size *= 2
        m = (m * m * 3) & 0xFFFFFFFFFFFFFFFF
        levels[size] = h
    done, rest = size, gram - size
    for s in sorted(levels, reverse=True):
        while rest >= s:
            n = len(flat) - done - s + 1
            h = h[:n] * U(0xD6E8FEB86659FD93) + levels[s][done : done + n]
            done, rest = done + s, rest - s
    h = _mix(h)
    width, size = window - gram + 1, 1
    while size * 2 <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (width - size)], h[width - size :]) if size < width else h


def stretches(flat: np.ndarray, begin: np.ndarray, hot: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(document, first window, last window, minimizer, second minimizer) of the runs of windows in one cell.

    Windows never cross documents; runs end after LONGEST windows.  Only runs
    in hot cells are cut by the second minimizer too.
    """
    least = minimizers(flat)
    n = len(least)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, U), np.zeros(0, U)
    change = np.r_[True, least[1:] != least[:-1]]
    if hot is not None and len(hot):
        finer = minimizers(flat, HOT_GRAM)
        change[1:] |= (finer[1:] != finer[:-1]) & np.isin(least[1:], hot)
    else:
        finer = np.zeros(n, U)
    heads = begin[:-1][begin[:-1] < n]
    change[heads] = True
    at = np.flatnonzero(change)
    end = np.r_[at[1:], n]
    long = end - at > LONGEST
    if long.any():
        more = np.concatenate([np.arange(a, b, LONGEST) for a, b in zip(at[long].tolist(), end[long].tolist(), strict=True)])
        at = np.union1d(at, more)
        end = np.r_[at[1:], n]
    doc = np.searchsorted(begin, at, side="right") - 1
    last = np.minimum(end - 1, begin[doc + 1] - WINDOW)
    ok = at <= last
    at, last, doc = at[ok], last[ok], doc[ok]
    return doc, at, last, least[at], finer[at]


class RunLengthIndex:
    """A run-length compressed transform of strings in groups; a match stays in one group.

    Each string is cyclic and ends in a separator of its own, and the group is
    part of every symbol.  Kept are the transform's runs (first row, symbol,
    the row that the first row steps to), the text positions sampled at the
    first and last row of each run, and the text, eight bytes at a time, in
    which two samples are compared.  The suffix array is used for building only.
    """

    def __init__(self, strings: list[bytes], groups: np.ndarray):
        text = np.frombuffer(b"\xff".join(strings) + b"\xff", np.uint8)
        sizes = np.array([len(s) + 1 for s in strings], np.int64)
        ends = np.cumsum(sizes) - 1
        owner = np.repeat(np.arange(len(strings)), sizes)
        group = groups[owner]
        order, self.words = _suffixes(text, owner, ends, group)
        whose = owner[order]
        before = np.where(order == ends[whose] - sizes[whose] + 1, ends[whose], order - 1)
        symbol = (group[before] << 8) | text[before]
        self.start = np.flatnonzero(np.r_[True, symbol[1:] != symbol[:-1]])
        self.symbol = symbol[self.start]
        size = np.diff(np.r_[self.start, len(text)])
        self.end = self.start + size - 1
        self.first, self.last = order[self.start], order[self.end]
        self.by_symbol = np.argsort(self.symbol, kind="stable")
        self.step = np.empty(len(size), np.int64)
        self.step[self.by_symbol] = np.cumsum(size[self.by_symbol]) - size[self.by_symbol]
        self.place = self.symbol[self.by_symbol] * len(size) + self.by_symbol

    def agreeing(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many bytes agree from two text positions on, counted up to most, which is REACH at most."""
        out, alive = np.minimum(most, REACH), np.arange(len(a))
        for offset in range(0, REACH, 8):
            alive = alive[out[alive] > offset]
            if not len(alive):
                break
            differ = self.words[a[alive] + offset] ^ self.words[b[alive] + offset]
            high = differ >> U(32)
            # the exponent of a 32-bit half tells its bits, and these the whole bytes in front that agree
            bits = np.frexp(np.where(high > 0, high, differ).astype(np.float64))[1] + np.where(high > 0, 32, 0)
            ends = np.flatnonzero(differ)
            out[alive[ends]] = np.minimum(out[alive[ends]], offset + (64 - bits[ends]) // 8)
            alive = alive[differ == 0]
        return out

    def statistics(self, strings: list[bytes], groups: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(string, position, matching length, text position of the match), from the strings' ends on.

        A step by the byte in front goes on inside a run of that byte.  Where
        the row is in another run, the nearest run of the byte above (its last
        row) or below (its first row) takes over, whichever sample agrees with
        the match so far for longer.  Lengths are exact up to REACH and at
        least REACH beyond.  Every group must be one of the index's.
        """
        flat = np.frombuffer(b"".join(strings), np.uint8)
        lengths = np.array([len(s) for s in strings], np.int64)
        stop, runs = np.cumsum(lengths), len(self.start)
        home = np.searchsorted(self.symbol >> 8, groups)
        active, done = np.arange(len(strings)), 0
        row, sample, length = self.start[home], self.first[home], np.zeros(len(strings), np.int64)
        while True:
            done += 1
            on = lengths[active] >= done
            if not on.all():
                active, row, sample, length = active[on], row[on], sample[on], length[on]
            if not len(active):
                return
            symbol = (groups[active] << 8) | flat[stop[active] - done]
            run = np.searchsorted(self.start, row, side="right") - 1
            off = np.flatnonzero(self.symbol[run] != symbol)
            if len(off):
                wanted = symbol[off]
                k = np.searchsorted(self.place, wanted * runs + run[off])
                above, below = self.by_symbol[np.maximum(k - 1, 0)], self.by_symbol[np.minimum(k, runs - 1)]
                up = (k > 0) & (self.symbol[above] == wanted)
                down = (k < runs) & (self.symbol[below] == wanted)
                two = self.agreeing(np.tile(sample[off], 2), np.r_[self.last[above], self.first[below]], np.tile(length[off], 2))
                longer, other = np.where(up, two[: len(off)], -1), np.where(down, two[len(off) :], -1)
                lower = other > longer
                run[off] = np.where(lower, below, above)
                row[off] = np.where(lower, self.start[below], self.end[above])
                sample[off] = np.where(lower, self.first[below], self.last[above])
                length[off] = np.maximum(longer, other)
            row, sample, length = self.step[run] + row - self.start[run], sample - 1, length + 1
            lost = np.flatnonzero(length == 0)  # the byte is not in the group at all
            row[lost], sample[lost] = self.start[home[active[lost]]], self.first[home[active[lost]]]
            yield active, lengths[active] - done, length, sample


def earlier(strings: list[bytes], cells: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(string, window), once each, of the windows that also start in a string of the cell and a smaller document.

    A cell's documents are ranked.  At each level, strings whose rank has that
    bit are streamed through an index of those without it whose higher bits
    are the same, so any two documents meet at one level, the smaller one in
    the index.  The highest bit comes first, and a string all of whose windows
    are found goes no further: a window's smallest document never finds it and
    so stays, for all others to meet.  Groups of all cells share indexes of
    about INDEX_BYTES.
    """
    order = np.lexsort((docs, cells))
    cell, doc = cells[order], docs[order]
    head = np.r_[True, cell[1:] != cell[:-1]]
    number = np.cumsum(head | np.r_[True, doc[1:] != doc[:-1]]) - 1
    rank = number - np.maximum.accumulate(np.where(head, number, 0))
    lengths = np.array([len(s) for s in strings], np.int64)
    windows = np.maximum(0, lengths - WINDOW + 1)
    begin = np.r_[0, np.cumsum(windows)]
    found = np.zeros(begin[-1], bool)
    cell, lengths = np.cumsum(head) - 1, lengths[order]
    own = np.flatnonzero(windows[order] > 0)

    def solve(members: np.ndarray, groups: np.ndarray, asks: np.ndarray) -> None:
        index = RunLengthIndex([strings[i] for i in order[members[~asks]].tolist()], groups[~asks])
        asking = order[members[asks]]
        for which, window, length, _ in index.statistics([strings[i] for i in asking.tolist()], groups[asks]):
            long = length >= WINDOW
            found[begin[asking[which[long]]] + window[long]] = True

    for level in reversed(range(int(rank.max(initial=0)).bit_length())):
        if not len(own):
            break
        upper, asks = rank[own] >> (level + 1), (rank[own] >> level) & 1 == 1
        group = np.cumsum(np.r_[True, (cell[own[1:]] != cell[own[:-1]]) | (upper[1:] != upper[:-1])]) - 1
        both = np.bincount(group[asks], minlength=group[-1] + 1) * np.bincount(group[~asks], minlength=group[-1] + 1) > 0
        used = both[group]
        if not used.any():
            continue
        members, asks, group = own[used], asks[used], group[used]
        number = np.cumsum(np.r_[True, np.diff(group) != 0]) - 1
        edge = np.searchsorted(number, np.arange(number[-1] + 2))
        ends = np.cumsum(lengths[members])[edge[1:] - 1]
        first = 0
        while first <= number[-1]:  # whole groups at a time
            done = ends[first - 1] if first else 0
            stop = max(first + 1, int(np.searchsorted(ends, done + INDEX_BYTES, side="right")))
            take = slice(edge[first], edge[stop])
            solve(members[take], number[take] - first, asks[take])
            first = stop
        some = np.r_[0, np.cumsum(found, dtype=np.int32)]
        own = own[(some[begin[1:]] - some[begin[:-1]] < windows)[order[own]]]
    at = np.flatnonzero(found)
    string = np.searchsorted(begin, at, side="right") - 1
    return string, at - begin[string]


def _suffixes(text: np.ndarray, owner: np.ndarray, ends: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by group and text up to the string's end, and the eight bytes at each position; doubling, on rows still tied."""
    n = len(text)
    words = np.zeros(n + REACH + 8, U)
    words[:n] = text
    for shift in (1, 2, 4):
        words[:-shift] = (words[:-shift] << U(8 * shift)) | words[shift:]
    left = ends[owner] - np.arange(n) + 1
    past = (U(8) - np.minimum(left, 8).astype(U)) * U(8)
    words[:n] = words[:n] >> past << past
    first = (group.astype(U) << U(40)) | (words[:n] >> U(24))  # five bytes behind the group, of which an index has fewer than 2^24
    order = np.argsort(first)
    new = np.r_[True, first[order[1:]] != first[order[:-1]]]
    rank = np.zeros(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    tied = np.flatnonzero(~(new & np.r_[new[1:], True]))
    h = 5
    while len(tied):
        own = order[tied]
        # suffixes that are tied end together, and then their strings' numbers decide
        pair = (rank[own] << 32) | np.where(left[own] <= h, owner[own], rank[np.minimum(own + h, n - 1)])
        way = np.argsort(pair)
        own, pair = own[way], pair[way]
        order[tied] = own
        new = np.r_[True, pair[1:] != pair[:-1]]
        rank[own] = np.maximum.accumulate(np.where(new, tied, 0))
        tied = tied[~(new & np.r_[new[1:], True])]
        h *= 2
    return order, words


NODE = np.dtype([("doc", "<i8"), ("text", "<i8")])


def _batches(ids: list, texts: list, hashes: list) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(nodes, flat bytes, begins) of some documents at a time."""
    part, nodes, held = [], [], 0
    for i, t, h in zip(ids, texts, hashes, strict=True):
        raw = t.encode() if isinstance(t, str) else (t or b"")
        part.append(raw)
        nodes.append((i, h))
        held += len(raw)
        if held >= BATCH_BYTES:
            yield np.array(nodes, NODE), np.frombuffer(b"".join(part), np.uint8), np.r_[0, np.cumsum([len(x) for x in part])]
            part, nodes, held = [], [], 0
    if part:
        yield np.array(nodes, NODE), np.frombuffer(b"".join(part), np.uint8), np.r_[0, np.cumsum([len(x) for x in part])]


def _blocks(parts: np.ndarray, count: int, nodes: np.ndarray, of: np.ndarray, columns: list[np.ndarray], tail: list[bytes] | None = None) -> pa.RecordBatch:
    """Rows (part, block), a block for each part that has entries: nodes, how many entries each has, columns, and packed texts."""
    order = np.lexsort((of, parts))
    parts, of, columns = parts[order], of[order], [c[order] for c in columns]
    first = np.flatnonzero(np.r_[True, (parts[1:] != parts[:-1]) | (of[1:] != of[:-1])]) if len(of) else np.zeros(0, np.int64)
    used, times = nodes[of[first]], np.diff(np.r_[first, len(of)]).astype("<u4")
    at = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1]]) if len(of) else first
    ends, heads = np.r_[at[1:], len(of)], np.searchsorted(first, np.r_[at, len(of)])
    out, packer = [], zstandard.ZstdCompressor(level=1)
    for k, (x, y) in enumerate(zip(at.tolist(), ends.tolist(), strict=False)):
        own = slice(heads[k], heads[k + 1])
        block = [np.array([heads[k + 1] - heads[k], y - x], "<i8").tobytes(), used[own].tobytes(), times[own].tobytes()]
        block += [c[x:y].tobytes() for c in columns]
        if tail is not None:
            block.append(packer.compress(b"".join([tail[i] for i in order[x:y].tolist()])))
        out.append(b"".join(block))
    return pa.RecordBatch.from_arrays([pa.array(parts[at].astype(np.int32)), pa.array(out, pa.binary())], ["part", "block"])


def _opened(block: bytes, kinds: list[str]) -> tuple:
    """(nodes, node numbers, columns, where the rest begins)."""
    k, e = np.frombuffer(block, "<i8", 2).tolist()
    at = 16
    nodes = np.frombuffer(block, NODE, k, at)
    at += k * NODE.itemsize
    local = np.repeat(np.arange(k), np.frombuffer(block, "<u4", k, at))
    at += 4 * k
    columns = []
    for kind in kinds:
        columns.append(np.frombuffer(block, kind, e, at))
        at += columns[-1].nbytes
    return nodes, local, columns, at


def _places(docs: DataFrame, parts: int) -> DataFrame:
    """The minimizers of every document, once each, as blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            begin = np.cumsum([0] + [len(x[0]) for x in held])
            nodes = np.concatenate([x[0] for x in held])
            of = np.concatenate([x[1] + b for x, b in zip(held, begin, strict=False)])
            least = np.concatenate([x[2] for x in held])
            return _blocks((least >> U(40)).astype(np.int64) % parts, parts, nodes, of, [least])

        for batch in batches:
            for nodes, flat, begin in _batches(*[batch.column(i).to_pylist() for i in range(3)]):
                doc, _, _, least, _ = stretches(flat, begin)
                if not len(doc):
                    continue
                order = np.lexsort((least, doc))
                doc, least = doc[order], least[order]
                one = np.r_[True, (doc[1:] != doc[:-1]) | (least[1:] != least[:-1])]
                held.append((nodes, doc[one], least[one]))
                n += int(one.sum())
                if n >= max(HELD_PLACES, min(MOST_PLACES, HELD_A_PART * parts)):
                    yield out()
                    held, n = [], 0
        if held:
            yield out()

    return docs.mapInArrow(run, "part int, block binary")


def _shared(places: DataFrame, parts: int) -> DataFrame:
    """The minimizers that occur in two documents or more, as blocks dealt by document; the flag marks hot cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, hot, limit = [], 0, np.zeros(0, U), 3_000_000

        def solve(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, n, hot
            begin = np.cumsum([0] + [len(x[0]) for x in held])
            nodes = np.concatenate([x[0] for x in held])
            of = np.concatenate([x[1] + b for x, b in zip(held, begin, strict=False)])
            least = np.concatenate([x[2] for x in held])
            order = np.argsort(least, kind="stable")
            least, of = least[order], of[order]
            edge = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
            size = np.diff(np.r_[edge, len(least)])
            ids = nodes["doc"][of]
            known = np.isin(least[edge], hot)
            several = (np.minimum.reduceat(ids, edge) != np.maximum.reduceat(ids, edge)) | known
            large = (size >= HOT_PLACES) | known
            ready = several if last else several & large
            if not last:
                hot = np.union1d(hot, least[edge][ready])
                rest = ~np.repeat(ready, size)
                used, local = np.unique(of[rest], return_inverse=True)
                held, n = [(nodes[used], local, least[rest])], int(rest.sum())
            chosen = np.repeat(ready, size)
            if chosen.any():
                of, least, flag = of[chosen], least[chosen], np.repeat(large, size)[chosen].astype("u1")
                part = (_mix(nodes["doc"][of].astype(U)) >> U(40)).astype(np.int64) % parts
                yield _blocks(part, parts, nodes, of, [least, flag])

        for batch in batches:
            for block in batch.column(1).to_pylist():
                nodes, local, (least,), _ = _opened(block, ["<u8"])
                held.append((nodes, local, least))
                n += len(local)
                if n >= limit:
                    yield from solve(False)
                    limit = max(limit, 2 * n)
        if held:
            yield from solve(True)

    return places.repartitionById(parts, F.col("part")).mapInArrow(run, "part int, block binary")


def _gathered(blocks: DataFrame, parts: int, kinds: list[str], pack, schema: str) -> DataFrame:
    """A row (doc_id, hash, packed) for each document of the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:  # a partition holds whole parts; a part's documents are a bounded share
            for p, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(p, []).append(block)
        for own in held.values():
            opened = [_opened(b, kinds) for b in own]
            begin = np.cumsum([0] + [len(x[0]) for x in opened])
            nodes = np.concatenate([x[0] for x in opened])
            of = np.concatenate([x[1] + b for x, b in zip(opened, begin, strict=False)])
            columns = [np.concatenate([x[2][i] for x in opened]) for i in range(len(kinds))]
            names, back = np.unique(nodes, return_inverse=True)
            of = back[of]
            order = np.argsort(of, kind="stable")
            of, columns = of[order], [c[order] for c in columns]
            edge = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            packed = [pack([c[a:b] for c in columns]) for a, b in zip(edge.tolist(), np.r_[edge[1:], len(of)].tolist(), strict=True)]
            names = names[of[edge]]
            yield pa.RecordBatch.from_arrays([pa.array(names["doc"]), pa.array(names["text"]), pa.array(packed, pa.binary())], ["d", "h", "packed"])

    return blocks.repartitionById(parts, F.col("part")).mapInArrow(run, schema)


def _collected(texts: DataFrame, parts: int) -> DataFrame:
    """The stretches of the documents' shared cells as blocks dealt by cell; equal ones of a batch keep one copy of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            begin = np.cumsum([0] + [len(x[0]) for x in held])
            nodes = np.concatenate([x[0] for x in held])
            of, cell, start, size = (np.concatenate([x[i] + (b if i == 1 else 0) for x, b in zip(held, begin, strict=False)]) for i in (1, 2, 3, 4))
            part = (cell >> U(40)).astype(np.int64) % parts
            strings = [s for x in held for s in x[5]]
            return _blocks(part, parts, nodes, of, [cell, start.astype("<i8"), size.astype("<u2")], strings)

        for batch in batches:
            ids, texts_, hashes, packed = (batch.column(i).to_pylist() for i in range(4))
            i = 0
            for nodes, flat, begin in _batches(ids, texts_, hashes):
                own = packed[i : i + len(nodes)]
                i += len(nodes)
                cells = [np.frombuffer(p, "<u8", len(p) // 9) for p in own]
                flags = [np.frombuffer(p, "u1", len(p) // 9, len(p) // 9 * 8) for p in own]
                hot = np.unique(np.concatenate([c[f > 0] for c, f in zip(cells, flags, strict=True)]))
                doc, at, last, least, finer = stretches(flat, begin, hot)
                keep = np.zeros(len(doc), bool)
                cut = np.searchsorted(doc, np.arange(len(nodes) + 1))
                for j, c in enumerate(cells):
                    keep[cut[j] : cut[j + 1]] = np.isin(least[cut[j] : cut[j + 1]], c)
                doc, at, last, least, finer = doc[keep], at[keep], last[keep], least[keep], finer[keep]
                if len(hot):
                    least = np.where(np.isin(least, hot), _mix(least ^ finer), least)
                raw = flat.tobytes()
                strings = [raw[a:b] for a, b in zip(at.tolist(), (last + WINDOW).tolist(), strict=True)]
                held.append((nodes, doc, least, at - begin[doc], last + WINDOW - at, strings))
                n += len(doc)
                if n >= max(HELD_STRETCHES, min(MOST_STRETCHES, STRETCHES_A_PART * parts)):
                    yield out()
                    held, n = [], 0
        if held:
            yield out()

    return texts.mapInArrow(run, "part int, block binary")


def _marked(blocks: DataFrame, parts: int) -> DataFrame:
    """Ranges of bytes to remove (start, end) as blocks dealt by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[bytes, int] = {}
        held = []
        for batch in batches:
            for block in batch.column(1).to_pylist():
                nodes, local, (cell, start, size), at = _opened(block, ["<u8", "<i8", "<u2"])
                block = zstandard.decompress(block[at:])
                begin = np.r_[0, np.cumsum(size.astype(np.int64))]
                which = np.array([number.setdefault(block[a:b], len(number)) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)], np.int64)
                held.append((nodes, local, cell, start, which))
        if not held:
            return
        base = np.cumsum([0] + [len(x[0]) for x in held])
        nodes = np.concatenate([x[0] for x in held])
        of = np.concatenate([x[1] + b for x, b in zip(held, base, strict=False)])
        cell, start, which = (np.concatenate([x[i] for x in held]) for i in (2, 3, 4))
        held = []
        strings = list(number)
        number = {}
        ids = nodes["doc"][of]
        least = np.full(len(strings), np.iinfo(np.int64).max)
        np.minimum.at(least, which, ids)
        home = np.zeros(len(strings), U)
        home[which] = cell
        lengths = np.array([len(s) for s in strings], np.int64)
        later = ids > least[which]  # the whole stretch stands in a smaller document
        ranges = [(of[later], start[later], start[later] + lengths[which[later]])]
        # stretches of cells with more than one are indexed
        _, back, count = np.unique(home, return_inverse=True, return_counts=True)
        own = np.flatnonzero(count[back] > 1)
        s, w = earlier([strings[i] for i in own.tolist()], home[own], least[own])
        s = own[s]
        if len(s):
            head = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (w[1:] != w[:-1] + 1)])
            a, b, s = w[head], w[np.r_[head[1:], len(w)] - 1] + WINDOW, s[head]
            # all places of these strings in their smallest document
            place = np.flatnonzero(~later)
            place = place[np.isin(which[place], s)]
            place = place[np.argsort(which[place], kind="stable")]
            lo, hi = np.searchsorted(which[place], s), np.searchsorted(which[place], s, side="right")
            reps = hi - lo
            spread = np.arange(reps.sum()) + np.repeat(lo - (np.cumsum(reps) - reps), reps)
            at = place[spread]
            ranges.append((of[at], start[at] + np.repeat(a, reps), start[at] + np.repeat(b, reps)))
        of, a, b = (np.concatenate([r[i] for r in ranges]) for i in range(3))
        if len(of):
            part = (_mix(nodes["doc"][of].astype(U)) >> U(40)).astype(np.int64) % parts
            yield _blocks(part, parts, nodes, of, [a.astype("<i8"), b.astype("<i8")])

    return blocks.repartitionById(parts, F.col("part")).mapInArrow(run, "part int, block binary")


def _merged(columns: list[np.ndarray]) -> bytes:
    """Maximal ranges (starts, then ends) of overlapping or touching ones."""
    a, b = columns
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    head = np.flatnonzero(np.r_[True, a[1:] > b[:-1]])
    return a[head].astype("<i8").tobytes() + b[np.r_[head[1:], len(a)] - 1].astype("<i8").tobytes()


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(d, h, packed): for each document with removed bytes its id, its text's hash, and its maximal removed ranges.

    docs has doc_id, text, h.  Minimizers are dealt by hash; the survivors go
    back to their documents; the stretches of surviving cells are dealt by
    cell; ranges go back to documents.  Each step is dealt in packed blocks.
    """
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.count() // 2500)
    shared = _shared(_places(docs, parts), parts)
    cells = written(_gathered(shared, parts, ["<u8", "u1"], lambda c: c[0].tobytes() + c[1].tobytes(), "d long, h long, packed binary"), "cells")
    texts = docs.join(cells, (F.col("doc_id") == F.col("d")) & (docs["h"] == cells["h"])).select("doc_id", "text", docs["h"], "packed")
    ranges = _gathered(_marked(_collected(texts, parts), parts), parts, ["<i8", "<i8"], _merged, "d long, h long, packed binary")
    out = written(ranges, "found")
    discard(cells)
    return out


def copies(docs: DataFrame) -> DataFrame:
    """(doc_id, h) of the documents whose whole text a smaller one has."""
    groups, total = duplicate_groups(docs, keep=F.min)
    rows = docs.select("doc_id", "h", F.sha2("text", 256).alias("text_sha256"))
    out = attach(rows, groups, "text_sha256", "group_size", total, F.col("doc_id")).where(F.col("doc_id") != F.col("keep_id"))
    return written(out.select("doc_id", "h"), "copies")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes) of every row.

    Null counts as empty, and texts of fewer than WINDOW bytes keep all.  Rows
    with a null id are neither compared nor removed from; rows that share an
    id are not smaller than each other.  Bytes that remain of a character
    cut in two are kept as they are, so ``kept`` is binary.  Other columns are
    not read; an empty table gives an empty result.
    """
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    own = rows.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= WINDOW)).select("doc_id", "text", "h")
    # exact copies go whole, and their strings all stand in the document they copy: the index needs them not
    same = copies(own)
    side = same.select(F.col("doc_id").alias("c"), F.col("h").alias("ch"))
    few = same.count() * 24 <= BROADCAST_BYTES
    first = own.join(F.broadcast(side) if few else side, (F.col("doc_id") == F.col("c")) & (F.col("h") == F.col("ch")), "left_anti")
    ranges = repeated_ranges(first).select("d", F.col("h").alias("dh"), "packed", F.lit(False).alias("whole"))
    side = ranges.unionByName(same.select(F.col("doc_id").alias("d"), F.col("h").alias("dh"), F.lit(None).cast("binary").alias("packed"), F.lit(True).alias("whole")))
    side = written(side.dropDuplicates(["d", "dh"]), "ranges")
    few = (side.agg(F.sum(F.coalesce(F.octet_length("packed"), F.lit(0)) + 24)).first()[0] or 0) <= BROADCAST_BYTES
    joined = rows.join(F.broadcast(side) if few else side, (F.col("doc_id") == F.col("d")) & (F.col("h") == F.col("dh")), "left")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, packed, whole in zip(*[batch.column(i).to_pylist() for i in (1, 2, 3)], strict=True):
                raw = text.encode()
                kept, spans, n = raw, 0, len(raw)
                if whole:
                    kept, spans = b"", 1
                elif packed:
                    a, b = np.frombuffer(packed, "<i8").reshape(2, -1)
                    spans = len(a)
                    kept = b"".join(raw[s:e] for s, e in zip([0, *b.tolist()], [*a.tolist(), n], strict=True))
                out.append((n, n - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: 5 if with_text else 4]
            arrays = [batch.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=False)]]
            yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in schema.split(", ")])

    return joined.select("doc_id", "text", "packed", "whole").mapInArrow(run, schema)
