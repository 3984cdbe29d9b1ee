"""Exact Jaccard self-join on word shingles by universe partition and the pigeonhole principle.

A band of set sizes cuts the universe of shingles into segments by hash.  If
two sets of the band have a Jaccard similarity of at least the threshold,
their difference is at most H elements, so of more than H segments at least
one holds the same elements in both.  A set is indexed by the contents of its
cheapest segments, priced by how many entries of all documents fall where an
entry falls; sets that share an entry often enough are verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, among, apart, attach, components, discard, give_back, small_batches, worker_cache, written

WORDS = 5
#: The similarity, in hundredths.
PERCENT = 75
#: Mean elements of a segment at the top of a size band; it is half of that at the bottom.
PER_SEGMENT = 2.4
LEAST_SEGMENTS = 16
#: Indexed segments beyond the H + 1 that are needed, as a share: each raises by one what a linked pair must share.
SLACK = 0.4
#: Entries of up to this many sets give all their pairs at once; larger ones are solved by families.
SMALL_GROUP = 4
#: Families of more sets are compared with pivots first, and spread over tasks that compare so many sets with so many at least.
BLOCK = 256
#: Tasks of a family before its blocks grow, and how many times larger than BLOCK squared a task's comparisons become then.
FAMILY_TASKS = 16
TASK_BLOCKS = 64
#: Shingles that a task's held block has on average at most.
BLOCK_SHINGLES = 1_000_000
#: Shingles of their prefixes that two linked sets must share; sets of fewer give what they can.
SHARED = 16
#: Prefix shingles of up to this many sets give all their pairs.
FEW = 4
#: Sets that all of a larger family are compared with before its blocks are.
PIVOTS = 2
#: Bins in which entries are counted to price them; a table of so many numbers is broadcast, whatever the input.
COST_BINS = 1 << 16
#: Entries that one task of the index holds on average.
TASK_ENTRIES = 250_000
KEPT_WORDS = 100_000
#: Bins in which shingles of uncovered sets are counted; a table of so many numbers is broadcast, whatever the input.
COUNT_BINS = 1 << 20
#: Rows of a table of families that are broadcast at most; beyond, it is joined.
BROADCAST_ROWS = 1_000_000
TEXTS = 256

U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits (splitmix64's finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def most_differences(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The largest symmetric difference that a set of n elements can have with a linked one."""
    largest = n * 100 // percent
    return (n + largest) * (100 - percent) // (100 + percent)


class Shingler:
    """Sets of shingle hashes of texts."""

    def __init__(self, words: int = WORDS):
        self.width, self.words, self.hashes = words, Words(), np.zeros(0, U)

    def sets(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct 64-bit hashes of all texts, and where each text's begin (one more at the end).

        Words are runs of characters other than the six ASCII blanks, A-Z in
        lower case.  A text of fewer words than the width has its whole
        sequence as one shingle; one without words has none.
        """
        if len(self.words) > KEPT_WORDS:
            self.words, self.hashes = Words(), np.zeros(0, U)
        numbers, counts = [], []
        for t in texts:
            own = (t or "").encode().lower().split()
            counts.append(len(own))
            numbers.extend(map(self.words.__getitem__, own))
        if new := self.words.new:
            self.words.new = []
            self.hashes = np.concatenate([self.hashes, np.array([xxhash.xxh3_64_intdigest(w) for w in new], U)])
        flat = self.hashes[np.array(numbers, np.int64)] if numbers else np.zeros(0, U)
        k, n = self.width, len(flat)
        rolled = np.zeros(max(0, n - k + 1), U)
        for i in range(k):
            rolled = _mix(rolled + flat[i : i + len(rolled)] + U(i + 1))
        out, at, begin = [], [0], 0
        for c in counts:
            if c >= k:
                own = rolled[begin : begin + c - k + 1]
                own = np.unique(own)
            elif c:
                h = np.array([c], U)
                for x in flat[begin : begin + c]:
                    h = _mix(h + x + U(77))
                own = h
            else:
                own = rolled[:0]
            out.append(own)
            at.append(at[-1] + len(own))
            begin += c
        return (np.concatenate(out) if out else rolled[:0]), np.array(at, np.int64)


def shingler(words: int) -> Shingler:
    kept = worker_cache("shingler")
    if words not in kept:
        kept[words] = Shingler(words)
    return kept[words]


def set_keys(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that together identify each set."""
    some = np.flatnonzero(np.diff(at))
    a, b = np.zeros(len(at) - 1, U), np.zeros(len(at) - 1, U)
    if len(some):
        a[some] = np.add.reduceat(_mix(flat + U(0x1234567)), at[some])
        b[some] = np.add.reduceat(_mix(flat ^ U(0x9E3779B97F4A7C15)), at[some])
    return a, b


def segment_counts(band: np.ndarray) -> np.ndarray:
    return np.maximum(LEAST_SEGMENTS, np.ceil(2.0 ** (band + 1) / PER_SEGMENT)).astype(np.int64)


def entries(flat: np.ndarray, at: np.ndarray, percent: int = PERCENT, costs: np.ndarray | None = None, every: bool = False) -> tuple[np.ndarray, ...]:
    """(signature, member) of the index and (set, band, required) of each member.

    A member is a set in one band: its own (sizes 2^b up to 2^(b+1)), and the
    next too if a set of that band could be linked with it.  Its entries are
    the contents of its segments, empty ones left out, cheapest first until
    H + 1 and the slack are reached.  An entry's cost is the measured number
    of entries in its bin (``costs``; all alike without it), ties going by
    signature.  All sets rank entries in this one order, so for two linked
    sets at least ``required`` of the entries of the one whose entries end
    first are entries of the other: at most H of them differ, and the rest
    come before the other's end too.

    Segments compete by cost, and neighbourhoods come after them: the sets
    that meet in a segment's neighbourhood include all that meet in its whole
    content, so it never costs less.  Only a set whose elements fell into H
    segments or fewer is short of entries.  It gives the contents of all its
    segments; so if just one of two linked sets is short, one at least of the
    other's H + 1 entries is among them.  Two short sets of a band meet in the
    band's own entry, which every short set gives; with the neighbourhoods of
    all its segments, which those that have enough of them give too, near
    ones among them share more than that.

    ``every`` gives the contents of all segments, to be counted.
    """
    n = np.diff(at)
    sets = np.flatnonzero(n)
    if not len(sets):
        z = np.zeros(0, np.int64)
        return np.zeros(0, U), z, z, z, z
    band = np.floor(np.log2(n[sets])).astype(np.int64)
    band -= (1 << band) > n[sets]
    upper = n[sets] * 100 // percent >= 1 << (band + 1)
    member_set = np.concatenate([sets, sets[upper]])
    member_band = np.concatenate([band, band[upper] + 1])
    size, m = n[member_set], segment_counts(member_band)
    most = most_differences(size, percent)
    base = np.r_[0, np.cumsum(m)]
    starts = np.r_[0, np.cumsum(size)]
    owner = np.repeat(np.arange(len(size)), size)
    index = np.arange(starts[-1]) + np.repeat(at[member_set] - starts[:-1], size)
    h = flat[index]
    segment = (_mix(h + U(0xA5A5A5)) >> U(33)).astype(np.int64) % m[owner]
    place = base[owner] + segment
    value = _mix(h ^ U(0xC0FFEE1234))
    total = np.zeros(base[-1], U)
    np.add.at(total, place, value)
    count = np.bincount(place, minlength=base[-1])
    full = np.flatnonzero(count)
    of = np.searchsorted(base, full, side="right") - 1
    salt = _mix((member_band[of] * 0x10001).astype(U) + ((full - base[of]).astype(U) << U(20)))
    signature = _mix(total[full] + salt)
    if every:
        return signature, of, member_set, member_band, np.zeros(0, np.int64)
    first = np.searchsorted(of, np.arange(len(size)))
    price = np.zeros(len(full), np.int64) if costs is None else costs[(signature & U(len(costs) - 1)).astype(np.int64)]
    rank = np.empty(len(full), np.int64)
    rank[np.lexsort((signature, price, of))] = np.arange(len(full)) - first[of]
    available = np.bincount(of, minlength=len(size))
    wanted = np.minimum(available, np.ceil((1 + SLACK) * (most + 1)).astype(np.int64))
    keep = rank < wanted[of]
    signatures, members = [signature[keep]], [of[keep]]
    required = np.maximum(1, wanted - most)
    for x in np.flatnonzero(available <= most):  # few: sets of a handful of elements that fell together
        got = [_mix(np.array([member_band[x]], U) + U(0xFEED))]
        own = np.flatnonzero(of == x)
        if 2 * len(own) > most[x]:
            got.append(signature[own] ^ U(0xDE1))
            inside = np.flatnonzero(owner == x)
            slot = np.searchsorted(full, place[inside])
            got.append(_mix(total[full[slot]] - value[inside] + salt[slot]) ^ U(0xDE1))
        got = np.unique(np.concatenate(got))
        signatures.append(got)
        members.append(np.full(len(got), x))
    return np.concatenate(signatures), np.concatenate(members), member_set, member_band, required


#: A set in a band, 16 bytes: each task that has entries of it gets these.  ``required`` holds twice the number, and 1 for the upper band.
MEMBER = np.dtype([("doc", "<i8"), ("n", "<u4"), ("required", "<u4")])
#: Bytes of a signature that an entry carries; its part tells more of it.
KEY_BYTES = 5


def _planes(x: np.ndarray) -> bytes:
    """The items' first bytes, then their second bytes, and so on: bytes that hardly differ lie together."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


def _items(raw: bytes, kind: np.dtype) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def pack(members: np.ndarray, counts: np.ndarray, keys: np.ndarray) -> bytes:
    """A block of members, each with so many of the keys, of which KEY_BYTES are kept.

    With more input there are more parts, and a part has fewer entries of a
    member, so members are compressed and an entry takes no other room.
    """
    head = zstandard.compress(_planes(members) + _planes(counts.astype("<u4")), 1)
    tail = np.ascontiguousarray(keys, "<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()
    return np.array([len(members), len(head)], "<u4").tobytes() + head + tail


def unpack(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(members, keys, member of each key) of a block."""
    k, size = np.frombuffer(block, "<u4", 2).tolist()
    head = zstandard.decompress(block[8 : 8 + size])
    members, counts = _items(head[: k * MEMBER.itemsize], MEMBER), _items(head[k * MEMBER.itemsize :], np.dtype("<u4"))
    tail = np.frombuffer(block, np.uint8, -1, 8 + size).reshape(-1, KEY_BYTES)
    keys = np.zeros((len(tail), 8), np.uint8)
    keys[:, :KEY_BYTES] = tail
    return members, keys.view("<u8").ravel(), np.repeat(np.arange(k), counts)


def loosened(members: np.ndarray, keys: np.ndarray, member: np.ndarray) -> np.ndarray:
    """Members that require less by the number of their entries that look like another one of theirs, as those count once."""
    both = np.sort((member.astype(U) << U(8 * KEY_BYTES)) | keys)
    alike = (both[1:][both[1:] == both[:-1]] >> U(8 * KEY_BYTES)).astype(np.int64)
    if len(alike):
        members = members.copy()
        less = np.bincount(alike, minlength=len(members))
        members["required"] = np.maximum(1, _required(members) - less) * 2 + (members["required"] & 1)
    return members


def _bands(x: np.ndarray) -> np.ndarray:
    n = x["n"].astype(np.int64)
    band = np.floor(np.log2(np.maximum(n, 1))).astype(np.int64)
    return band - ((1 << band) > n) + (x["required"] & 1)


def _required(x: np.ndarray) -> np.ndarray:
    return (x["required"] >> 1).astype(np.int64)


def _costs(docs: DataFrame, words: int, percent: int) -> np.ndarray:
    """How many entries of all documents fall into each of COST_BINS bins by signature.

    A task gives COST_BINS numbers at most, however many rows it reads.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, counts = shingler(words), np.zeros(COST_BINS, np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for i in range(0, len(texts), TEXTS):
                signatures = entries(*s.sets(texts[i : i + TEXTS]), percent, every=True)[0]
                counts += np.bincount((signatures & U(COST_BINS - 1)).astype(np.int64), minlength=COST_BINS)
        some = np.flatnonzero(counts)
        for i in range(0, len(some), 8192):
            yield pa.RecordBatch.from_arrays([pa.array(some[i : i + 8192].astype(np.int32)), pa.array(counts[some[i : i + 8192]])], ["bin", "n"])

    rows = docs.where("doc_id is not null").select("text").mapInArrow(run, "bin int, n long")
    counted = rows.groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COST_BINS, np.int64)
    out[counted.column("bin").to_numpy()] = counted.column("n").to_numpy()
    return out


def _index(docs: DataFrame, parts: int, words: int, percent: int) -> DataFrame:
    """The index as packed blocks (part, block); a block holds members and their entries."""

    bound = docs.sparkSession.sparkContext.broadcast(_costs(docs, words, percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, costs = shingler(words), bound.value
        held, n = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal held, n
            begin = np.cumsum([0] + [len(x[0]) for x in held])
            members = np.concatenate([x[0] for x in held])
            signatures = np.concatenate([x[1] for x in held])
            member = np.concatenate([x[2] + b for x, b in zip(held, begin, strict=False)])
            held, n = [], 0
            keys = signatures & U((1 << 8 * KEY_BYTES) - 1)
            members = loosened(members, keys, member)
            part = (signatures >> U(8 * KEY_BYTES)).astype(np.int64) % parts
            order = np.argsort(part * len(members) + member, kind="stable")
            part, member, keys = part[order], member[order], keys[order]
            first = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (member[1:] != member[:-1])])
            counts, used, home = np.diff(np.r_[first, len(part)]), members[member[first]], part[first]
            cut, at = np.searchsorted(home, np.arange(parts + 1)), np.searchsorted(part, np.arange(parts + 1))
            ids, blocks = [], []
            for p in np.flatnonzero(np.diff(at)).tolist():
                own = slice(cut[p], cut[p + 1])
                blocks.append(pack(used[own], counts[own], keys[at[p] : at[p + 1]]))
                ids.append(p)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blocks, pa.binary())], ["part", "block"])

        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for i in range(0, len(texts), TEXTS):
                flat, at = s.sets(texts[i : i + TEXTS])
                signatures, member, of, band, required = entries(flat, at, percent, costs)
                if not len(signatures):
                    continue
                members = np.zeros(len(of), MEMBER)
                members["doc"], members["n"] = ids[i : i + TEXTS].astype(np.int64)[of], np.diff(at)[of]
                members["required"] = required * 2
                members["required"] += (band - _bands(members)).astype(np.uint32)
                held.append((members, signatures, member))
                n += len(signatures)
                if n >= 400_000:
                    yield from out()
        if held:
            yield from out()
        give_back()

    rows = docs.select("doc_id", "text").where("doc_id is not null")
    return rows.mapInArrow(run, "part int, block binary")


FOUND = "kind int, a long, b long, band int, c long, t long"


def _groups(index: DataFrame, parts: int, percent: int) -> DataFrame:
    """What the entries of equal signature say.

    kind 0: sets a < b share c entries of small groups in a band, t being
    required.  kind 1: set b is in c large groups of a band, t being required.
    kind 2: set b shares c large groups with their smallest member a.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub: dict[int, np.void] = {}
        held, n, limit = [], 0, 8 * TASK_ENTRIES

        def table(kind: int, a, b, band, c, t) -> pa.RecordBatch:
            cols = [np.full(len(a), kind, np.int32), a.astype(np.int64), b.astype(np.int64), band.astype(np.int32), c.astype(np.int64), t.astype(np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["kind", "a", "b", "band", "c", "t"])

        def counted(kind: int, x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
            if kind == 0:
                ok = np.minimum(x["n"], y["n"]).astype(np.int64) * 100 >= percent * np.maximum(x["n"], y["n"]).astype(np.int64)
                x, y = x[ok], y[ok]
            if not len(x):
                return
            a, b = (np.minimum(x["doc"], y["doc"]), np.maximum(x["doc"], y["doc"])) if kind == 0 else (x["doc"], y["doc"])
            t, band = np.minimum(_required(x), _required(y)), _bands(x)
            order = np.lexsort((band, b, a))
            a, b, band, t = a[order], b[order], band[order], t[order]
            new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (band[1:] != band[:-1])])
            yield table(kind, a[new], b[new], band[new], np.diff(np.r_[new, len(a)]), np.minimum.reduceat(t, new))

        def solve(last: bool) -> Iterator[pa.RecordBatch]:
            """Give out what is held; before the last time, only groups that have become too large to wait for more."""
            nonlocal held, n
            members = np.concatenate([m for m, _, _ in held])
            begin = np.cumsum([0] + [len(m) for m, _, _ in held])
            signatures = np.concatenate([s for _, s, _ in held])
            member = np.concatenate([i + b for (_, _, i), b in zip(held, begin, strict=False)])
            order = np.argsort(signatures, kind="stable")
            signatures, member = signatures[order], member[order]
            edge = np.flatnonzero(np.r_[True, signatures[1:] != signatures[:-1]])
            size = np.diff(np.r_[edge, len(signatures)])
            known = np.isin(signatures[edge], np.array(list(hub), U)) if hub else np.zeros(len(edge), bool)
            ready = (size > 1) | known if last else size > 1000
            rest = np.repeat(~ready, size)
            chosen = np.repeat(ready, size)
            if not last:
                kept = member[rest]
                used, local = np.unique(kept, return_inverse=True)
                held, n = [(members[used], signatures[rest], local)], int(rest.sum())
            else:
                held, n = [], 0
            s, x = signatures[chosen], members[member[chosen]]
            if not len(s):
                return
            order = np.lexsort((x["doc"], s))
            s, x = s[order], x[order]
            one = np.r_[True, (s[1:] != s[:-1]) | (x["doc"][1:] != x["doc"][:-1])]
            s, x = s[one], x[one]
            edge = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            size = np.diff(np.r_[edge, len(s)])
            large = (size > SMALL_GROUP) | (np.isin(s[edge], np.array(list(hub), U)) if hub else False) | (not last)
            for gap in range(1, SMALL_GROUP):
                i = np.arange(len(s) - gap)
                i = i[(s[i] == s[i + gap]) & ~np.repeat(large, size)[i]]
                yield from counted(0, x[i], x[i + gap])
            big = np.repeat(large, size)
            if big.any():
                at = edge[large]
                heads = x[at].copy()
                for j, g in enumerate(s[at].tolist()):
                    if g in hub:
                        heads[j] = hub[g]
                    elif not last:
                        hub[g] = heads[j]
                leader = np.repeat(heads, size[large])
                y = x[big]
                yield from counted(1, y, y)
                other = leader["doc"] != y["doc"]
                yield from counted(2, leader[other], y[other])

        for batch in batches:
            for block in batch.column(1).to_pylist():
                members, keys, member = unpack(block)
                # bands stay apart whatever the bytes of a signature that were left out
                held.append((members, keys | (_bands(members)[member].astype(U) << U(8 * KEY_BYTES)), member))
                n += len(keys)
                if n >= limit:
                    yield from solve(False)
                    limit = max(limit, 2 * n)  # what is left is no hot group; look again when it has doubled
        if held:
            yield from solve(True)
        give_back()

    return index.repartitionById(parts, F.col("part")).mapInArrow(run, FOUND)


def _sets_of(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(doc_id, set) of the given documents; only texts that a bitmap of their ids marks are shuffled."""
    rows = docs.select("doc_id", "text").where("doc_id is not null")
    rows = among(rows, F.xxhash64("doc_id"), ids.select(F.xxhash64("doc_id")), ids.count())
    rows = rows.join(ids.select(F.col("doc_id").alias("__i")), F.col("doc_id") == F.col("__i"), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shingler(words)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i in range(0, len(texts), TEXTS):
                flat, at = s.sets(texts[i : i + TEXTS])
                values = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i : i + TEXTS], values], ["doc_id", "set"])

    return rows.mapInArrow(run, "doc_id long, set array<long>")


def _verified(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are linked; pairs is a written table."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = written(_sets_of(docs, written(ids, "ids"), words), "sets")
    right = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("sb")), "b")
    both = right.join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("sa")), "a")
    out = written(both.where(_linked("sa", "sb", percent)).select("a", "b").distinct(), "links")
    discard(sets)
    return out


def _uncovered(stars: DataFrame, many: DataFrame) -> DataFrame:
    """(node) of the sets that may have a link all of whose shared entries lie in large groups.

    stars has a, b, band; many has node, band, l, t.  Such a pair shares the
    smaller of its two required numbers at least, so the set that requires
    less is in enough large groups itself, and the other is in as many as that
    one requires and shares a large group, and so a leader, with it.
    """
    own = many.where("l >= t")
    leaders = stars.select("a", "band").distinct()
    inside = written(stars.unionByName(leaders.select("a", F.col("a").alias("b"), "band")), "inside")
    least = inside.join(own.select(F.col("node").alias("b"), "band", "t"), ["b", "band"]).groupBy("a", "band").agg(F.min("t").alias("least"))
    least = written(least, "least")
    least = _small(least)
    needed = inside.join(least, ["a", "band"]).groupBy("b", "band").agg(F.min("least").alias("least"))
    more = needed.join(many.select(F.col("node").alias("b"), "band", "l"), ["b", "band"]).where("l >= least")
    return written(own.select("node").unionByName(more.select(F.col("b").alias("node"))).distinct(), "uncovered")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _linked(a: str, b: str, percent: int):
    common = F.size(F.array_intersect(a, b))
    return (common > 0) & (common * 100 >= (F.size(a) + F.size(b) - common) * percent)


def _pivot_links(sets: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) of members linked with one of their family's pivots.

    sets has node, family, l, set; sizes has family, n of families larger than
    a block.  In each round the member not linked yet that is in most large
    groups, the likeliest original of copies, is its family's pivot, and all
    members are compared with it.  A family's rows are dealt in shares.
    """
    shares = F.ceil(F.col("n") / (4 * BLOCK)).cast("int")
    own = sets.join(_small(sizes), "family").withColumn("share", F.pmod(F.xxhash64("node"), shares))
    own = written(own.select("node", "family", "l", "n", "share", "set"), "large-families")
    rest, found = own.select("node", "family", "l"), []
    for _ in range(PIVOTS):
        pivots = written(rest.groupBy("family").agg(F.max_by("node", F.struct("l", -F.col("node"))).alias("pivot")), "pivots")
        if pivots.isEmpty():
            break
        held = own.join(_small(pivots.select("pivot")), F.col("node") == F.col("pivot")).select("family", "pivot", F.col("set").alias("__p"), F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"))
        met = own.join(held, ["family", "share"]).where((F.col("node") != F.col("pivot")) & _linked("set", "__p", percent))
        edges = written(met.select(F.col("node").alias("a"), F.col("pivot").alias("b")), "pivot-links")
        found.append(edges)
        done = edges.select(F.col("a").alias("node")).unionByName(pivots.select(F.col("pivot").alias("node")))
        rest = written(rest.join(done, "node", "left_anti"), "rest")
    out = found[0]
    for edges in found[1:]:
        out = out.unionByName(edges)
    discard(own)
    return out


def _refined(sets: DataFrame, percent: int) -> DataFrame:
    """(node, family) of the sets that may share enough shingles of their prefixes, directly or over others.

    A linked partner has at least the share ``percent`` of a set's shingles,
    so of its rarest ones, as many as the others leave over and SHARED more,
    SHARED at least are the partner's too, and in the partner's own prefix if
    that ends later.  Rare goes by counts in COUNT_BINS bins and then by hash;
    any order of all shingles would keep every link.  Sets that only share a
    passage with many others have rarer shingles of their own to fill their
    prefix, and so leave.

    A few shingles are alike by chance, more of them the more sets there are.
    So pairs are counted over shingles of few sets, and joined if these
    suffice.  Any other linked pair shares shingles of many sets; each of the
    two then has enough of those for what its nearest set leaves open, and
    only such sets are joined by them.
    """
    spark = sets.sparkSession
    counted = sets.select(F.explode("set").alias("e")).groupBy(F.pmod("e", F.lit(COUNT_BINS)).cast("int").alias("bin")).agg(F.least(F.count("*"), F.lit((1 << 31) - 1)).cast("int").alias("n")).where("n > 1").toArrow()
    counts = np.zeros(COUNT_BINS, np.int32)
    counts[counted.column("bin").to_numpy()] = counted.column("n").to_numpy()
    bound = spark.sparkContext.broadcast(counts)
    most = SHARED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = bound.value
        for batch in batches:
            column = batch.column(1)
            flat, at, nodes = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy(), batch.column(0).to_numpy()
            out, of, sizes = [], [], []
            for i, node in enumerate(nodes.tolist()):
                own = flat[at[i] : at[i + 1]]
                times = counts[own & (COUNT_BINS - 1)]
                common = -(-len(own) * percent // 100)
                first = np.lexsort((own, times))[: len(own) - common + min(most, common)]
                first = first[times[first] > 0]  # a bin of one shingle that one set has
                out.append(own[first])
                of.append(np.full(len(first), node, np.int64))
                sizes.append(np.full(len(first), common, np.int64))
            if out:
                # two linked sets share ``need`` of the one that needs less, and a partner never needs less than ``low``
                common = np.concatenate(sizes)
                need, low = np.minimum(most, common), np.minimum(most, -(-common * percent // 100))
                columns = [np.concatenate(out), np.concatenate(of), need.astype(np.int32), low.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["e", "node", "need", "low"])

    rows = sets.select("node", "set").mapInArrow(run, "e long, node long, need int, low int")
    prefixes = written(rows.select(F.col("e").cast("string").alias("e"), "node", "need", "low"), "prefixes")
    groups = written(prefixes.groupBy("e").agg(F.count("*").alias("size")).where("size > 1"), "shared")
    placed = written(attach(prefixes, groups, "e", "size", prefixes.count(), F.col("node")).where("size > 1"), "placed")
    discard(prefixes)
    few = placed.where(F.col("size") <= FEW).groupBy("e").agg(F.array_sort(F.collect_list(F.struct("node", "need"))).alias("x"))
    pair = few.select("x", F.posexplode("x").alias("i", "left")).select("left", F.explode(F.slice("x", F.col("i") + 2, FEW)).alias("right")).where("left.node < right.node")
    near = pair.groupBy(F.col("left.node").alias("a"), F.col("right.node").alias("b")).agg(F.count("*").alias("s"), F.min(F.least("left.need", "right.need")).alias("t"))
    near = written(near, "near")
    best = near.select(F.explode(F.array("a", "b")).alias("__n"), "s").groupBy("__n").agg(F.max("s").alias("s"))
    many = placed.where(F.col("size") > FEW)
    own = many.groupBy("node").agg(F.count("*").alias("g"), F.min("low").alias("low")).join(best, F.col("node") == F.col("__n"), "left")
    own = own.where(F.col("g") + F.coalesce("s", F.lit(0)) >= F.col("low")).select("node")
    many = written(many.select("e", "node").join(own, "node"), "many")
    heads = written(many.groupBy("e").agg(F.min("node").alias("head"), F.count("*").alias("size")).where("size > 1"), "heads")
    edges = attach(many, heads, "e", "size", many.count(), F.col("node")).where("head <> node").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    out = components(edges.unionByName(near.where("s >= t").select("a", "b"))).withColumnRenamed("component", "family")
    for x in (placed, near, many):
        discard(x)
    return out


def family_blocks(families: DataFrame) -> DataFrame:
    """(family, ni, nj): into how many blocks the others (o, of ``held`` shingles) and all members (n) of a family are cut."""
    work = F.col("o") * F.col("n") / (BLOCK * BLOCK)
    tasks = F.greatest(F.ceil(work / TASK_BLOCKS), F.least(F.ceil(work), F.lit(FAMILY_TASKS)))
    ni = F.greatest(F.ceil(F.sqrt(tasks * F.col("o") / F.col("n"))), F.ceil(F.col("held") / BLOCK_SHINGLES))
    return families.withColumn("ni", ni).select("family", F.col("ni").cast("int").alias("ni"), F.greatest(F.lit(1), F.ceil(tasks / F.col("ni"))).cast("int").alias("nj"))


def _family_links(sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that span the links of each family; sets is a written table of node, family, l, set.

    Members of a large family are compared with a few pivots first.  Members
    that these join are joined already, so what remains is to compare the
    others, those outside the family's largest joined part, with all.  For
    that the others are cut into blocks, all members too, and a task compares
    one block of others with one of all: its share is bounded, and a family of
    any size spreads over as many tasks as it has pairs of blocks.  A set is
    sent to one task for each block of the other kind, so a family has few
    blocks, FAMILY_TASKS pairs of them until a task's share is full.  The task
    holds an inverted index of the others' block; the other block's sets
    stream past and count what they share.  Of a member's links one edge
    leaves, and what it joins is united in the task, so pairs are never given
    out.
    """
    sizes = written(sets.groupBy("family").agg(F.count("*").alias("n")), "sizes")
    large = sizes.where(F.col("n") > BLOCK)
    pivots = None if large.isEmpty() else _pivot_links(sets, large, percent)
    members = sets.select("node", "family", F.size("set").alias("size"))
    if pivots is None:
        place = members.withColumn("other", F.lit(True))
    else:
        label = components(pivots).withColumnRenamed("component", "label")
        place = members.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
        main = place.groupBy("family", "label").agg(F.count("*").alias("c")).where("c > 1").groupBy("family").agg(F.max_by("label", F.struct("c", -F.col("label"))).alias("main"))
        place = place.join(_small(written(main, "main")), "family", "left").withColumn("other", F.coalesce(F.col("label") != F.col("main"), F.lit(True)))
    place = written(place.select("node", "family", "other", "size"), "places")
    blocks = place.groupBy("family").agg(F.count_if("other").alias("o"), F.count("*").alias("n"), F.sum(F.when(F.col("other"), F.col("size"))).alias("held")).where("o > 0")
    blocks = family_blocks(blocks)
    rows = sets.join(place.select("node", "other"), "node").join(_small(written(blocks, "blocks")), "family")
    block = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "node"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    core = rows.where("other").select("family", block("ni", 1).alias("i"), each("nj").alias("j"), F.lit(1).alias("core"), "node", "set")
    every = rows.select("family", each("ni").alias("i"), block("nj", 2).alias("j"), F.lit(0).alias("core"), "node", "set")
    rows = core.unionByName(every).repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", F.desc("core"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets_, index, root = None, [], [], None, []

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        def out(edges: list[tuple[int, int]]) -> pa.RecordBatch:
            a, b = zip(*edges, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        def close() -> list[tuple[int, int]]:
            return [(ids[i], ids[find(i)]) for i in range(len(root)) if find(i) != i]

        for batch in batches:
            edges = []
            parts = zip(*[batch.column(c).to_pylist() for c in ("family", "i", "j", "core", "node")], strict=True)
            column = batch.column(batch.schema.get_field_index("set"))
            flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            for i, (*cell, core, node) in enumerate(parts):
                if cell != key:
                    edges += close()
                    key, ids, sets_, index, root = cell, [], [], None, []
                own = flat[at[i] : at[i + 1]]
                if core:
                    ids.append(node)
                    sets_.append(own)
                    continue
                if not ids:
                    continue
                if index is None:
                    lengths = np.array([len(x) for x in sets_], np.int64)
                    values, place = np.unique(np.concatenate(sets_), return_inverse=True)
                    order = np.argsort(place, kind="stable")
                    index = values, np.r_[0, np.cumsum(np.bincount(place))], np.repeat(np.arange(len(ids)), lengths)[order], lengths
                    root = list(range(len(ids)))
                values, cut, owner, lengths = index
                slot = np.searchsorted(values, own)
                slot = slot[values[np.minimum(slot, len(values) - 1)] == own]
                reps = cut[slot + 1] - cut[slot]
                begin = np.cumsum(reps) - reps
                shared = np.bincount(owner[np.arange(reps.sum()) + np.repeat(cut[slot] - begin, reps)], minlength=len(ids))
                linked = np.flatnonzero((shared > 0) & (shared * 100 >= percent * (lengths + len(own) - shared))).tolist()
                if linked:
                    first = find(linked[0])
                    if ids[linked[0]] != node:
                        edges.append((node, ids[linked[0]]))
                    elif len(linked) > 1:
                        edges.append((node, ids[linked[1]]))
                    for x in linked[1:]:
                        x = find(x)
                        if x != first:
                            root[max(x, first)] = min(x, first)
                            first = min(x, first)
            if edges:
                yield out(edges)
        if edges := close():
            yield out(edges)

    out = rows.mapInArrow(run, "a long, b long")
    return written(out if pivots is None else out.unionByName(pivots), "family-links")


def links(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, total: int | None = None) -> DataFrame:
    """Edges (a, b) whose connected components are those of all links.

    docs has doc_id and text, a row for each different set.  Every edge joins
    linked documents or ones that links join; not each linked pair is among
    them: a family's links are spanned, not listed.

    1. Index all sets; collect equal entries.  Pairs of small groups are
       verified if they share what a linked pair must share, less the large
       groups that both may be in.
    2. A linked pair not seen in 1 shares the smaller of its two ``required``
       entries of large groups at least.  Sets in so many large groups, by
       their own number or a partner's, are uncovered; those of them that
       share enough shingles of their prefixes form families, and each family is
       compared within itself.
    """
    spark = docs.sparkSession
    total = docs.count() if total is None else total
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // 4000)
    found = written(_groups(_index(docs, parts, words, percent), parts, percent), "groups")
    many = found.where("kind = 1").groupBy(F.col("b").alias("node"), "band").agg(F.sum("c").alias("l"), F.min("t").alias("t"))
    many = written(many, "large")
    small = found.where("kind = 0").groupBy("a", "b", "band").agg(F.sum("c").alias("c"), F.min("t").alias("t"))
    la, lb = (many.select(F.col("node").alias(x), "band", F.col("l").alias(f"l{x}")) for x in "ab")
    small = small.join(la, ["a", "band"], "left").join(lb, ["b", "band"], "left")
    enough = F.col("c") >= F.col("t") - F.least(F.coalesce("la", F.lit(0)), F.coalesce("lb", F.lit(0)))
    uncovered = _uncovered(found.where("kind = 2").select("a", "b", "band").distinct(), many)
    pairs = small.where(enough).where("a < b").select("a", "b").distinct()
    # pairs inside a family are left to it
    if not uncovered.isEmpty():
        weight = many.groupBy("node").agg(F.sum("l").alias("l"))
        own = written(_sets_of(docs, uncovered.select(F.col("node").alias("doc_id")), words), "sets")
        sets = own.select(F.col("doc_id").alias("node"), "set")
        families = written(_refined(sets, percent), "families")
        fa, fb = (families.select(F.col("node").alias(x), F.col("family").alias(f"f{x}")) for x in "ab")
        pairs = pairs.join(fa, "a", "left").join(fb, "b", "left").where("fa is null or fb is null or fa <> fb").select("a", "b")
        sets = written(sets.join(families.join(weight, "node"), "node").select("node", "family", "l", "set"), "family-sets")
        discard(own)
        inside = _family_links(sets, percent)
        discard(sets)
    pairs = written(pairs, "pairs")
    out = _verified(docs, pairs, words, percent)
    return out if uncovered.isEmpty() else out.unionByName(inside)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs.

    component_id is the smallest id reachable by links.  Null text and text
    without words have an empty set, linked with nothing, not even with each
    other: component_id is the id itself.  A null id gets the component of
    its set if other rows have it, and null otherwise.  Rows that repeat an id
    with other texts count as one document in the links.  Other columns are
    not read; an empty table gives an empty result.
    """
    own = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("h"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shingler(words)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i in range(0, len(texts), TEXTS):
                flat, at = s.sets(texts[i : i + TEXTS])
                a, b = set_keys(flat, at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i : i + TEXTS], batch.column(2)[i : i + TEXTS], pa.array(np.diff(at)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["doc_id", "h", "n", "ka", "kb"]
                )

    sets = written(own.mapInArrow(keys, "doc_id long, h long, n long, ka long, kb long"), "keys")
    total = sets.count()
    classes = sets.where("n > 0").groupBy("n", "ka", "kb").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size")).where("size > 1")
    classes = written(classes.select(F.concat_ws(":", "n", "ka", "kb").alias("k"), "rep", "size"), "classes")
    keyed = sets.withColumn("k", F.when(F.col("n") > 0, F.concat_ws(":", "n", "ka", "kb")))
    placed = attach(keyed.select("doc_id", "h", "n", "k"), classes, "k", "size", total, F.col("doc_id"))
    placed = written(placed.select("doc_id", "h", "n", F.coalesce("rep", "doc_id").alias("rep")), "classes")
    # of equal sets the smallest id stands for all
    gone = placed.where("rep <> doc_id").select(F.col("doc_id").alias("gd"), F.col("h").alias("gh")).distinct()
    gone = written(gone, "gone")
    clean, doubtful = apart(own, F.xxhash64("doc_id", "h"), gone.select(F.xxhash64("gd", "gh")), gone.count())
    first = clean.unionByName(doubtful.join(gone, (F.col("doc_id") == F.col("gd")) & (F.col("h") == F.col("gh")), "left_anti"))
    found = links(first.select("doc_id", "text"), words, percent, total)
    # a row hangs under its set's smallest id, and those under their component; ids repeated with other texts add links
    extra = placed.where("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b")
    if not extra.isEmpty():
        found = found.unionByName(placed.join(extra.select("doc_id"), "doc_id", "left_semi").select(F.least("doc_id", "rep").alias("a"), F.greatest("doc_id", "rep").alias("b")).where("a < b").distinct())
    place = written(components(found), "components")
    out = placed.join(place, F.col("rep") == F.col("node"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each group of linked documents, columns as they were.

    The document whose id is the component's stays; so do documents without
    words, rows that repeat the kept id, and rows with a null id.
    """
    groups = near_groups(docs, id_col, text_col, words, percent)
    gone = written(groups.where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    id_ = F.col(f"`{id_col}`").cast("long")
    clean, doubtful = apart(docs, F.xxhash64(id_), gone.select(F.xxhash64("__gone")), gone.count())
    return clean.unionByName(doubtful.join(gone, id_ == F.col("__gone"), "left_anti"))
