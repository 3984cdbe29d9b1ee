"""Phrase collocations: counts level by level, each level pruned by the one below, then scored by their cuts."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, discard, give_back, small_batches, written

MOST_WORDS = 5
LEAST = 100
TOP = 2000
UNKNOWN = "und"
#: Phrases of a level whose hashes are broadcast as they are, 16 MB; beyond, a bitmap takes their place.
MOST_HASHES = 2_000_000
#: Different words of a level's phrases that are broadcast with them at most; beyond, tasks number all words they meet.
MOST_VOCABULARY = 300_000
#: Bits of that bitmap, 32 MB whatever the input.
BITS = 1 << 28
#: Different words that a task numbers before it gives out its counts and starts again.
KEPT_WORDS = 500_000
#: Different phrases that a task counts before it gives them out.
KEPT_PHRASES = 1_200_000
#: Bytes of text that are numbered at once.
CHUNK = 1 << 19

U = np.uint64
#: A byte that no UTF-8 text has, between pieces.
GAP = b"\xff"
_TABLE = bytearray(range(256))
for _c in b".,;:!?\n\x0b\x0c\r":
    _TABLE[_c] = GAP[0]
_TABLE[ord("\t")] = ord(" ")
_TABLE = bytes(_TABLE)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits (splitmix64's finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def _phrase_hash(lang: str, words: np.ndarray) -> np.ndarray:
    """Hashes of phrases of a language; words has a row for each phrase and a column for each word's hash."""
    h = np.full(len(words), xxhash.xxh3_64_intdigest(lang.encode()), U)
    for k in range(words.shape[1]):
        h = _mix(h + words[:, k])
    return h


class Frequent:
    """Tells which hashes are those of a level's phrases; of others, a bitmap may let a few pass, which are counted in vain.

    ``words`` are those that the phrases consist of, if there are not too many.
    """

    def __init__(self, hashes: np.ndarray | None = None, bitmap: np.ndarray | None = None, words: list[bytes] | None = None):
        self.hashes, self.bitmap, self.words = hashes, bitmap, words

    def __call__(self, h: np.ndarray) -> np.ndarray:
        if self.bitmap is not None:
            at = h & U(BITS - 1)
            return (self.bitmap[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & 1 > 0
        if not len(self.hashes):
            return np.zeros(len(h), bool)
        at = np.searchsorted(self.hashes, h)
        return self.hashes[np.minimum(at, len(self.hashes) - 1)] == h


class Counter:
    """Counts of the phrases of k words in texts, a language at a time; all counts are exact.

    A phrase's key is its words' numbers.  Words get these as they come, or
    only those of the level below have one: any other word ends a phrase as a
    gap does, since no phrase with it can be frequent.
    """

    def __init__(self, k: int, known: Frequent | None):
        self.k, self.known = k, known
        self.fixed = known is not None and known.words is not None
        if self.fixed:
            self.words = {GAP: 0} | {w: i for i, w in enumerate(known.words, 1)}
            self.hashes = np.array([_word_hash(w) for w in self.words], U)
            self.flags: dict[str, np.ndarray] = {}
        self._reset()

    def _reset(self) -> None:
        if not self.fixed:
            self.words, self.hashes = Words(), np.zeros(0, U)
            self.words[GAP]  # number 0
            self.flags = {}
        self.held: dict[str, list[np.ndarray]] = {}
        self.totals: dict[str, int] = {}
        self.size, self.limit = 0, KEPT_PHRASES

    def _numbers(self, raw: bytes) -> np.ndarray:
        if self.fixed:
            return np.fromiter(map(self.words.get, raw.split(), repeat(0)), np.int64)
        ids = np.fromiter(map(self.words.__getitem__, raw.split()), np.int64)
        if new := self.words.new:
            self.words.new = []
            self.hashes = np.concatenate([self.hashes, np.array([_word_hash(w) for w in new], U)])
        return ids

    def add(self, lang: str, texts: list[bytes]) -> None:
        raw = GAP.join(texts).lower().translate(_TABLE).replace(GAP, b" " + GAP + b" ")
        ids = self._numbers(raw)
        if self.k == 1:
            ids = ids[ids > 0]
            self.totals[lang] = self.totals.get(lang, 0) + len(ids)
            self._count(lang, ids[:, None])
        else:
            starts = self._starts(lang, ids)
            self._count(lang, ids[starts[:, None] + np.arange(self.k)])

    def _starts(self, lang: str, ids: np.ndarray) -> np.ndarray:
        """Where phrases of k words begin both of whose parts of k - 1 words are frequent."""
        k = self.k
        if k == 2:
            flags = self.flags.get(lang, np.zeros(0, bool))
            if len(flags) < len(self.hashes):
                more = self.known(_phrase_hash(lang, self.hashes[len(flags) :, None]))
                flags = np.r_[flags, more]
                flags[0] = False
                self.flags[lang] = flags
            good = flags[ids]
            return np.flatnonzero(good[:-1] & good[1:])
        whole = ids > 0
        for _ in range(k - 2):
            whole = whole[:-1] & whole[1:]
        at = np.flatnonzero(whole)
        good = np.zeros(len(ids) + 1, bool)
        good[at] = self.known(_phrase_hash(lang, self.hashes[ids[at[:, None] + np.arange(k - 1)]]))
        return np.flatnonzero(good[:-1] & good[1:])

    def _count(self, lang: str, phrases: np.ndarray) -> None:
        """Add the rows of phrases, each once."""
        if not len(phrases):
            return
        got = _counted(phrases, np.ones(len(phrases), np.int64))
        self.held.setdefault(lang, []).append(got)
        self.size += len(got)
        if self.size > self.limit:  # equal phrases of several chunks become one
            self.held = {x: [_counted(*(lambda a: (a[:, :-1], a[:, -1]))(np.concatenate(v)))] for x, v in self.held.items()}
            self.size = sum(len(v[0]) for v in self.held.values())
            self.limit = max(KEPT_PHRASES, 2 * self.size)

    def full(self) -> bool:
        return (not self.fixed and len(self.words) > KEPT_WORDS) or self.limit > KEPT_PHRASES

    def out(self) -> Iterator[pa.RecordBatch]:
        """(lang, phrase, n) of all that is held; for words, the languages' totals too, with a null phrase."""
        names = pa.array(list(self.words), pa.binary())
        for lang, parts in self.held.items():
            every = np.concatenate(parts)
            every = _counted(every[:, :-1], every[:, -1])
            for s in range(0, len(every), 50_000):
                part = every[s : s + 50_000]
                columns = [names.take(pa.array(part[:, j])) for j in range(self.k)]
                phrases = columns[0] if self.k == 1 else pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(part)), phrases.cast(pa.string()), pa.array(part[:, -1])], ["lang", "phrase", "n"])
        if self.totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(self.totals), pa.string()), pa.nulls(len(self.totals), pa.string()), pa.array(list(self.totals.values()), pa.int64())], ["lang", "phrase", "n"])
        self._reset()


def _counted(phrases: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The different rows of phrases and, in the last column, the sums of n."""
    packed = [phrases[:, 0]]
    for j in range(1, phrases.shape[1]):  # two words' numbers a key, each below 2^31
        packed = packed[:-1] + [packed[-1] << 31 | phrases[:, j]] if j % 2 else [*packed, phrases[:, j]]
    order = np.lexsort(packed) if len(packed) > 1 else np.argsort(packed[0], kind="stable")
    new = np.zeros(len(order), bool)
    new[:1] = True
    for p in packed:
        s = p[order]
        new[1:] |= s[1:] != s[:-1]
    first = np.flatnonzero(new)
    return np.c_[phrases[order[first]], np.add.reduceat(n[order], first)]


def _level(docs: DataFrame, k: int, known, least: int) -> DataFrame:
    """(lang, phrase, n) of the phrases of k words with n of at least ``least``, written; for words, the languages' totals with a null phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(k, known.value if known is not None else None)
        for batch in batches:
            texts: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                texts.setdefault(lang, []).append(text)
            for lang, own in texts.items():
                part, size = [], 0
                for text in own:
                    part.append(text)
                    size += len(text)
                    if size >= CHUNK:
                        counter.add(lang, part)
                        part, size = [], 0
                if part:
                    counter.add(lang, part)
                if counter.full():
                    yield from counter.out()
        yield from counter.out()
        give_back()

    counted = docs.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return written(counted.where((F.col("n") >= least) | F.col("phrase").isNull()), f"level-{k}")


def _known(level: DataFrame) -> Frequent:
    """The level's phrases as hashes, or beyond MOST_HASHES as a bitmap of a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[bytes]] = {}
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(phrase.encode())
            for lang, phrases in by.items():
                words = np.array([[_word_hash(w) for w in p.split(b" ")] for p in phrases], U)
                yield pa.RecordBatch.from_arrays([pa.array(_phrase_hash(lang, words).view(np.int64))], ["h"])

    phrases = level.where("phrase is not null").select("lang", "phrase")
    hashes = phrases.mapInArrow(run, "h long")
    own = written(phrases.select(F.explode(F.split("phrase", " ")).alias("word")).distinct(), "vocabulary")
    words = own.toArrow().column("word").cast(pa.binary()).to_pylist() if own.count() <= MOST_VOCABULARY else None
    discard(own)
    if phrases.count() <= MOST_HASHES:
        return Frequent(np.sort(hashes.toArrow().column("h").to_numpy().view(U)), words=words)
    place = F.col("h").bitwiseAND(F.lit(BITS - 1)) + 1
    rows = hashes.select(F.bitmap_bucket_number(place).alias("part"), F.bitmap_bit_position(place).alias("at")).groupBy("part").agg(F.bitmap_construct_agg("at").alias("map"))
    bitmap = np.zeros(BITS // 8, np.uint8)
    for r in rows.collect():  # 4 KB a row, 32 MB in all
        own = np.frombuffer(r["map"], np.uint8)
        bitmap[(r["part"] - 1) * len(own) : r["part"] * len(own)] = own
    return Frequent(bitmap=bitmap, words=words)


def levels(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, text_col: str = "text", lang_col: str = "lang") -> list[DataFrame]:
    """Tables (lang, phrase, n) of the phrases of 1, 2, ... words that occur ``least`` times or more.

    The first has each language's number of word occurrences too, in a row with
    a null phrase.  A pass reads all texts; it counts a phrase only where both
    phrases of one word less in it are frequent, which it looks up among the
    hashes of the level below.  What passes is counted by its words, so no
    count depends on a hash.
    """
    rows = small_batches(docs).select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    out = [_level(rows, 1, None, least)]
    for k in range(2, most_words + 1):
        bound = docs.sparkSession.sparkContext.broadcast(_known(out[-1]))
        out.append(_level(rows, k, bound, least))
        bound.destroy()
    return out


def _scored(tables: list[DataFrame]) -> DataFrame:
    """lang, phrase, a, l, r, n, score of every phrase of two words and more, by its lowest-scoring cut."""
    every = None
    for k, own in enumerate(tables, 1):
        own = own.where("phrase is not null").withColumn("words", F.lit(k))
        every = own if every is None else every.unionByName(own)
    every = written(every, "phrases")
    words = F.split("phrase", " ")
    cut = lambda k: F.struct(k.alias("k"), F.array_join(F.slice(words, F.lit(1), k), " ").alias("left"), F.array_join(F.slice(words, k + 1, F.col("words") - k), " ").alias("right"))
    cuts = every.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), F.explode(F.transform(F.sequence(F.lit(1), F.col("words") - 1), cut)).alias("c"))
    cuts = cuts.select("lang", "phrase", "a", "c.k", "c.left", "c.right")
    side = lambda name, n: every.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    totals = tables[0].where("phrase is null").select("lang", F.col("n").alias("total"))
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(15,0)")  # noqa: E731  1000 a n stays within 34 digits
    cuts = cuts.withColumn("score", F.expr("(cast(a as decimal(15,0)) * cast(total as decimal(15,0)) * cast(1000 as decimal(4,0))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))"))
    lowest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "total")).alias("c"))
    return lowest.select("lang", "phrase", "c.a", "c.l", "c.r", F.col("c.total").alias("n"), "c.score")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, most_words: int = MOST_WORDS, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's phrases of 2 to ``most_words`` words that score highest.

    A-Z count as a-z; pieces end at . , ; : ! ? and line ends, words at spaces
    and tabs.  Null text counts as empty, null language as ``und`` (together
    with documents that say so).  Repeated rows count each; other columns are
    not read; an empty table, or one without a phrase often enough, gives an
    empty result.

    A phrase goes if a longer candidate that holds it occurs as often.  It is
    enough to look one word further: of a longer phrase with equal count, the
    part of one word more around the short one occurs at least as often as the
    whole and at most as often as the short one, so equally often, and is a
    candidate too.  Counts may have 15 digits; products are decimals.
    """
    tables = levels(docs, least, most_words, text_col, lang_col)
    scored = _scored(tables)
    longer = None
    words = F.split("phrase", " ")
    for own in tables[2:]:
        ends = F.array(F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " "), F.array_join(F.slice(words, F.lit(2), F.size(words) - 1), " "))
        own = own.select("lang", F.explode(ends).alias("phrase"), F.col("n").alias("a"))
        longer = own if longer is None else longer.unionByName(own)
    left = scored if longer is None else scored.join(longer, ["lang", "phrase", "a"], "left_anti")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))  # cut to ``top`` before the shuffle too
    ranked = left.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
