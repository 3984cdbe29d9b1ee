"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

A text's symbols lie in flat numpy arrays.  In every round each word finds
its smallest pair rank, all leftmost non-overlapping pairs of that rank merge
at once, and the arrays are compacted, until no word has a pair left.  Only
the model file is read; the sentencepiece library itself is not used.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, small_batches, worker_cache

SPACE = "▁"
NO_RANK = np.iinfo(np.int64).max
#: Words and ids that a worker keeps; its store is emptied beyond either.
KEPT_WORDS = 150_000
KEPT_IDS = 2_000_000


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protobuf message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + n]
            at += n


class Model:
    """A BPE model with identity normalisation, a dummy prefix and byte fallback."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        pieces, scores, kinds = [], [], []
        for number, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, 1
                for k, v in _fields(value):
                    if k == 1:
                        piece = v.decode()
                    elif k == 2:
                        score = float(np.frombuffer(v, "<f4")[0])
                    elif k == 3:
                        kind = v
                pieces.append(piece)
                scores.append(score)
                kinds.append(kind)
            elif number == 3:
                spec = dict(_fields(value))
                if spec.get(2) or spec.get(4, 1) or not spec.get(3, 1):
                    raise ValueError("only models with identity normalisation and a dummy prefix are supported")
        self.pieces, self.kinds = pieces, kinds
        normal = {p: i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == 1}
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("pieces may not hold a space after another character")
        #: rank by falling score; equal scores share a rank, and the leftmost pair then goes first
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in normal.values()}, reverse=True))}
        self.rank = np.full(len(pieces) + 1, NO_RANK, np.int64)
        for i in normal.values():
            self.rank[i] = order[scores[i]]
        #: symbols are piece ids; a character that is no piece has the id UNKNOWN + code point
        self.unknown = len(pieces)
        symbol = lambda s: normal.get(s, self.unknown + ord(s) if len(s) == 1 else -1)
        pairs = {}
        for p, i in normal.items():
            for cut in range(1, len(p)):
                a, b = symbol(p[:cut]), symbol(p[cut:])
                if a >= 0 and b >= 0:
                    pairs[(a << 32) | b] = i
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ids = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        # open addressing with a multiplicative hash: few probes, no binary search
        self.bits = 20
        size = 1 << self.bits
        self.table_key, self.table_id = np.full(size, -1, np.int64), np.zeros(size, np.int64)
        slots = self._slot(self.pair_keys)
        self.probes = 1
        for key, value, s in zip(self.pair_keys.tolist(), self.pair_ids.tolist(), slots.tolist(), strict=True):
            n = 1
            while self.table_key[s] >= 0:
                s, n = (s + 1) & (size - 1), n + 1
            self.table_key[s], self.table_id[s] = key, value
            self.probes = max(self.probes, n)
        self.byte = np.zeros(256, np.int64)
        for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)):
            if k == 6:
                self.byte[int(p[3:5], 16)] = i
        self.symbol = np.arange(0x110000, dtype=np.int64) + self.unknown
        for p, i in normal.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        surface = [
            bytes([int(p[3:5], 16)]) if k == 6 else " ⁇ ".encode() if k == 2 else b"" if k == 3 else p.replace(SPACE, " ").encode()
            for p, k in zip(pieces, kinds, strict=True)
        ]
        self.surface = surface
        self.surface_flat, self.surface_at = _ragged(surface)
        self.digits_flat, self.digits_at = _ragged([b"%d," % i for i in range(len(pieces))])
        self._reset()

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _reset(self) -> None:
        self.words = Words()
        self.flat, self.at = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols makes; -1 for none."""
        keys = (a << 32) | b
        slot = self._slot(keys)
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for _ in range(self.probes):
            got = self.table_key[slot]
            hit = got == keys[left]
            out[left[hit]] = self.table_id[slot[hit]]
            go = ~hit & (got >= 0)
            if not go.any():
                break
            left, slot = left[go], (slot[go] + 1) & (len(self.table_key) - 1)
        return out

    def merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over words; word is the ascending word number of each symbol.

        One round merges all pairs of a word's smallest rank, as the library
        would one after another, unless a merge makes a pair of smaller or
        equal rank beside it, which the library would take before the next:
        then that word merges its leftmost pair alone.
        """
        final_s, final_w = [], []
        order = np.arange(len(symbols))  # place in the input, so that finished words can be put back in order
        final_o = []
        same = word[1:] == word[:-1]
        pair = np.where(same, self.merged(symbols[:-1], symbols[1:]), -1) if len(symbols) > 1 else np.zeros(0, np.int64)
        while len(symbols) > 1:
            rank = np.where(pair >= 0, self.rank[pair], NO_RANK)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lengths = np.diff(np.r_[starts, len(symbols)])
            least = np.minimum.reduceat(np.r_[rank, NO_RANK], starts)
            # the last symbol of a word faces the next word: its pair is -1 already
            live = least < NO_RANK
            keep = np.repeat(live, lengths)
            if not live.all():
                final_s.append(symbols[~keep])
                final_w.append(word[~keep])
                final_o.append(order[~keep])
                if not live.any():
                    symbols = symbols[:0]
                    break
                whole = np.r_[pair, -1][keep]
                symbols, word, order = symbols[keep], word[keep], order[keep]
                pair = whole[:-1]
                rank = np.where(pair >= 0, self.rank[pair], NO_RANK)
                lengths, least = lengths[live], least[live]
                starts = np.r_[0, np.cumsum(lengths)[:-1]]
            goal = np.repeat(least, lengths)[:-1]
            hit = rank == goal
            # of overlapping hits every other one, from the left of each run of neighbours
            at = np.flatnonzero(hit)
            new = np.r_[True, np.diff(at) != 1]
            first = np.maximum.accumulate(np.where(new, at, 0))
            at = at[(at - first) % 2 == 0]
            made = pair[at]
            # neighbours after the round's merges
            drop = np.zeros(len(symbols), bool)
            drop[at + 1] = True
            next_symbols = symbols.copy()
            next_symbols[at] = made
            kept = np.flatnonzero(~drop)
            s, w = next_symbols[kept], word[kept]
            fresh = np.zeros(len(symbols), bool)
            fresh[at] = True
            fresh = fresh[kept]
            touched = fresh[:-1] | fresh[1:]
            q = np.r_[pair, -1][kept][:-1]
            # a pair keeps its piece unless one of its symbols is new
            t = np.flatnonzero(touched)
            q[t] = np.where(w[t] == w[t + 1], self.merged(s[t], s[t + 1]), -1)
            early = t[(q[t] >= 0)]
            if len(early):
                number = np.cumsum(np.r_[0, w[1:] != w[:-1]])
                many = np.bincount(number[np.flatnonzero(fresh)], minlength=len(starts)) > 1
                bad = early[(self.rank[q[early]] <= least[number[early]]) & many[number[early]]]
                if len(bad):
                    alone = np.zeros(len(starts), bool)
                    alone[number[bad]] = True
                    num = np.cumsum(np.r_[0, word[1:] != word[:-1]])
                    first_of = np.r_[True, num[at][1:] != num[at][:-1]]
                    at = at[first_of | ~alone[num[at]]]
                    drop = np.zeros(len(symbols), bool)
                    drop[at + 1] = True
                    next_symbols = symbols.copy()
                    next_symbols[at] = pair[at]
                    kept = np.flatnonzero(~drop)
                    s, w = next_symbols[kept], word[kept]
                    q = np.where(w[:-1] == w[1:], self.merged(s[:-1], s[1:]), -1)
            symbols, word, order, pair = s, w, order[kept], q
        if len(symbols):
            final_s.append(symbols)
            final_w.append(word)
            final_o.append(order)
        if not final_s:
            return symbols, word
        back = np.argsort(np.concatenate(final_o), kind="stable")
        return np.concatenate(final_s)[back], np.concatenate(final_w)[back]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of words and where each word's ids begin (one more at the end)."""
        flat = "".join(words)
        points = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), "<u4")
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbols, word = self.merge(self.symbol[points], np.repeat(np.arange(len(words)), lengths))
        odd = np.flatnonzero(symbols >= self.unknown)
        if len(odd):  # characters that are no piece become their bytes
            count = np.ones(len(symbols), np.int64)
            raw = [chr(x).encode("utf-8", "surrogatepass") for x in (symbols[odd] - self.unknown).tolist()]
            count[odd] = [len(x) for x in raw]
            place = np.cumsum(count) - count
            out = np.repeat(symbols, count)
            joined = np.frombuffer(b"".join(raw), np.uint8)
            own, _ = _spans(place[odd], count[odd])
            out[own] = self.byte[joined]
            word = np.repeat(word, count)
            symbols = out
        return symbols, np.r_[0, np.cumsum(np.bincount(word, minlength=len(words)))]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of texts and where each text's ids begin (one more at the end)."""
        if len(self.words) > KEPT_WORDS or len(self.flat) > KEPT_IDS:
            self._reset()
        number, counts = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                words = WORD.findall(SPACE + text.replace(" ", SPACE))
                counts[i] = len(words)
                number.extend(map(self.words.__getitem__, words))
        if new := self.words.new:
            flat, at = self.encode_words(new)
            self.at = np.concatenate([self.at[:-1], at + len(self.flat)])
            self.flat = np.concatenate([self.flat, flat])
            self.words.new = []
        numbers = np.array(number, np.int64)
        lengths = self.at[numbers + 1] - self.at[numbers]
        index, begin = _spans(self.at[numbers], lengths)
        return self.flat[index], begin[np.r_[0, np.cumsum(counts)]]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters, one for each byte."""
        index, _ = _spans(self.surface_at[ids], self.surface_at[ids + 1] - self.surface_at[ids])
        raw = self.surface_flat[index].tobytes()
        if len(ids) and self.pieces[int(ids[0])].startswith(SPACE) and self.kinds[int(ids[0])] == 1:
            raw = raw[1:]  # the dummy prefix
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace")

    def digits(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by commas."""
        index, _ = _spans(self.digits_at[ids], self.digits_at[ids + 1] - self.digits_at[ids])
        return self.digits_flat[index].tobytes()[:-1]


#: Spaces and the run of other characters after them.
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def _ragged(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(parts), np.uint8), np.r_[0, np.cumsum([len(x) for x in parts])]


def _spans(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The indices start, start + 1, ... of all spans in turn, and where each span's indices begin."""
    begin = np.r_[0, np.cumsum(lengths)]
    return np.arange(begin[-1]) + np.repeat(starts - begin[:-1], lengths), begin


def model(path: str) -> Model:
    """The model at path, read once in each Python worker."""
    kept = worker_cache("sentencepiece")
    if path not in kept:
        kept[path] = Model(path)
    return kept[path]


#: Characters of text encoded in one go.
CHUNK = 1 << 19


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t)
        if n >= CHUNK:
            yield part
            part, n = [], 0
    if part:
        yield part


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, keep: list[str] | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded, and the columns named in keep) of each row.

    Whole texts are encoded; null counts as empty, which has no ids.  Rows are
    independent: repeated rows give repeated results, and columns other than
    the two named are not read.  No shuffle.  model_path must be readable on
    every executor.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")
    keep = keep or []
    schema += "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            n, a, b, all_ids, all_texts = [], [], [], [], []
            for part in _chunks(texts):
                flat, at = m.encode(part)
                for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    ids = flat[s:e]
                    decoded = m.decode(ids)
                    n.append(e - s)
                    a.append(hashlib.sha256(m.digits(ids)).hexdigest())
                    b.append(hashlib.sha256(decoded.encode()).hexdigest())
                    if with_ids:
                        all_ids.append(ids.astype(np.int32))
                        all_texts.append(decoded)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_texts, pa.string())]
                names += ["ids", "decoded"]
            columns += [batch.column(2 + i) for i in range(len(keep))]
            names += keep
            yield pa.RecordBatch.from_arrays(columns, names)

    return small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)
