"""Language identification by unigram models over a fixed public vocabulary.

Each language has a probability for every piece of the vocabulary.  A word's
probability is the sum over all its segmentations into pieces, found by a
forward algorithm; a text's is the product over its words.  Piece
probabilities come from expectation maximisation with the same sums.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, crc_mod, small_batches, worker_cache, written

UNKNOWN = "und"
SPACE = "▁"


def _other_numbers() -> str:
    """A character class's ranges of the numbers among word characters that are not digits, such as one half or a small two."""
    found = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Nl", "No")]
    runs = []
    for c in found:
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in runs)


#: Runs of letters: characters whose Unicode category is one of L.
LETTERS = re.compile(rf"[^\W\d_{_other_numbers()}]+")
#: Documented bound: training reads at most about this many documents of each language, chosen by a hash of the id.
TRAIN_DOCUMENTS = 4_000
ROUNDS = 2
#: Words whose scores a worker keeps.
KEPT_WORDS = 120_000
#: Words of up to so many characters are summed as plain numbers, which cannot vanish; longer ones as logarithms.
PLAIN = 32
#: Numbers that a table of sums holds at most, unless one word needs more.
CELLS = 1_000_000
#: Documented bound on labelled rows: so many languages are learned, those with the most rows; all documents are predicted.
MOST_LANGUAGES = 200
#: Added to every piece's expected count, as a share of the language's total count spread over the vocabulary.
SMOOTHING = 0.01


def vocabulary(model_path: str) -> tuple[list[str], int]:
    """The model's pieces that hold letters only (after a leading space), lower case, and the longest one's length.

    Characters outside every piece are covered by one further entry, the last,
    so that each text has a segmentation.
    """
    from .sentencepiece_bpe import model

    m = model(model_path)
    found = {p.lower() for p, k in zip(m.pieces, m.kinds, strict=True) if k == 1}
    pieces = sorted(p for p in found if re.fullmatch(rf"{SPACE}?[^\W\d_]+|{SPACE}", p))
    return pieces, max(map(len, pieces))


class Scorer:
    """Forward (and backward) sums for many words at once, all languages beside each other."""

    def __init__(self, pieces: list[str], longest: int, log_p: np.ndarray | None = None):
        self.longest, self.other = longest, len(pieces)
        self.log_p = log_p  # pieces + 1, languages
        self.p = None if log_p is None else np.exp(log_p)
        self.known = Words()
        self.scores = np.zeros((0, 0 if log_p is None else log_p.shape[1]))
        # a trie of the pieces; its edges (node, character) -> node lie in an open-addressing table
        edges: dict[int, int] = {}
        piece_of = [-1]
        for i, text in enumerate(pieces):
            node = 0
            for c in text:
                key = (node << 21) | ord(c)
                node = edges.get(key, 0)
                if not node:
                    node = edges[key] = len(piece_of)
                    piece_of.append(-1)
            piece_of[node] = i
        self.piece_of = np.array(piece_of, np.int64)
        self.bits = max(4, (4 * len(edges)).bit_length())
        size = 1 << self.bits
        self.edge_key, self.edge_to = np.full(size, -1, np.int64), np.zeros(size, np.int64)
        slots = self._slot(np.array(list(edges), np.int64)).tolist()
        for (key, to), at in zip(edges.items(), slots, strict=True):
            while self.edge_key[at] >= 0:
                at = (at + 1) & (size - 1)
            self.edge_key[at], self.edge_to[at] = key, to

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The nodes that edges lead to; 0 for none."""
        keys = (node << 21) | char
        at, out, left = self._slot(keys), np.zeros(len(keys), np.int64), np.arange(len(keys))
        while len(left):
            got = self.edge_key[at]
            hit = got == keys[left]
            out[left[hit]] = self.edge_to[at[hit]]
            go = ~hit & (got >= 0)
            left, at = left[go], (at[go] + 1) & (len(self.edge_key) - 1)
        return out

    def spans(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """(word, start, end, piece) of every piece occurrence; single characters always have one.

        All positions walk the trie at once, a character a step, until none is left.
        """
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.r_[0, np.cumsum(lengths)[:-1]]
        owner = np.repeat(np.arange(len(words)), lengths)
        stop = np.repeat(begin + lengths, lengths)
        at, node, found = np.arange(len(flat)), np.zeros(len(flat), np.int64), []
        for n in range(1, self.longest + 1):
            node = self._step(node, flat[at + n - 1])
            piece = np.where(node > 0, self.piece_of[node], -1)
            if n == 1:
                piece = np.where(piece >= 0, piece, self.other)
            some = np.flatnonzero(piece >= 0)
            found.append((at[some], np.full(len(some), n), piece[some]))
            on = np.flatnonzero((node > 0) & (at + n < stop[at]))
            at, node = at[on], node[on]
            if not len(at):
                break
        place, size, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        word = owner[place]
        start = place - begin[word]
        return word, start, start + size, piece

    def parts(self, lengths: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, bool]]:
        """(words, whether as logarithms) of about equal lengths whose tables of sums have CELLS numbers at most."""
        order = np.argsort(lengths, kind="stable")
        border = int(np.searchsorted(lengths[order], PLAIN, side="right"))
        for own, logs in ((order[:border], False), (order[border:], True)):
            at = 0
            while at < len(own):
                stop = min(len(own), at + 4000)
                while stop > at + 1 and (stop - at) * (int(lengths[own[stop - 1]]) + 1) * width > CELLS:
                    stop = at + max(1, (stop - at) // 2)
                yield own[at:stop], logs
                at = stop

    def forward(self, words: list[str], spans: tuple[np.ndarray, ...], logs: bool = False) -> np.ndarray:
        """alpha[position, word, language]: all segmentations of a prefix, summed; one step for each end position."""
        word, start, end, piece = spans
        steps = max(map(len, words))
        alpha = np.full((steps + 1, len(words), self.p.shape[1]), -np.inf if logs else 0.0)
        alpha[0] = 0.0 if logs else 1.0
        order = np.lexsort((word, end))
        word, start, end, piece = word[order], start[order], end[order], piece[order]
        new = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (end[1:] != end[:-1])])
        cut, groups = np.searchsorted(end, np.arange(steps + 2)), np.searchsorted(end[new], np.arange(steps + 2))
        for j in range(1, steps + 1):
            a, b = cut[j], cut[j + 1]
            if a < b:
                heads = new[groups[j] : groups[j + 1]]
                before = alpha[start[a:b], word[a:b]]
                if logs:
                    alpha[j, word[heads]] = np.logaddexp.reduceat(before + self.log_p[piece[a:b]], heads - a, axis=0)
                else:
                    alpha[j, word[heads]] = np.add.reduceat(before * self.p[piece[a:b]], heads - a, axis=0)
        return alpha

    def score_words(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language."""
        out = np.zeros((len(words), self.p.shape[1]))
        lengths = np.array([len(w) for w in words])
        for part, logs in self.parts(lengths, self.p.shape[1]):
            chosen = [words[i] for i in part]
            whole = self.forward(chosen, self.spans(chosen), logs)[lengths[part], np.arange(len(part))]
            out[part] = whole if logs else np.log(whole)
        return out

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Summed log probabilities of each text and its number of words."""
        if len(self.known) > KEPT_WORDS:
            self.known, self.scores = Words(), self.scores[:0]
        number, counts = [], np.zeros(len(texts), np.int64)
        for t, text in enumerate(texts):
            words = LETTERS.findall(text.lower())
            counts[t] = len(words)
            number.extend(map(self.known.__getitem__, words))
        if fresh := self.known.new:
            self.known.new = []
            got = self.score_words([SPACE + w for w in fresh])
            self.scores = np.concatenate([self.scores, got]) if len(self.scores) else got
        total = np.zeros((len(texts), self.p.shape[1]))
        some = np.flatnonzero(counts)
        if len(some):
            begin = np.cumsum(counts[some]) - counts[some]
            total[some] = np.add.reduceat(self.scores[np.array(number, np.int64)], begin, axis=0)
        return total, counts

    def expected(self, words: list[str], weights: np.ndarray, language: int) -> np.ndarray:
        """Expected piece counts of weighted words under one language (forward-backward)."""
        counts = np.zeros(self.other + 1)
        lengths = np.array([len(w) for w in words])
        for part, logs in self.parts(lengths, 2):
            chosen = [words[i] for i in part]
            word, start, end, piece = self.spans(chosen)
            n, steps, all_ = lengths[part], int(lengths[part].max()), np.arange(len(part))
            p = (self.log_p if logs else self.p)[:, language]
            alpha, beta = np.full((2, len(part), steps + 1), -np.inf if logs else 0.0)
            alpha[:, 0] = beta[all_, n] = 0.0 if logs else 1.0
            by_end, by_start = np.argsort(end, kind="stable"), np.argsort(start, kind="stable")
            ends = np.searchsorted(end[by_end], np.arange(steps + 2))
            begins = np.searchsorted(start[by_start], np.arange(steps + 2))
            for j in range(1, steps + 1):
                at = by_end[ends[j] : ends[j + 1]]
                if logs:
                    np.logaddexp.at(alpha, (word[at], end[at]), alpha[word[at], start[at]] + p[piece[at]])
                else:
                    alpha[:, j] = np.bincount(word[at], alpha[word[at], start[at]] * p[piece[at]], len(part))
            for i in range(steps - 1, -1, -1):
                at = by_start[begins[i] : begins[i + 1]]
                if logs:
                    np.logaddexp.at(beta, (word[at], start[at]), beta[word[at], end[at]] + p[piece[at]])
                else:
                    beta[:, i] += np.bincount(word[at], beta[word[at], end[at]] * p[piece[at]], len(part))
            whole = alpha[all_, n]
            if logs:
                share = np.exp(alpha[word, start] + p[piece] + beta[word, end] - whole[word])
            else:
                share = alpha[word, start] * p[piece] * beta[word, end] / whole[word]
            counts += np.bincount(piece, share * weights[part][word], self.other + 1)
        return counts


def train(docs: DataFrame, model_path: str, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", train_documents: int = TRAIN_DOCUMENTS, rounds: int = ROUNDS) -> dict:
    """{"languages": [...], "log_p": pieces+1 x languages} from labelled rows.

    Rows without text or language teach nothing.  A language with more than
    ``train_documents`` rows is sampled by a hash of the id, the only bound.
    Word counts of the sample are one table; each round of expectation
    maximisation returns a row for each language and piece, at most
    languages x vocabulary, whatever the sample's size.  If there are more than
    MOST_LANGUAGES different languages, those with the most rows are learned
    (ties by name) and the rows of others teach nothing.
    """
    rows = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where(
        "lang is not null and text is not null"
    )
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()}
    languages = sorted(counts)
    if not languages:
        return {"languages": [], "log_p": np.zeros((1, 0))}
    share = F.create_map(*[F.lit(x) for k, v in counts.items() for x in (k, min(1.0, train_documents / v))])
    chosen = rows.where((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)) < share[F.col("lang")])
    pieces, longest = vocabulary(model_path)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                c = Counter()
                for t in texts:
                    c.update(LETTERS.findall(t.lower()))
                if c:
                    yield pd.DataFrame({"lang": lang, "word": list(c), "n": list(c.values())})

    words = chosen.select("lang", "text").mapInPandas(count, "lang string, word string, n long")
    words = written(words.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    place = {x: i for i, x in enumerate(languages)}
    log_p = np.full((len(pieces) + 1, len(languages)), -np.log(len(pieces) + 1))
    for _ in range(rounds):
        bound = words.sparkSession.sparkContext.broadcast(log_p)

        def expect(batches: Iterator[pd.DataFrame], bound=bound) -> Iterator[pd.DataFrame]:
            vocab, most = vocabulary(model_path)
            scorer = Scorer(vocab, most, bound.value)
            total = np.zeros((len(vocab) + 1, len(place)))
            for batch in batches:
                for lang, own in batch.groupby("lang"):
                    total[:, place[lang]] += scorer.expected([SPACE + w for w in own["word"]], own["n"].to_numpy(float), place[lang])
            piece, lang = np.nonzero(total)
            yield pd.DataFrame({"piece": piece, "lang": lang, "n": total[piece, lang]})

        got = words.mapInPandas(expect, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        bound.unpersist()
        counts_ = np.zeros_like(log_p)
        counts_[got["piece"], got["lang"]] = got["n"]
        counts_ += SMOOTHING * counts_.sum(0) / len(counts_) + 1e-9
        log_p = np.log(counts_ / counts_.sum(0))
    return {"languages": languages, "log_p": log_p}


def predict(docs: DataFrame, trained: dict, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row; nothing but the text is looked at.

    score is the language's posterior probability with equal priors.  Null
    text, text without a letter, and any text if no language was learned give
    ``und`` with score 0; equal scores go to the first language by name.
    """
    bound, token = docs.sparkSession.sparkContext.broadcast(trained), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(token, bound.value, model_path)
        for batch in batches:
            labels, scores = _judged(scorer, bound.value["languages"], [x or "" for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, trained: dict, model_path: str, least: float, text_col: str = "text") -> DataFrame:
    """The rows of docs whose language is told with a score of at least ``least``; all columns stay.

    The text is scored beside the whole row in one pass, so nothing is joined
    or shuffled; rows that repeat an id are judged each on its own.
    """
    names = docs.columns
    bound, token = docs.sparkSession.sparkContext.broadcast(trained), uuid.uuid4().hex
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(token, bound.value, model_path)
        for batch in batches:
            _, scores = _judged(scorer, bound.value["languages"], [x or "" for x in batch.column(at).to_pylist()])
            yield batch.filter(pa.array([s >= least for s in scores], pa.bool_()))

    return small_batches(docs).mapInArrow(run, docs.schema)


def _scorer(token: str, trained: dict, model_path: str) -> Scorer:
    kept = worker_cache("language_id")
    if kept.get("of") != token:
        pieces, longest = vocabulary(model_path)
        kept["of"], kept["scorer"] = token, Scorer(pieces, longest, trained["log_p"])
    return kept["scorer"]


def _judged(scorer: Scorer, names: list[str], texts: list[str]) -> tuple[list[str], list[float]]:
    """The language and the score of each text."""
    labels, scores = [], []
    for s in range(0, len(texts), 256):
        part = texts[s : s + 256]
        if not names:
            labels += [UNKNOWN] * len(part)
            scores += [0.0] * len(part)
            continue
        total, words = scorer.texts(part)
        best = total.argmax(1)
        p = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        labels += [names[b] if w else UNKNOWN for b, w in zip(best, words, strict=True)]
        scores += np.where(words > 0, p, 0.0).tolist()
    return labels, scores


def is_held_out(id_col: str = "doc_id"):
    return F.coalesce(crc_mod(F.col(id_col), 4) == 2, F.lit(False))


def identify(docs: DataFrame, model_path: str, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, learned from the rows that are not held out.

    A row is held out if crc32 of its id's text leaves 2 modulo 4; a null id
    is not.  Repeated rows get equal results; an empty table gives an empty
    one.
    """
    trained = train(docs.where(~is_held_out()), model_path, **options)
    out = predict(docs, trained, model_path)
    return out.select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score")
