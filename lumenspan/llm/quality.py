"""Quality scores: random Fourier features, ridge by summed normal equations, isotonic calibration."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, small_batches, written

FEATURES = 256
RIDGE = 1e-3
SEED = 11
THRESHOLD = 0.3
#: Equal bins of the ridge score from which calibration is fitted.
BINS = 2000

_CLASS = np.zeros(256, np.uint8)
_CLASS[list(b"abcdefghijklmnopqrstuvwxyz")] = 1
_CLASS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 2
_CLASS[list(b"0123456789")] = 3
_CLASS[list(b" \t\r\x0b\x0c")] = 4
_CLASS[10] = 5
_CLASS[list(b".,;:?'\"()-")] = 6
_CLASS[list(b"!")] = 7
_CLASS[list(b"|<>{}[]=/\\")] = 8
_CLASS[list(b"#$%&*@^~_+`")] = 9
_CLASS[128:] = 10
CLASSES = 11
STATISTICS = [
    "log_bytes", "log_words", "word_bytes", "line_bytes", *[f"class_{i}" for i in range(1, CLASSES)],
    "long_words", "short_words", "distinct_words", "distinct_lines", "top_word", "end_marks", "caps_words",
]


def statistics(texts: list[str | None]) -> np.ndarray:
    """A row of STATISTICS for each text, whole; null and empty texts have zeros.

    Character classes of all texts are counted on one flat byte array; words
    and lines are told apart by hashes of their bytes.
    """
    raw = [(t or "").encode() for t in texts]
    n = np.array([len(x) for x in raw], float)
    out = np.zeros((len(raw), len(STATISTICS)))
    out[:, 0] = np.log1p(n)
    flat = np.frombuffer(b"".join(raw), np.uint8)
    if len(flat):
        owner_start = np.r_[0, np.cumsum([len(x) for x in raw])]
        kinds = _CLASS[flat]
        some = np.flatnonzero(n > 0)
        for c in range(1, CLASSES):
            sums = np.add.reduceat((kinds == c).astype(np.int64), owner_start[some])
            out[some, 3 + c] = sums / n[some]
    for i, x in enumerate(raw):
        words = x.split()
        if not words:
            continue
        k = len(words)
        lengths = np.fromiter(map(len, words), np.int64, k)
        lines = [y for y in x.split(b"\n") if y.strip()]
        distinct = Counter(words)
        out[i, 1] = np.log1p(k)
        out[i, 2] = lengths.mean()
        out[i, 3] = np.log1p(n[i] / len(lines))
        j = 3 + CLASSES
        out[i, j] = (lengths > 12).mean()
        out[i, j + 1] = (lengths < 3).mean()
        out[i, j + 2] = len(distinct) / k**0.8
        out[i, j + 3] = len(set(lines)) / len(lines)
        out[i, j + 4] = max(distinct.values()) / k
        out[i, j + 5] = x.count(b". ") / k + x.count(b".\n") / k
        out[i, j + 6] = sum(map(bytes.isupper, words)) / k
    return out


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its statistics as an array; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            parts = [statistics(texts[s : s + 512]) for s in range(0, len(texts), 512)]
            values = np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(values.astype(np.float32)), pa.list_(pa.float32()))], ["doc_id", "x"])

    return small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, x array<float>")


def _projection(dim: int, features: int, seed: int, gamma: float) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.normal(0, np.sqrt(2 * gamma), (dim, features)), rng.uniform(0, 2 * np.pi, features)


def _mapped(x: np.ndarray, model: dict) -> np.ndarray:
    """Random Fourier features of standardised statistics, with a constant and the statistics themselves."""
    z = np.clip((x - model["mean"]) / model["std"], -6, 6)
    w, b = _projection(z.shape[1], model["features"], model["seed"], model["gamma"])
    return np.concatenate([np.sqrt(2 / model["features"]) * np.cos(z @ w + b), z, np.ones((len(z), 1))], axis=1)


def isotonic(mean: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing fit of weighted means (pool adjacent violators)."""
    values, weights, sizes = [], [], []
    for m, w in zip(mean.tolist(), weight.tolist(), strict=True):
        values.append(m)
        weights.append(w)
        sizes.append(1)
        while len(values) > 1 and values[-2] >= values[-1]:
            m2, w2, s2 = values.pop(), weights.pop(), sizes.pop()
            values[-1] = (values[-1] * weights[-1] + m2 * w2) / (weights[-1] + w2)
            weights[-1] += w2
            sizes[-1] += s2
    return np.repeat(values, sizes)


def train(stats: DataFrame, labels: DataFrame, features: int = FEATURES, ridge: float = RIDGE, seed: int = SEED) -> dict:
    """A model from statistics and (doc_id, y) with y 0 or 1; every labelled row counts.

    The labelled rows' means and deviations are one aggregation.  Each
    partition sums its normal equations; partial sums are added in groups
    before the few that are left reach the driver, so what it gets does not
    grow with the input.  Calibration is fitted on counts of BINS bins of the
    score.  Without a labelled row the model is None.
    """
    dim = len(STATISTICS)
    rows = written(stats.join(labels, "doc_id"), "labelled")
    first = rows.select(F.count("*").alias("n"), *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(dim)], *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(dim)]).first()
    if not first["n"]:
        return None
    model = {
        "mean": np.array([first[f"m{i}"] for i in range(dim)]), "std": np.array([max(first[f"s{i}"] or 0.0, 1e-6) for i in range(dim)]),
        "features": features, "seed": seed, "gamma": 0.5 / dim,
    }
    size = features + dim + 1

    def normal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b, n = np.zeros((size, size)), np.zeros(size), 0
        for batch in batches:
            z, y = _mapped(np.stack(batch["x"]).astype(float), model), batch["y"].to_numpy(float)
            a, b, n = a + z.T @ z, b + z.T @ y, n + len(y)
        if n:
            yield pd.DataFrame({"a": [a.tobytes()], "b": [b.tobytes()], "n": [n]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b, n = np.zeros(size * size), np.zeros(size), 0
        for batch in batches:
            for x, y, k in zip(batch["a"], batch["b"], batch["n"], strict=True):
                a, b, n = a + np.frombuffer(x), b + np.frombuffer(y), n + k
        if n:
            yield pd.DataFrame({"a": [a.tobytes()], "b": [b.tobytes()], "n": [n]})

    kind = "a binary, b binary, n long"
    sums, count = rows.mapInPandas(normal, kind), rows.rdd.getNumPartitions()
    while count > FAN_IN:  # a tree: no task adds more than about FAN_IN sums, however many partitions there are
        count = -(-count // FAN_IN)
        sums = sums.repartition(count).mapInPandas(add, kind)
    parts = sums.collect()
    a = sum(np.frombuffer(r["a"]) for r in parts).reshape(size, size)
    b, n = sum(np.frombuffer(r["b"]) for r in parts), sum(r["n"] for r in parts)
    model["beta"] = np.linalg.solve(a + ridge * n * np.diag(np.r_[np.ones(size - 1), 1e-6]), b)

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"bin": _bin(_mapped(np.stack(batch["x"]).astype(float), model) @ model["beta"]), "y": batch["y"].to_numpy(float)})

    bins = rows.mapInPandas(binned, "bin long, y double").groupBy("bin").agg(F.count("*").alias("n"), F.avg("y").alias("y")).toPandas().sort_values("bin")
    model["bins"] = bins["bin"].to_numpy()
    model["fit"] = isotonic(bins["y"].to_numpy(), bins["n"].to_numpy(float))
    return model


#: Partial sums that one task adds, and that the driver gets.
FAN_IN = 32


def _bin(score: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((score + 0.5) * BINS / 2), 0, BINS - 1).astype(np.int64)


def scores(x: np.ndarray, model: dict | None) -> tuple[np.ndarray, np.ndarray]:
    """(calibrated scores in [0, 1], ridge scores); 0.5 and 0 without a model.

    The calibrated score is the isotonic fit, whose steps are joined by straight
    lines between their bins; the ridge score keeps texts of one step in order.
    """
    if model is None:
        return np.full(len(x), 0.5), np.zeros(len(x))
    raw = _mapped(x.astype(float), model) @ model["beta"]
    return np.clip(np.interp((raw + 0.5) * BINS / 2, model["bins"] + 0.5, model["fit"]), 0.0, 1.0), raw


def is_held_out(id_col: str = "doc_id"):
    return F.coalesce(crc_mod(F.col(id_col), 5) == 0, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted, ridge_score of every row of docs.

    Labels of held-out documents, null labels and labels of no document teach
    nothing; of a document labelled more than once each label counts.  Null
    text counts as empty, and empty texts are scored too.  With no label at
    all every score is 0.5.  Statistics of all rows are made once and written;
    labels are joined to them by id, without texts.
    """
    stats = written(document_statistics(docs), "statistics")
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).where("y is not null and doc_id is not null")
    model = train(stats, own.where(~is_held_out()))
    bound = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).flatten().to_numpy(zero_copy_only=False)).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(s, pa.float64()) for s in scores(x, bound.value)]], ["doc_id", "score", "ridge_score"])

    out = stats.mapInArrow(run, "doc_id long, score double, ridge_score double")
    return out.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "ridge_score")
