"""Vector code compression: weighted Lloyd rounds over the distinct integer parts of vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, discard, written

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Integer components are held within this bound (values of 65,536), so that squared distances are exact in 64 bits.
MOST = 1 << 24
#: Distances that a task works out at once.
CELLS = 1 << 20


def _kept(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """row, vec_id, label and the integer vector x of every row with a whole vector; row tells rows apart."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    bounded = F.transform(v, lambda x: F.floor(F.greatest(F.least(x * SCALE, F.lit(float(MOST))), F.lit(float(-MOST)))).cast("int"))
    rows = vectors.where(v.isNotNull() & finite).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("string").alias("label"), bounded.alias("x"))
    return written(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")


def _cuts(size: Column, part: Column) -> Column:
    """Where a part begins: parts are equal, or as equal as the length allows."""
    return F.floor(size * part / PARTS).cast("int")


def _parts(rows: DataFrame, *keep: str) -> DataFrame:
    """The columns named and length, part (from 0), value (the part's integers) of all parts of all rows."""
    size = F.size("x")
    each = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda p: F.struct(p.alias("part"), F.slice("x", _cuts(size, p) + 1, _cuts(size, p + 1) - _cuts(size, p)).alias("value")))
    return rows.select(*keep, size.alias("length"), F.explode(each).alias("p")).select(*keep, "length", "p.part", "p.value")


#: (length, part) -> entries, an integer matrix.
Books = dict[tuple[int, int], np.ndarray]


def _first(rows: DataFrame, entries: int) -> Books:
    """Codebooks of the smallest ids: for each length the parts of at most ``entries`` vectors.

    Ties of ids go by the vector; null ids come last.
    """
    order = (F.col("vec_id").asc_nulls_last(), F.col("x"))
    place = F.row_number().over(Window.partitionBy("length").orderBy(*order))  # taken apart before the shuffle: a task passes on no more than it may need
    first = rows.select("vec_id", "x", F.size("x").alias("length")).withColumn("place", place).where(F.col("place") <= entries)
    chosen: dict[int, list[list[int]]] = {}
    for r in first.orderBy("length", "place").select("length", "x").collect():
        chosen.setdefault(r["length"], []).append(r["x"])
    out: Books = {}
    for n, vectors in chosen.items():
        x = np.array(vectors, np.int64).reshape(len(vectors), n)
        for p in range(PARTS):
            out[n, p] = x[:, n * p // PARTS : n * (p + 1) // PARTS]
    return out


def _nearest(values: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each value, the first of equally near ones, and its squared distance."""
    code, error = np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
    step = max(1, CELLS // max(1, len(book) * max(1, book.shape[1])))
    for s in range(0, len(values), step):
        d = ((values[s : s + step, None, :] - book[None]) ** 2).sum(2)
        code[s : s + step] = d.argmin(1)
        error[s : s + step] = d[np.arange(len(d)), code[s : s + step]]
    return code, error


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(length, part, places in the batch, values) of each codebook that a batch of distinct parts needs."""
    length, part = batch.column("length").to_numpy(), batch.column("part").to_numpy()
    value = batch.column("value")
    flat, at = value.values.to_numpy(zero_copy_only=False).astype(np.int64), value.offsets.to_numpy()
    key = length.astype(np.int64) * PARTS + part
    order = np.argsort(key, kind="stable")
    edges = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]]) if len(key) else []
    for own in np.split(order, edges[1:]) if len(key) else []:
        n, p = int(length[own[0]]), int(part[own[0]])
        width = n * (p + 1) // PARTS - n * p // PARTS
        yield n, p, own, flat[at[own][:, None] + np.arange(width)]


def _round(distinct: DataFrame, books: Books) -> Books:
    """Entries replaced by the rounded-down means of the parts nearest to them; entries without parts stay.

    A task sums what it has read for each entry, so a round's shuffle has at
    most as many rows a task as the codebooks have entries.
    """
    bound = distinct.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            weight = batch.column("n").to_numpy()
            for n, p, own, values in _groups(batch):
                book = bound.value[n, p]
                count, total = sums.setdefault((n, p), (np.zeros(len(book), np.int64), np.zeros(book.shape, np.int64)))
                code, _ = _nearest(values, book)
                np.add.at(count, code, weight[own])
                np.add.at(total, code, values * weight[own][:, None])
        for (n, p), (count, total) in sums.items():
            some = np.flatnonzero(count)
            cells = [np.repeat(some, total.shape[1] + 1), np.tile(np.arange(-1, total.shape[1]), len(some)), np.c_[count, total][some].ravel()]
            head = [np.full(len(cells[0]), n), np.full(len(cells[0]), p)]
            yield pa.RecordBatch.from_arrays([*[pa.array(x.astype(np.int32)) for x in (*head, *cells[:2])], pa.array(cells[2])], ["length", "part", "entry", "place", "total"])

    cells = distinct.mapInArrow(run, "length int, part int, entry int, place int, total long")
    got = cells.groupBy("length", "part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out, counts = {k: v.copy() for k, v in books.items()}, {}
    for r in got.orderBy("length", "part", "entry", "place").collect():  # a row for each number of the codebooks; place -1, the count, comes first
        key = r["length"], r["part"], r["entry"]
        if r["place"] < 0:
            counts[key] = int(r["total"])
        else:
            out[r["length"], r["part"]][r["entry"], r["place"]] = int(r["total"]) // counts[key]
    bound.destroy()
    return out


def _coded(distinct: DataFrame, books: Books) -> DataFrame:
    """key, n, code, error of every distinct part."""
    bound = distinct.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for n, p, own, values in _groups(batch):
                code[own], error[own] = _nearest(values, bound.value[n, p])
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), pa.array(code), pa.array(error)], ["key", "n", "code", "error"])

    out = written(distinct.mapInArrow(run, "key string, n long, code int, error long"), "codes")
    bound.destroy()
    return out


def _key() -> Column:
    return F.concat_ws(",", "length", "part", F.array_join("value", ","))


def _digest(books: Books, length: int) -> str:
    numbers = (str(x) for p in range(PARTS) for x in books[length, p].ravel().tolist())
    return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, dict[int, list[np.ndarray]]]:
    """(vec_id, code, error, label_error, codebooks_sha256 of every whole vector; the codebooks of each length, by part).

    Vectors that are null or hold a null, NaN or infinite component are left
    out.  A component x becomes floor(256 x), held within 2^24 either way; a
    vector is cut into 16 parts, equal if 16 divides its length and else as
    equal as can be (empty ones have no component and no error).  Vectors of
    each length have codebooks of their own, begun with the parts of the 64
    smallest ids, fewer if there are fewer; ties of ids go by the vector, null
    ids come last.  Rows that repeat an id or a vector count and are returned
    each.  label_error sums over rows of an equal label, nulls together.
    Other columns are not read; an empty table gives an empty result.

    Equal parts of a position are one row with a weight; rounds and codes see
    only those.  Codes and errors are joined back by part: parts that many
    vectors share are broadcast (``attach``), so none gathers in one task.
    Codebooks are bounded by 64 times the length of a vector, for each
    different length.
    """
    if not 0 < entries <= 256:
        raise ValueError("codes have two hex digits: there may be 1 to 256 entries")
    rows = _kept(vectors, id_col, vector_col, label_col)
    total = rows.count()
    books = _first(rows, entries)
    distinct = written(_parts(rows).groupBy("length", "part", "value").agg(F.count("*").alias("n")).withColumn("key", _key()), "parts")
    for _ in range(rounds):
        books = _round(distinct, books)
    coded = _coded(distinct, books)
    discard(distinct)
    parts = _parts(rows, "row").select("row", "part", _key().alias("key"))
    joined = attach(parts, coded, "key", "n", total * PARTS, F.xxhash64("row", "part"))
    pairs = F.transform(F.sort_array(F.collect_list(F.struct("part", "code"))), lambda x: F.lower(F.lpad(F.hex(x["code"]), 2, "0")))  # 16 of a row
    of_row = joined.groupBy("row").agg(F.array_join(pairs, "").alias("code"), F.sum("error").alias("error"))
    digests = vectors.sparkSession.createDataFrame([(n, _digest(books, n)) for n in sorted({n for n, _ in books})], "length int, codebooks_sha256 string")
    out = rows.select("row", "vec_id", F.coalesce(F.concat(F.lit("="), "label"), F.lit("")).alias("label"), F.size("x").alias("length")).join(of_row, "row")
    out = written(out.drop("row"), "coded-vectors")
    labels = written(out.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"), F.count("*").alias("size")), "labels")
    out = attach(out, labels, "label", "size", total, F.xxhash64("vec_id", "code")).join(F.broadcast(digests), "length")
    by_length = {n: [books[n, p] for p in range(PARTS)] for n in {n for n, _ in books}}
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256"), by_length


def decompress(codes: DataFrame, codebooks: list[np.ndarray]) -> DataFrame:
    """vec_id and the vector that each code stands for: its entries' integers over 256, plus half a step."""
    flat = [[(np.asarray(e, float) / SCALE + 0.5 / SCALE).tolist() for e in book] for book in codebooks]
    bound = codes.sparkSession.sparkContext.broadcast(flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[x for p, c in enumerate(bytes.fromhex(code)) for x in bound.value[p][c]] for code in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], ["vec_id", "embedding"])

    return codes.select("vec_id", "code").mapInArrow(run, "vec_id long, embedding array<double>")


def vector_codes(vectors: DataFrame, **options) -> DataFrame:
    return compress(vectors, **options)[0]
