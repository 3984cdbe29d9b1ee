"""Near-duplicate vectors by an exact metric range join over pivot cells.

Cosine at least t between unit vectors is a Euclidean distance of at most
r = sqrt(2 - 2t).  Each vector's home is the cell of its nearest pivot; it is
copied to every other cell that could hold a vector within r.  Then each cell
finds all links of its home vectors on its own.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, components, written

THRESHOLD = 0.95
#: Home vectors of one task; larger cells are cut into such parts, each of which meets the whole cell.
PART = 4096
MOST_PIVOTS = 1024
#: Dot products nearer to the threshold than near() are done again in double precision.
NEAR = 5e-5
EDGE = 1e-7


def near(dim: int) -> float:
    """More than the error of a dot product of unit vectors in single precision, which grows with their length: each of ``dim`` terms and sums is off by 2^-24 at most."""
    return max(NEAR, (dim + 8) / 2**23)


def _vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, key, v): v the components as doubles, key a digest of them; both null for vectors that link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, values = [], []
            for x in batch.column(1).to_pylist():
                a = None
                if x and None not in x:
                    a = np.array(x, "<f8") + 0.0  # -0 is 0
                    with np.errstate(over="ignore", invalid="ignore"):
                        if not np.isfinite(a).all() or not a.any():
                            a = None
                keys.append(None if a is None else hashlib.sha1(a.tobytes()).hexdigest())
                values.append(None if a is None else a.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.string()), pa.array(values, pa.binary())], ["vec_id", "key", "v"])

    return rows.mapInArrow(run, "vec_id long, key string, v binary")


def _unit(blocks: list[bytes]) -> np.ndarray:
    a = np.frombuffer(b"".join(blocks), "<f8").reshape(len(blocks), -1)
    a = a / np.abs(a).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return a / np.sqrt((a * a).sum(1, keepdims=True))


def _homes(reps: DataFrame, pivots: dict[int, np.ndarray], radius: float) -> DataFrame:
    """(rep, size, v, dim, home, cells): cells are those besides home that the vector is copied to.

    A vector within r of x whose nearest pivot is p lies on p's side of the
    plane between p and x's home q, so x is at most r from that plane: this is
    the triangle inequality's bound for Euclidean space, never looser than
    d(x, p) <= d(x, q) + 2 r.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(2).to_pylist()
            home, cells = [0] * len(values), [None] * len(values)
            lengths = np.array([len(v) for v in values])
            for n in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == n)
                p = pivots[n // 8]
                gap = np.sqrt(np.maximum(0, 2 - 2 * p @ p.T))
                d2 = np.maximum(0, 2 - 2 * _unit([values[i] for i in own]) @ p.T)
                q = d2.argmin(1)
                at = np.arange(len(own))
                with np.errstate(divide="ignore", invalid="ignore"):
                    plane = (d2 - d2[at, q][:, None]) / (2 * gap[q])
                near = ~(plane > radius + EDGE)
                near[at, q] = False
                for j, i in enumerate(own.tolist()):
                    home[i] = int(q[j])
                    cells[i] = np.flatnonzero(near[j]).tolist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array((lengths // 8).tolist(), pa.int32()), pa.array(home, pa.int32()), pa.array(cells, pa.list_(pa.int32()))],
                ["rep", "size", "v", "dim", "home", "cells"],
            )

    return reps.select("rep", "size", "v").mapInArrow(run, "rep long, size long, v binary, dim int, home int, cells array<int>")


def _cell_links(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b, n): for b null, a has n links from this part; else a and b are linked or joined through links.

    Rows come ordered by cell part, home vectors (held, at most about PART)
    before the cell's members, which stream past in batches.  For each member
    one edge leaves, to the first home vector it is linked with; home vectors
    that one member joins are united here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, ids, unit, single, counts, root = None, [], [], None, None, None, None

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        def close() -> Iterator[pa.RecordBatch]:
            if key is None or counts is None:
                return
            tops = [ids[find(i)] for i in range(len(ids))]
            pairs = [(a, b) for a, b in zip(ids, tops, strict=True) if a != b]
            some = np.flatnonzero(counts).tolist()
            yield table([ids[i] for i in some] + [a for a, _ in pairs], [None] * len(some) + [b for _, b in pairs], [int(counts[i]) for i in some] + [0] * len(pairs))

        def table(a: list, b: list, n: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "n"])

        def meet(their: list[int], weight: np.ndarray, values: list[bytes]) -> Iterator[pa.RecordBatch]:
            nonlocal unit, single, counts, root
            if unit is None:
                unit = _unit(held)
                single, counts, root = unit.astype(np.float32), np.zeros(len(ids), np.int64), list(range(len(ids)))
            other = _unit(values)
            for s in range(0, len(other), 2048):
                block, names = other[s : s + 2048], np.array(their[s : s + 2048])
                dots = single @ block.astype(np.float32).T
                linked = dots >= threshold
                doubt = np.argwhere(np.abs(dots - threshold) < near(unit.shape[1]))
                if len(doubt):
                    i, j = doubt.T
                    linked[i, j] = (unit[i] * block[j]).sum(1) >= threshold
                i, j = np.nonzero(linked)
                other_id = names[j] != own_ids()[i]
                i, j = i[other_id], j[other_id]
                if not len(i):
                    continue
                counts += np.bincount(i, weight[s : s + 2048][j].astype(float), len(ids)).astype(np.int64)
                order = np.argsort(j, kind="stable")
                i, j = i[order], j[order]
                head = np.r_[True, j[1:] != j[:-1]]
                first = i[head]
                for x, y in np.unique(np.stack([i, np.repeat(first, np.diff(np.r_[np.flatnonzero(head), len(j)]))]), axis=1).T.tolist():
                    x, y = find(x), find(y)
                    if x != y:
                        root[max(x, y)] = min(x, y)
                yield table(names[j[head]].tolist(), [ids[x] for x in first.tolist()], [0] * int(head.sum()))

        array = None

        def own_ids() -> np.ndarray:
            nonlocal array
            if array is None:
                array = np.array(ids)
            return array

        for batch in batches:
            parts = list(zip(*[batch.column(c).to_pylist() for c in ("dim", "cell", "sub")], strict=True))
            core, rep, size, v = (batch.column(c).to_pylist() for c in ("core", "rep", "size", "v"))
            i = 0
            while i < len(parts):
                if parts[i] != key:
                    yield from close()
                    key, held, ids, unit, counts, array = parts[i], [], [], None, None, None
                j = i
                while j < len(parts) and parts[j] == key and core[j] == core[i]:
                    j += 1
                if core[i]:
                    held += v[i:j]
                    ids += rep[i:j]
                elif ids:
                    yield from meet(rep[i:j], np.array(size[i:j]), v[i:j])
                i = j
        yield from close()

    return rows.mapInArrow(run, "a long, b long, n long")


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Vectors that are null, empty, zero, or hold null or non-finite components
    link with nothing, and so do vectors of different lengths.  Equal vectors
    are linked; they go through the join once, with their number.  Rows that
    repeat an id are vectors of their own in n_links and one node in
    components; a null id takes part with its vector and gets its component.
    An empty table gives an empty result; other columns are not read.
    """
    vectors = written(_vectors(rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))), "vectors")
    total = vectors.count()
    classes = vectors.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"), F.min("v").alias("v"))
    # an id that repeats with other vectors would name two classes, so classes have numbers of their own, given once when they are written
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    radius = math.sqrt(max(0.0, 2 - 2 * threshold))
    pivots: dict[int, np.ndarray] = {}
    by_dim = classes.groupBy((F.octet_length("v") / 8).cast("int").alias("dim")).count().collect()
    for r in by_dim:
        k = max(1, min(MOST_PIVOTS, -(-r["count"] // PART)))
        chosen = classes.where(F.octet_length("v") == r["dim"] * 8).orderBy("key").limit(k).select("v").collect()
        pivots[r["dim"]] = _unit([bytes(x["v"]) for x in chosen])
    homes = written(_homes(classes.select(F.col("node").alias("rep"), "size", "v"), pivots, radius), "homes") if pivots else None
    if homes is None:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    cells = homes.groupBy("dim", "home").agg(F.count("*").alias("n"))
    cells = cells.select("dim", F.col("home").alias("cell"), F.ceil(F.col("n") / PART).cast("int").alias("subs"))
    core = homes.select("dim", F.col("home").alias("cell"), "rep", "size", "v")
    members = core.unionByName(homes.select("dim", F.explode("cells").alias("cell"), "rep", "size", "v"))
    cells = F.broadcast(cells)  # at most MOST_PIVOTS rows for each length of vectors
    home_rows = core.join(cells, ["dim", "cell"]).select("dim", "cell", F.pmod(F.xxhash64("rep"), F.col("subs")).cast("int").alias("sub"), F.lit(1).alias("core"), "rep", "size", "v")
    member_rows = members.join(cells, ["dim", "cell"]).select("dim", "cell", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"), F.lit(0).alias("core"), "rep", "size", "v")
    parts = home_rows.unionByName(member_rows).repartition("dim", "cell", "sub").sortWithinPartitions("dim", "cell", "sub", F.desc("core"))
    found = written(_cell_links(parts, threshold), "links")
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    joined = classes.join(counts, "node", "left").select("key", "node", "rep", "size", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    joined = written(joined, "counted")
    placed = attach(vectors.select("vec_id", "key"), joined.select("key", "rep", "size", "n_links"), "key", "size", total, F.col("vec_id"))
    placed = written(placed, "placed")
    names = joined.select("node", "rep").where("rep is not null")
    edges = found.where("b is not null").select("a", "b").distinct()
    edges = edges.join(names.select(F.col("node").alias("a"), F.col("rep").alias("ra")), "a").join(names.select(F.col("node").alias("b"), F.col("rep").alias("rb")), "b")
    twice = placed.where("rep is not null and vec_id <> rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    twice = twice.join(placed.groupBy(F.col("vec_id").alias("a")).count().where("count > 1").select("a"), "a", "left_semi")
    place = components(edges.select(F.col("ra").alias("a"), F.col("rb").alias("b")).unionByName(twice))
    out = placed.join(place, F.coalesce("rep", "vec_id") == F.col("node"), "left")
    component = F.coalesce("component", "rep", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
