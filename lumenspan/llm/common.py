"""What the corpus operators share: shared-folder tables, skew-proof joins, components."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import types
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A group with at least this share of all rows is hot; there are at most 1 / HOT_SHARE such groups.
HOT_SHARE = 1 / 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Only a session of one machine (master local) may leave spark.checkpoint.dir
    unset: it gets a folder of its own.  On a cluster that is an error, as
    executors would not see such a folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            return found.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lumenspan-"))
        base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lumenspan/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: later readers neither recompute it nor depend on an executor's disk."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lumenspan_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by written() that nothing reads any more."""
    path = getattr(df, "_lumenspan_path", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Return the memory that this Python worker has freed to the system, for the tasks and operators after it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # other C libraries than glibc have none
    if trim is not None:
        trim(0)


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, for models that tasks need again."""
    home = sys.modules.setdefault("_lumenspan_worker_cache", types.ModuleType("_lumenspan_worker_cache"))
    others = [k for k in home.__dict__ if not k.startswith("__") and k != name]
    for other in others:
        del home.__dict__[other]  # a worker serves one operator at a time and keeps one's models
    if others:
        gc.collect()
        give_back()
    return home.__dict__.setdefault(name, {})


def small_batches(df: DataFrame) -> DataFrame:
    """df, its session sending Python at most 1000 rows or 8 MB at once: texts may be long, and two workers share a core's memory."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return df


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, spread: Column) -> DataFrame:
    """rows left-joined to their group's row without ever gathering a group.

    Groups of at least HOT_SHARE of all rows, at most 1 / HOT_SHARE of them,
    are broadcast.  For the other join the rows of hot groups, and rows
    without a key, carry a key of their own made from ``spread`` so that they
    stay dealt out evenly.  ``key`` is a string column of both sides.
    """
    others = [c for c in groups.columns if c != key]
    least = max(2, int(total * HOT_SHARE))
    hot = groups.where(F.col(size) >= least).select(
        F.col(key).alias("__hk"), F.struct(*others).alias("__hot")
    )
    cold = groups.where(F.col(size) < least).select(
        F.col(key).alias("__ck"), F.struct(*others).alias("__cold")
    )
    own = F.concat(F.lit("\u0001"), F.xxhash64(spread).cast("string"))
    joined = rows.join(F.broadcast(hot), F.col(key) == F.col("__hk"), "left").withColumn(
        "__jk", F.when(F.col("__hk").isNotNull() | F.col(key).isNull(), own).otherwise(F.col(key))
    )
    joined = joined.join(cold, F.col("__jk") == F.col("__ck"), "left")
    got = F.coalesce(F.col("__hot"), F.col("__cold"))
    return joined.select(*rows.columns, *[got[c].alias(c) for c in others])


#: Bits of a set of marks at most; 32 MB when it is broadcast.
MOST_BITS = 1 << 28
_LEAST_BITS = 1 << 15


def _bit(key: Column, bits: int) -> Column:
    return F.pmod(key, F.lit(bits)) + 1


def marks(keys: DataFrame, count: int) -> tuple[DataFrame, int]:
    """A bitmap of 64-bit keys (one column), as rows of 4 KB, and its number of bits.

    There are 16 bits and more for each of ``count`` keys up to MOST_BITS;
    beyond, more rows than needed are taken for marked, which costs time only:
    whoever uses a mark decides exactly afterwards.
    """
    bits = _LEAST_BITS
    while bits < 16 * count and bits < MOST_BITS:
        bits *= 2
    place = _bit(F.col(keys.columns[0]), bits)
    cut = keys.select(F.bitmap_bucket_number(place).alias("__part"), F.bitmap_bit_position(place).alias("__at")).repartition("__part")
    return cut.groupBy("__part").agg(F.bitmap_construct_agg("__at").alias("__map")), bits


def marked(rows: DataFrame, key: Column, marks_: tuple[DataFrame, int]) -> DataFrame:
    """rows with ``__hit``: whether the key's bit is set.  Rows stay where they are; the bitmap is broadcast."""
    table_, bits = marks_
    place = _bit(key, bits)
    at = F.bitmap_bit_position(place)
    return (
        rows.withColumn("__at", at).join(F.broadcast(table_), F.bitmap_bucket_number(place) == F.col("__part"), "left")
        .withColumn("__byte", F.expr("cast(conv(hex(substring(__map, cast(__at div 8 as int) + 1, 1)), 16, 10) as int)"))
        .withColumn("__hit", F.expr("coalesce((shiftright(__byte, cast(__at % 8 as int)) & 1) = 1, false)"))
        .select(*[F.col(f"`{c}`") for c in rows.columns], "__hit")
    )


def among(rows: DataFrame, key: Column, keys: DataFrame, count: int) -> DataFrame:
    """The rows whose key may be one of keys (one column): all that are, and few others."""
    return marked(rows, key, marks(keys, count)).where("__hit").drop("__hit")


def apart(rows: DataFrame, key: Column, keys: DataFrame, count: int) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is surely none of keys, the other rows): only the others need a join, so only they are shuffled."""
    told = marked(rows, key, marks(keys, count))
    return told.where(~F.col("__hit")).drop("__hit"), told.where("__hit").drop("__hit")


class Words(dict):
    """Numbers words as they are first looked up; ``new`` holds those that its owner has yet to work out."""

    def __init__(self):
        super().__init__()
        self.new = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        n = self[word] = len(self)
        return n


def crc_mod(column: Column, n: int) -> Column:
    """crc32 of a number's decimal text, modulo n."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(n))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b), component the smallest node reachable.

    Alternates the large-star and small-star steps; every step is one
    aggregation by minimum (combined before its shuffle) and one join, so a
    node with very many neighbours is never gathered.  Each round's edges are
    written to the shared folder.  Rounds end when no edge changes.
    """
    both = edges.select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    ).where("u <> v").distinct()
    current = written(both, "edges")
    seen = None
    while True:
        sides = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            sides.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        )
        large = large.distinct()
        # small star: u keeps its smallest smaller neighbour m, the others are hung under m
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(small_min, "u")
            .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        after = written(small, "edges")
        state = after.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
            F.count_distinct("u").alias("d"),
        ).first()
        discard(current)
        current = after
        if (state["n"], state["h"]) == seen:
            break
        seen = (state["n"], state["h"])
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()
