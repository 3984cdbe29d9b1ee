"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
SEED = 7
#: Bits of the shuffled order's key.
ORDER_BITS = 60
#: Rows of a small table (a source, a part of its queue) that are broadcast at most; beyond, it is joined.
BROADCAST_ROWS = 1_000_000
#: Rows of the mix that one output partition holds on average.
PART_ROWS = 20_000
LEAST_ID = -(1 << 63)


def _key(source: Column, bucket: Column) -> Column:
    """A bucket's key; one that also joins null sources."""
    return F.concat(F.coalesce(F.concat(F.lit("s"), source), F.lit("n")), F.lit("\u0002"), bucket.cast("string"))


def _order(doc_id: Column, seed: int) -> Column:
    """The shuffled order: 60 bits of a hash of seed and id, which SQL can say too."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, ORDER_BITS // 4), 16, 10).cast("long")


def _words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _root(n: int) -> int:
    """The power of two next above the square root: as many buckets as a bucket has rows."""
    k = 1
    while k * k < n:
        k *= 2
    return k


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target) of each source; sizes has (source, source_size).

    Sources in code-point order, null last, take the weights in turn.  They
    share ``share`` times the sum of sizes; a target above ``most`` times its
    source's size stops there and its excess is shared again by weight, until
    none is above.  Sources are few (a row each), and are ranked in one
    window; resharing needs no loop: the sources that stop are those with the
    smallest most * size / weight, so a running sum over that order finds
    where the water level lies.
    """
    place = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    w = F.array(*[F.lit(float(x)) for x in weights])
    ranked = sizes.withColumn(
        "w", F.element_at(w, F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))).cast("int") + 1)
    ).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.encode("source", "utf-8"))
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / (
        F.sum("w").over(every) - F.coalesce(F.sum("w").over(below), F.lit(0.0))
    )
    # the level if all sources before this one have stopped; the first source under it fixes the level for all after
    free = ranked.withColumn("level", level).withColumn("free", F.col("cap") > F.col("level") * F.col("w"))
    fixed = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("w"), F.col("level").alias("level")))).over(every)["level"]
    return free.withColumn("fixed", fixed).select(
        "source", "source_size",
        F.when(F.col("fixed").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("fixed") * F.col("w"))).alias("target"),
    )


@dataclass
class Queue:
    """A mix that has been worked out; its tables are in the shared folder.

    rows: doc_id, source, size, source_size, target, o, cum and the extra
    columns of each row, cum counting the words of its source's queue through
    it.  places: source, e, c, size, o, i, v of the places before the cut, in
    pass e of the source's queue, c counting the words of its passes.  parts:
    k, before, words of each bucket of each source's queue.
    """

    rows: DataFrame
    places: DataFrame
    parts: DataFrame
    shift: int
    passes: int


def queue(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, share: float, most: float, seed: int, extra: list[str]) -> Queue:
    """Line up all documents, and range-sort all places of all sources by finish time up to the budget.

    Two running sums are needed, over a source's queue and over the whole
    line.  Both are taken in two steps, over ranges of the order and then
    inside a range, as many ranges as a range has rows, so that neither a
    source nor the line is ever gathered.  Ranges of a source's queue are of
    equal width in a uniform hash; those of the line are of equal width in
    finish time, in which words lie evenly because every source's target is
    reached at time 1.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), _words(F.col(text_col)).alias("size"), *extra)
    sized = written(sized.select("*", _order(F.col("doc_id"), seed).alias("o")), "sizes")
    rows = sized.count()
    buckets = _root(rows)
    shift = ORDER_BITS - (buckets.bit_length() - 1)
    sized = sized.withColumn("k", _key(F.col("source"), F.shiftright("o", shift))).withColumn("i", F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)))
    sources = written(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    goal = written(targets(sources, weights, share, most), "targets")
    by_bucket = sized.groupBy("source", F.shiftright("o", shift).alias("b"), "k").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_bucket.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    same = offsets["source"].eqNullSafe(goal["source"])
    parts = written(offsets.join(_small(goal), same).select("k", "before", "words", "source_size", "target"), "parts")
    inside = Window.partitionBy("k").orderBy("o", "i", "size").rowsBetween(Window.unboundedPreceding, 0)
    summed = sized.withColumn("run", F.sum("size").over(inside))
    lined = summed.join(parts.select("k", "before", "source_size", "target"), "k", "left").withColumn("cum", F.col("before") + F.col("run"))
    lined = written(lined.select("doc_id", "i", "source", "size", "source_size", "target", "o", "cum", *extra), "queue")
    passes = max(1, -int(-most // 1))
    turns = F.explode(F.array(*[F.lit(e) for e in range(passes)])).alias("e")
    line = lined.where("size > 0 and target > 0").select("source", "size", "o", "i", turns, "cum", "source_size", "target")
    line = line.withColumn("c", F.col("cum") + F.col("e") * F.col("source_size")).withColumn("v", F.col("c") / F.col("target"))
    width = _root(rows * passes)
    line = line.withColumn("range", F.least(F.floor(F.col("v") * width), F.lit(4 * width)).cast("long"))
    counted = line.groupBy("range").agg(F.sum("size").alias("words"))
    done = F.coalesce(F.sum("words").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    budget = goal.agg(F.sum("target")).first()[0] or 0.0
    ranges = written(counted.select("range", done.alias("done")).where(F.col("done") < F.lit(budget)), "ranges")
    order = Window.partitionBy("range").orderBy("v", F.col("source").isNull(), "source", "o", "i", "size").rowsBetween(Window.unboundedPreceding, 0)
    running = line.join(_small(ranges), "range").withColumn("through", F.col("done") + F.sum("size").over(order))
    places = running.where(F.col("through") <= F.lit(budget)).select("source", "e", "c", "size", "o", "i", "v")
    out = Queue(lined, written(places, "places"), parts, shift, passes)
    discard(sized)
    return out


def _defaults(options: dict) -> dict:
    return {"weights": WEIGHTS, "share": SHARE, "most": MOST_EPOCHS, "seed": SEED} | options


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row of docs.

    Documents of a source queue in the order of a seeded hash of their ids.  A
    document's virtual finish time is the running sum of its source's words
    divided by the source's target, and another pass of the source's whole
    queue follows for each further epoch.  The line of all sources, sorted by
    finish time, source and order, is cut where the next place would exceed
    the sum of all targets.  ``taken`` is the document's size times the number
    of its places before the cut, which are a prefix of its source's queue.

    Null or empty text has size 0 and takes nothing; a null source is a source
    and comes last; a null id comes first of equal hashes; repeated rows and
    ties of the hash are ordered by id, then by size, and rows that are equal
    in these take places in either order.  Two runs give the same rows.  An
    empty table gives an empty result.  Options: weights, share, most, seed.
    """
    line = queue(docs, id_col, text_col, source_col, extra=[], **_defaults(options))
    ends = written(line.places.groupBy("source").agg(F.max("c").alias("end")).select(F.col("source").alias("s"), "end"), "ends")
    rows = line.rows.join(_small(ends), F.col("source").eqNullSafe(F.col("s")), "left")
    taken = [F.when((F.col("size") > 0) & (F.col("cum") + e * F.col("source_size") <= F.col("end")), 1).otherwise(0) for e in range(line.passes)]
    return rows.select("doc_id", "source", "size", "source_size", F.col("target").cast("double").alias("target"), (F.col("size") * sum(taken[1:], taken[0])).cast("long").alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """docs with each row as often as the mix takes it, columns as they were, written in the order of the line.

    The places before the cut are a prefix of each source's queue, so the last
    place of each source tells of every row how often it is taken: texts are
    joined with nothing but these ends and the parts of the queues.  They are
    shuffled once, to be dealt by finish time; a row's time is read off its
    place inside its part of the queue.  Rows equal in id and size at the very
    end of a source share its last pass, one of them standing for those taken.
    Rows of size 0 take nothing and go.
    """
    options = _defaults(options)
    names = docs.columns
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{source_col}`").alias("source"))
    line = queue(own, "doc_id", "text", "source", extra=[], **options)
    last = line.places.groupBy("source").agg(F.max(F.struct("e", "o", "i", "size")).alias("z")).select(F.col("source").alias("s"), "z.*")
    last = written(last.select("s", *[F.col(c).alias(f"z_{c}") for c in ("e", "o", "i", "size")]), "last")
    at_end = F.col("source").eqNullSafe(F.col("s")) & (F.col("o") == F.col("z_o")) & (F.col("i") == F.col("z_i")) & (F.col("size") == F.col("z_size"))
    few = _small(last)
    taken = line.places.join(few, at_end & (F.col("e") == F.col("z_e"))).groupBy(F.col("s").alias("t")).agg(F.count("*").alias("taken_last"))
    there = line.rows.join(few, at_end).groupBy(F.col("s").alias("r")).agg(F.count("*").alias("rows_last"))
    ends = last.join(taken, F.col("s").eqNullSafe(F.col("t"))).join(there, F.col("s").eqNullSafe(F.col("r"))).drop("t", "r")
    ends = written(ends, "ends")
    id_, text, source = (F.col(f"`{c}`") for c in (id_col, text_col, source_col))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), source.cast("string").alias("source"), _order(id_, options["seed"]).alias("o"),
        F.coalesce(id_.cast("long"), F.lit(LEAST_ID)).alias("i"), _words(text).alias("size"),
    ).where("size > 0")
    rows = rows.join(_small(ends), F.col("source").eqNullSafe(F.col("s")))
    rows = rows.withColumn("k", _key(F.col("source"), F.shiftright("o", line.shift))).join(_small(line.parts), "k")
    inner = F.col("o").bitwiseAND(F.lit((1 << line.shift) - 1)) / F.lit(float(1 << line.shift))
    rows = rows.withColumn("v", (F.col("before") + inner * F.col("words")) / F.col("target"))
    mine, end = F.struct("o", "i", "size"), F.struct(*[F.col(f"z_{c}").alias(c) for c in ("o", "i", "size")])
    through = (mine < end) | ((mine == end) & (F.col("taken_last") == F.col("rows_last")))
    step = F.col("source_size") / F.col("target")
    whole = rows.withColumn("n", F.col("z_e") + F.when(through, 1).otherwise(0)).where("n > 0")
    whole = whole.select("__row", F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda e: F.col("v") + e * step)).alias("v"))
    shared = rows.where((mine == end) & (F.col("taken_last") < F.col("rows_last"))).groupBy("s").agg(F.first(F.struct("__row", (F.col("v") + F.col("z_e") * step).alias("v"), "taken_last")).alias("r"))
    shared = shared.select("r.__row", F.explode(F.array_repeat(F.col("r.v"), F.col("r.taken_last").cast("int"))).alias("v"))
    n, latest = line.places.agg(F.count("*"), F.max("v")).first()
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // PART_ROWS)
    part = F.least(F.floor(F.col("v") / F.lit(latest or 1.0) * parts), F.lit(parts - 1)).cast("int")
    out = whole.unionByName(shared).repartitionById(parts, part).sortWithinPartitions("v")
    return out.select(*[F.col("__row").getField(c).alias(c) for c in names])
