"""Join operators that Spark has no single word for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interval_join(left: DataFrame, right: DataFrame, key: str, bin_ms: int = 60_000) -> DataFrame:
    """Pairs of the same key whose closed intervals (start_ms, end_ms) meet.

    Both sides are dealt by key and time bin, so one key with very many
    intervals spreads over tasks; a pair is kept in the bin where the later
    start lies, and so comes out once.  Columns of the right are prefixed r_.
    """
    bins = lambda: F.explode(F.sequence(F.floor(F.col("start_ms") / bin_ms), F.floor(F.col("end_ms") / bin_ms)))
    a = left.withColumn("__bin", bins())
    b = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns], bins().alias("__rbin"))
    met = a.join(b, (a[key] == b[f"r_{key}"]) & (a["__bin"] == b["__rbin"]))
    met = met.where(
        (F.col("end_ms") >= F.col("r_start_ms")) & (F.col("start_ms") <= F.col("r_end_ms"))
        & (F.floor(F.greatest("start_ms", "r_start_ms") / bin_ms) == F.col("__bin"))
    )
    return met.drop("__bin", "__rbin")


def argmax_overlap(tokens: DataFrame, turns: DataFrame, key: str, token_id: list[str]) -> DataFrame:
    """The turn that overlaps each token most, with its status.

    matched: at least 60 % of the token and 100 ms more than the second;
    ambiguous otherwise.  Tokens without overlap are not returned: nearest()
    serves them.  Ties go to the earlier turn.
    """
    overlap = F.least("end_ms", "r_end_ms") - F.greatest("start_ms", "r_start_ms")
    met = interval_join(tokens, turns, key).withColumn("overlap", overlap).where("overlap > 0")
    order = Window.partitionBy(*token_id).orderBy(F.desc("overlap"), "r_start_ms", "r_end_ms")
    ranked = met.select("*", F.row_number().over(order).alias("place"), F.lead("overlap").over(order).alias("second")).where("place = 1")
    second = F.coalesce("second", F.lit(0))
    share = F.col("overlap") / F.greatest(F.lit(1), F.col("end_ms") - F.col("start_ms"))
    unclear = (share < 0.6) | ((second > 0) & (F.col("overlap") - second < 100))
    return ranked.withColumn("status", F.when(unclear, "ambiguous").otherwise("matched")).drop("place")


def nearest(points: DataFrame, turns: DataFrame, key: str, point_id: list[str], point: str = "point_ms") -> DataFrame:
    """The turn nearest to each point of its key: 0 inside, else to the nearer end; ties by start, then end.

    point_id tells points apart.  Of the turns that do not hold a point, the
    nearest is the last to end before it or the first to start after it.  Both
    come from running extremes along the key's line of ends, starts and
    points, and the turns that hold it from an interval join, so a point never
    meets all turns of its key.
    """
    turn = F.struct("start_ms", "end_ms", *[c for c in turns.columns if c not in ("start_ms", "end_ms")])
    kind, own = turns.select(turn.alias("t")).schema["t"].dataType, points.columns
    who = F.struct(*[F.col(c) for c in own])

    def along(at: str, best: Column, forward: bool) -> DataFrame:
        line = turns.select(F.col(key).alias("__k"), F.col(at).alias("__at"), F.lit(0).alias("__kind"), turn.alias("__t"), F.lit(None).cast(points.select(who.alias("p")).schema["p"].dataType).alias("__p"))
        line = line.unionByName(points.select(F.col(key).alias("__k"), F.col(point).alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast(kind).alias("__t"), who.alias("__p")))
        order = Window.partitionBy("__k").orderBy(F.asc("__at") if forward else F.desc("__at"), "__kind")
        found = line.withColumn("__b", best.over(order.rowsBetween(Window.unboundedPreceding, 0)))
        return found.where("__kind = 1 and __b is not null").select("__p.*", F.col("__b.t").alias("__t"))

    last = F.max(F.when(F.col("__kind") == 0, F.struct(F.col("__t.end_ms").alias("e"), (-F.col("__t.start_ms")).alias("s"), F.col("__t").alias("t"))))
    first = F.min(F.when(F.col("__kind") == 0, F.struct(F.col("__t.start_ms").alias("s"), F.col("__t.end_ms").alias("e"), F.col("__t").alias("t"))))
    at = points.select(*own, F.col(point).alias("start_ms"), F.col(point).alias("end_ms"))
    inside = interval_join(at, turns, key).where((F.col("r_start_ms") <= F.col(point)) & (F.col(point) < F.col("r_end_ms")))
    inside = inside.select(*own, F.struct(*[F.col(f"r_{f.name}").alias(f.name) for f in kind]).alias("__t"))
    every = along("end_ms", last, True).unionByName(along("start_ms", first, False)).unionByName(inside)
    start, end = F.col("__t.start_ms"), F.col("__t.end_ms")
    away = F.when((start <= F.col(point)) & (F.col(point) < end), 0).otherwise(F.least(F.abs(F.col(point) - start), F.abs(F.col(point) - end)))
    rest = [c for c in own if c not in point_id]
    best = every.withColumn("distance", away).groupBy(*point_id).agg(F.min(F.struct("distance", F.col("__t"), *rest)).alias("b"))
    return best.select(*point_id, *[f"b.{c}" for c in rest], "b.distance", *[F.col(f"b.__t.{f.name}").alias(f"r_{f.name}") for f in kind])


#: Rows of a table of anchors that are broadcast at most; beyond, it is joined.
BROADCAST_ROWS = 1_000_000


def contains_join(docs: DataFrame, id_col: str, text: str, passages: DataFrame, passage: str, words: int = 3) -> DataFrame:
    """Pairs of a text (its id is unique) and a passage that it holds.

    Words inside a passage, not its first and last, are whole words of every
    text that holds it.  Its longest ``words`` words in a row are its anchor;
    texts meet it over the hashes of all their words in a row, in an
    equi-join that carries ids only.  Texts are joined to these hits, and
    verified.  Passages too short for an anchor are looked for in all texts,
    which is a product of these few with the texts.
    """
    run = lambda a, i: F.array_join(F.slice(a, i, F.lit(words)), " ")
    cut = passages.withColumn("__w", F.split(passage, " "))
    inner = F.transform(F.sequence(F.lit(2), F.size("__w") - words), lambda i: F.struct(F.length(run(F.col("__w"), i)).alias("n"), run(F.col("__w"), i).alias("a")))
    anchored = cut.where(F.size("__w") >= words + 2).withColumn("__a", F.xxhash64(F.array_max(inner)["a"])).drop("__w")
    grams = F.when(F.size("__t") >= words, F.transform(F.sequence(F.lit(1), F.size("__t") - words + 1), lambda i: F.xxhash64(run(F.col("__t"), i)))).otherwise(F.array().cast("array<bigint>"))
    rows = docs.select(F.col(id_col).alias("__id"), F.split(text, " ").alias("__t")).select("__id", F.explode(F.array_distinct(grams)).alias("__g"))
    side = F.broadcast(anchored) if anchored.count() <= BROADCAST_ROWS else anchored
    hits = rows.join(side, F.col("__g") == F.col("__a")).drop("__g", "__a")
    held = docs.join(hits, F.col(id_col) == F.col("__id")).drop("__id").where(F.position(F.col(passage), F.col(text)) > 0)
    short = cut.where(F.size("__w") < words + 2).drop("__w")
    if short.isEmpty():
        return held
    return held.unionByName(docs.join(short, F.position(F.col(passage), F.col(text)) > 0))


def membership_join(left: DataFrame, array: str, right: DataFrame, key: str) -> DataFrame:
    """Rows whose array holds the right side's key, as an equi-join on exploded members."""
    return left.withColumn("__member", F.explode(array)).join(right.withColumnRenamed(key, "__key"), F.col("__member") == F.col("__key")).drop("__key").withColumnRenamed("__member", key)


def context_window(hits: DataFrame, rows: DataFrame, key: str, index: str, width: int) -> DataFrame:
    """Rows of the same key within ``width`` places of a hit's first and last index, from 0 on."""
    h = hits.select(F.col(key).alias("__k"), F.col("hit_id"), F.greatest(F.lit(0), F.col("first_index") - width).alias("__lo"), (F.col("last_index") + width).alias("__hi"))
    return rows.join(h, (F.col(key) == F.col("__k")) & F.col(index).between(F.col("__lo"), F.col("__hi"))).drop("__k", "__lo", "__hi")


def head_of_line(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by order."""
    first = rows.groupBy(*key).agg(F.min(F.struct(*order, *[c for c in rows.columns if c not in (*order, *key)])).alias("r"))
    return first.select(*key, "r.*")


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by order; the upsert that the last writer wins."""
    last = rows.groupBy(*key).agg(F.max(F.struct(*order, *[c for c in rows.columns if c not in (*order, *key)])).alias("r"))
    return last.select(*key, "r.*")


def insert_once(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old and those of new whose key it lacks."""
    return old.unionByName(new.join(old.select(*key), key, "left_anti"))
