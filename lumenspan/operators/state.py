"""Mutable state as data: outbox, merges that keep the first write, transitions, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Retry limits.
MOST_ATTEMPTS, MOST_BACKOFF_S = 20, 300

#: The topics of commands, events, cancellations, retries and dead letters.
TOPICS = (
    "processing.commands", "processing.events", "processing.cancel", "processing.cancel.retry", "processing.cancel.dlq", "processing.retry", "processing.dlq",
    "compute.tasks.io", "compute.tasks.cpu", "compute.tasks.gpu-high", "compute.tasks.gpu-normal", "compute.results", "compute.cancel", "compute.cancel.retry",
    "compute.cancel.dlq", "compute.retry", "compute.dlq", "generation.commands", "generation.cancel", "generation.cancel.retry", "generation.cancel.dlq",
    "generation.retry", "generation.dlq", "rag.execution-events", "model.invocation-events", "observability.dlq", "observability.retry",
)


def backoff_seconds(attempts: Column) -> Column:
    return F.least(F.lit(MOST_BACKOFF_S), F.pow(F.lit(2), F.least(attempts, F.lit(8)))).cast("long")


def claim(outbox: DataFrame, batch: int) -> DataFrame:
    """The oldest pending event of each aggregate, oldest first, at most ``batch``."""
    from .joins import head_of_line

    pending = outbox.where("not published and not exhausted")
    return head_of_line(pending, ["aggregate_id"], ["created_at", "event_id"]).orderBy("created_at", "event_id").limit(batch)


def fail(outbox: DataFrame, most: int = MOST_ATTEMPTS) -> DataFrame:
    """attempt_count, delay_seconds, exhausted, route after a failed publication."""
    again = F.col("attempt_count") + 1
    return outbox.select(
        "event_id", again.alias("attempt_count"), backoff_seconds(F.col("attempt_count")).alias("delay_seconds"),
        (again >= most).alias("exhausted"), F.when(again >= most, "dead_letter").otherwise("retry").alias("route"),
    )


def first_write_merge(events: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """For each key and field the first value that is not null, in order; the first end state stays."""
    # min over (order, value) of non-null values: combined before the shuffle, unlike an ordered collection
    pick = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(order, c)))[c].alias(c)
    return events.groupBy(key).agg(*[pick(c) for c in fields])


def terminal_fence(events: DataFrame, key: str, version: str, ident: str) -> DataFrame:
    """The newest version of each key; a repeated id and an older version change nothing."""
    return events.groupBy(key).agg(F.max(F.struct(version, ident)).alias("r"), F.count_distinct(ident).alias("ids")).select(key, f"r.{version}", f"r.{ident}", "ids")


def transition(rows: DataFrame, status: str, revision: str, expected: Column, allowed: dict[str, str]) -> DataFrame:
    """Rows with new_status and accepted: a state moves to its successor if the expected revision is the row's."""
    steps = F.create_map(*[F.lit(x) for pair in allowed.items() for x in pair])
    ok = (F.col(revision) == expected) & steps[F.col(status)].isNotNull()
    return rows.withColumn("accepted", F.coalesce(ok, F.lit(False))).withColumn("new_status", F.when(F.col("accepted"), steps[F.col(status)]).otherwise(F.col(status)))


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """All children of the parents in new are those of new; others stay."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def reindex(rows: DataFrame, existing: DataFrame, key: str, hash_: Column, force: bool = False) -> DataFrame:
    """Rows whose content hash is new or changed."""
    old = existing.select(key, F.col("content_hash").alias("__old"))
    joined = rows.withColumn("content_hash", hash_).join(old, key, "left")
    return joined.where(F.lit(force) | ~F.col("content_hash").eqNullSafe(F.col("__old"))).drop("__old")


def violations(rules: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """(rule, n): how many rows break each rule."""
    counts = [df.where(~F.coalesce(rule, F.lit(True))).agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n") for name, (df, rule) in rules.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def replace_pruned(old: DataFrame, new: DataFrame, vectors: DataFrame, parent: str, ordinal: str) -> tuple[DataFrame, DataFrame]:
    """(rows, vectors) after the parents in new got their rows: ordinals not in new go, and vectors whose hash is stale with them.

    rows have parent, ordinal, content_hash; vectors have the same.
    """
    rows = replace_children(old, new, parent)
    return rows, vectors.join(rows, [parent, ordinal, "content_hash"], "left_semi")


def leased(outbox: DataFrame, now: Column) -> DataFrame:
    """The oldest pending event of each aggregate, unless a lease on it still runs; younger ones wait for it."""
    from .joins import head_of_line

    return head_of_line(outbox.where("not published and not exhausted"), ["aggregate_id"], ["created_at", "event_id"]).where(F.col("lease_until").isNull() | (F.col("lease_until") <= now))


def fenced(events: DataFrame, key: str, version: str, terminal: Column) -> DataFrame:
    """The state of each key: its first terminal event, else its newest; what comes after a terminal one changes nothing."""
    row = F.struct(version, *[c for c in events.columns if c not in (key, version)])
    ends = events.groupBy(key).agg(F.min(F.when(terminal, row)).alias("first"), F.max(row).alias("last"))
    return ends.select(key, F.coalesce("first", "last").alias("r"), F.col("first").isNotNull().alias("terminal")).select(key, "r.*", "terminal")


def cancelled_on_arrival(tasks: DataFrame, cancels: DataFrame, scope: str, order: str) -> DataFrame:
    """tasks with ``cancelled``: whether their scope was cancelled before they came."""
    first = cancels.groupBy(scope).agg(F.min(order).alias("__at"))
    return tasks.join(first, scope, "left").withColumn("cancelled", F.coalesce(F.col(order) > F.col("__at"), F.lit(False))).drop("__at")


def expire(states: DataFrame, ended: str, now: Column, seconds: int) -> DataFrame:
    """States without those whose end is ``seconds`` past; states that have not ended stay."""
    return states.where(F.col(ended).isNull() | (now < F.timestamp_add("SECOND", F.lit(seconds), F.col(ended))))
