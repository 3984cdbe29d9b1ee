"""Structured Streaming forms of the keyed state operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PROJECTED = "key string, status string, version long, updates long"


def project_first_terminal(events: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """(key, status, version, updates) of each key after a batch.

    events has key, status, version.  A later version replaces an earlier one
    until the status is terminal; then nothing changes it, in whatever order
    or however often events come.  An ended key's state is dropped ``keep_ms``
    after its last event; without that it is kept.
    """
    ends = {"succeeded", "failed", "cancelled"}

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        status, version, n = state.get if state.exists else (None, -1, 0)
        for part in parts:
            for s, v in sorted(zip(part["status"], part["version"], strict=True), key=lambda r: r[1]):
                if status not in ends and v > version:
                    status, version, n = s, int(v), n + 1
        state.update((status, version, n))
        if keep_ms is not None and status in ends:
            state.setTimeoutDuration(keep_ms)
        yield pd.DataFrame({"key": [key[0]], "status": [status], "version": [version], "updates": [n]})

    timeout = GroupStateTimeout.NoTimeout if keep_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return events.groupBy("key").applyInPandasWithState(update, PROJECTED, "status string, version long, updates long", "update", timeout)


def text_batches(deltas: DataFrame, most_chars: int = 500, wait_ms: int = 500) -> DataFrame:
    """(key, text) of a key's deltas joined until they reach ``most_chars``.

    What is left waits in state; it comes out when no more has come for
    ``wait_ms``, or at once with a delta whose column ``last`` is true, where
    there is one.
    """
    ends = "last" in deltas.columns

    def flush(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, out, last = (state.get[0] if state.exists else ""), [], state.hasTimedOut
        for part in () if last else parts:
            part = part.sort_values("sequence")
            for text in part["text"]:
                held += text or ""
                if len(held) >= most_chars:
                    out.append(held)
                    held = ""
            last = last or ends and bool(part["last"].fillna(False).any())
        if last:
            if held:
                out.append(held)
            if state.exists:
                state.remove()
        else:
            state.update((held,))
            if held:
                state.setTimeoutDuration(wait_ms)
        if out:
            yield pd.DataFrame({"key": [key[0]] * len(out), "text": out})

    return deltas.groupBy("key").applyInPandasWithState(flush, "key string, text string", "held string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def windowed_counts(events: DataFrame, late: str = "1 day", width: str = "1 hour") -> DataFrame:
    """Events of each type in event-time windows; ours, with a watermark and each id once."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def route_failures(batch: DataFrame, most: int = 20) -> tuple[DataFrame, DataFrame]:
    """Events to try again, with one attempt more, and those for the dead-letter topic."""
    again = batch.withColumn("attempt", F.col("attempt") + 1)
    return again.where(F.col("attempt") < most), again.where(F.col("attempt") >= most)


def kafka_source(spark, servers: str, topic: str) -> DataFrame:
    """A topic from its beginning; needs the Kafka connector on the cluster."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load()


def kafka_sink(events: DataFrame, servers: str, topic: str, checkpoint: str):
    """Keyed publication of (key, value); needs the Kafka connector on the cluster."""
    return events.select(F.col("key").cast("string"), F.col("value").cast("string")).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint)
