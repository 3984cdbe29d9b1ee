"""Aligned tokens: their text as it was written, the turn they belong to, and turns put together from them."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import whole_keys
from .joins import argmax_overlap, interval_join, nearest


@cache
def _spoken(c: str) -> str:
    """What of a character is spoken: its letters and digits in compatibility form and lower case."""
    return "".join(x for x in unicodedata.normalize("NFKC", c).lower() if x.isalnum())


def restored(text: str | None, tokens: list[str]) -> list[str]:
    """The tokens with everything that stands between them in the text: each has what follows it, the first also what comes before.

    Tokens are looked for in turn among the text's spoken characters; the place
    of each such character in the text is kept beside it.  If one of them isn't
    found, or speaks nothing, all stay as they are.
    """
    if not tokens:
        return []
    line, place = [], []
    for i, c in enumerate(text or ""):
        said = _spoken(c)
        line.append(said)
        place += [i] * len(said)
    spoken, at, begins = "".join(line), 0, []
    for token in tokens:
        own = "".join(map(_spoken, token or ""))
        found = spoken.find(own, at) if own else -1
        if found < 0:
            return list(tokens)
        begins.append(place[found])
        at = found + len(own)
    cuts = [0, *begins[1:], len(text or "")]
    return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def restore_texts(tokens: DataFrame, windows: DataFrame) -> DataFrame:
    """recording_id, window_index, token_index, text, restored of every token.

    tokens has recording_id, window_index, token_index and text, windows the
    text of each (recording_id, window_index).  Windows are independent, so
    they are dealt by both: a long recording spreads over tasks.  The stream
    brings a window's text and then its tokens; a task holds one window beside
    a batch.  Tokens of no window, or of one whose text is null, stay as they
    are.
    """
    key = F.concat_ws(":", "recording_id", "window_index").alias("key")
    heads = windows.select(key, F.lit(-1).cast("long").alias("token_index"), "recording_id", "window_index", "text")
    rows = heads.unionByName(tokens.select(key, F.col("token_index").cast("long").alias("token_index"), "recording_id", "window_index", "text"))
    schema = f"recording_id {tokens.schema['recording_id'].dataType.simpleString()}, window_index {tokens.schema['window_index'].dataType.simpleString()}, token_index long, text string, restored string"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, index, recording, window, text), begin in whole_keys(batches):
            keep, out = index >= 0, []
            for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(index)], strict=True):
                whole = text[a] if index[a] < 0 else None
                own = text[a + (index[a] < 0) : b].tolist()
                out += own if whole is None else restored(whole, own)
            yield pa.RecordBatch.from_arrays([pa.array(recording[keep]), pa.array(window[keep]), pa.array(index[keep]), pa.array(text[keep], pa.string()), pa.array(out, pa.string())], names)

    return rows.repartition("key").sortWithinPartitions("key", "token_index").mapInArrow(run, schema)


def attribute(tokens: DataFrame, turns: DataFrame, key: str = "recording_id", token: str = "token_index") -> DataFrame:
    """(key, token, turn, status) of every token of a key that has turns.

    A token belongs to the turn that overlaps it most (matched, or ambiguous
    if that is less than 60 % of it or not 100 ms more than the second); one
    without duration to the shortest turn it lies in, ambiguous if there are
    several; any other to the nearest turn, unmatched.  turns has key, turn,
    start_ms and end_ms.
    """
    ids = [key, token]
    own = tokens.select(*ids, F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"))
    turns = turns.select(key, "turn", F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"))
    long, short = own.where("end_ms > start_ms"), own.where("end_ms <= start_ms").withColumn("end_ms", F.col("start_ms"))
    most = argmax_overlap(long, turns, key, ids).select(*ids, F.col("r_turn").alias("turn"), "status")
    inside = interval_join(short, turns, key).where("r_start_ms <= start_ms and start_ms < r_end_ms")
    least = F.min(F.struct(F.expr("r_end_ms - r_start_ms").alias("n"), "r_start_ms", "r_turn"))
    held = inside.groupBy(*ids).agg(least.alias("b"), F.count("*").alias("n")).select(*ids, F.col("b.r_turn").alias("turn"), F.when(F.col("n") == 1, "matched").otherwise("ambiguous").alias("status"))
    told = most.unionByName(held)
    rest = own.join(told.select(*ids), ids, "left_anti").select(*ids, F.expr("(start_ms + greatest(start_ms, end_ms)) div 2").alias("point_ms"))
    near = nearest(rest, turns, key, ids).select(*ids, F.col("r_turn").alias("turn"), F.lit("unmatched").alias("status"))
    return told.unionByName(near)


def assemble(tokens: DataFrame, turns: DataFrame, raw: DataFrame | None = None, key: str = "recording_id", token: str = "token_index") -> DataFrame:
    """key, turn, start_ms, end_ms, text, original_text of every turn that has a token, its texts joined in the tokens' order.

    tokens and raw (the text before it was polished) have key, token, text and
    turn.  A turn without a polished token goes, whatever raw tokens it has;
    without raw ones its original_text is null.
    """
    joined = F.expr(f"listagg(text, '') WITHIN GROUP (ORDER BY {token})")
    own = tokens.where("turn is not null").groupBy(key, "turn").agg(joined.alias("text"))
    out = turns.select(key, "turn", "start_ms", "end_ms").join(own, [key, "turn"])
    if raw is None:
        return out.withColumn("original_text", F.lit(None).cast("string"))
    before = raw.where("turn is not null").groupBy(key, "turn").agg(F.expr(f"nullif(listagg(text, '') WITHIN GROUP (ORDER BY {token}), '')").alias("original_text"))
    return out.join(before, [key, "turn"], "left")
