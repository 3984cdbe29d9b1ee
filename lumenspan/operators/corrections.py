"""Corrections scored against gold: pairs by joins, comparison and assignment a chunk at a time, credits by aggregation."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fuzzy import alike_windows_of
from ..functions.similarity import indel_ratio
from ..functions.text import plain_expression as plain
from .joins import interval_join

#: Least similarity of a local replacement, and of a stretch of the replaced text with an accepted expression.
LOCAL, EXPRESSION = 90.0, 80.0
UNIT = ["case_id", "evidence_index", "chunk_id"]


def _cut(text: str, start: Column, end: Column) -> Column:
    """The characters from start (counted from 0) to end; none if end does not come later."""
    return F.substring(F.col(text), start + 1, F.greatest(F.lit(0), end - start))


def overlaps(gold: DataFrame, predictions: DataFrame, sources: DataFrame) -> DataFrame:
    """Gold and predictions of one chunk whose spans share a character, with the chunk's text, dealt out by chunk.

    Columns of predictions carry the prefix r_; first and last bound all gold
    that a prediction meets.  Spans meet over chunk and place, so a long chunk
    with very many spans is dealt to several tasks.  A text is joined to its
    chunk's pairs where they are and is not shuffled with each of them.
    """
    key = F.concat_ws("\u0001", *UNIT).alias("unit")
    whole = " and ".join(f"{c} is not null" for c in UNIT)
    inside = lambda df, *columns: df.where(whole).select(*columns, key, F.col("start_char").alias("start_ms"), (F.col("end_char") - 1).alias("end_ms")).where("start_ms <= end_ms")
    met = interval_join(inside(gold, "case_id", "gold_index", "accepted", "weight"), inside(predictions, "prediction_index", "original", "resolved"), "unit", 2_000)
    ends = [F.col(f"{r}start_ms").alias(f"{r}start_char") for r in ("", "r_")] + [(F.col(f"{r}end_ms") + 1).alias(f"{r}end_char") for r in ("", "r_")]
    pairs = met.select("case_id", "unit", "gold_index", "accepted", "weight", "r_prediction_index", "r_original", "r_resolved", *ends).repartition("unit")
    of_prediction = Window.partitionBy("unit", "r_prediction_index")
    pairs = pairs.select("*", F.min("start_char").over(of_prediction).alias("first"), F.max("end_char").over(of_prediction).alias("last"))
    return pairs.join(sources.where(whole).select(key, "source_text"), "unit")


def _parts(pairs: DataFrame) -> DataFrame:
    """Each pair with the words around it: what it is compared by is made of these.

    left and right are what the gold covers beyond the prediction, own_left and
    own_right what the prediction covers beyond the gold, before and after what
    all gold that the prediction meets covers beyond it.  made, the
    prediction's result, is null where its original is not what stands there.
    """
    valid = _cut("source_text", F.col("r_start_char"), F.col("r_end_char")) == F.col("r_original")
    lo, hi = F.least("start_char", "r_start_char"), F.greatest("end_char", "r_end_char")
    cuts = {
        "left": (lo, F.col("r_start_char")), "right": (F.col("r_end_char"), hi), "own_left": (lo, F.col("start_char")), "own_right": (F.col("end_char"), hi),
        "before": (F.least("first", "r_start_char"), F.col("r_start_char")), "after": (F.col("r_end_char"), F.greatest("last", "r_end_char")),
    }
    made = F.when(valid, F.col("r_resolved")).alias("made")
    return pairs.select("case_id", "unit", "gold_index", F.col("r_prediction_index").alias("prediction_index"), "weight", "accepted", made, *[_cut("source_text", *c).alias(k) for k, c in cuts.items()])


def _matching(options: dict[int, list[int]]) -> dict[int, int]:
    """prediction -> gold of a greatest matching: golds in turn, each over its predictions in turn, along an augmenting path."""
    owner: dict[int, int] = {}
    for root in sorted(options):
        seen: set[int] = set()
        path, tries = [(root, -1)], [iter(options[root])]
        while path:
            p = next((p for p in tries[-1] if p not in seen), None)
            if p is None:
                path.pop()
                tries.pop()
                continue
            seen.add(p)
            if p in owner:
                path.append((owner[p], p))
                tries.append(iter(options[owner[p]]))
                continue
            for gold, came in reversed(path):  # each gold on the way takes the prediction found below it
                owner[p], p = gold, came
            break
    return owner


class _Unit:
    """The assignment of one chunk's candidates as they come: exact ones first, then others by falling similarity."""

    def __init__(self):
        self.exact: list[dict] = []
        self.out: dict[int, dict] | None = None
        self.taken: dict[int, list[tuple[int, int]]] = {}
        self.local: set[int] = set()

    def settle(self) -> None:
        options: dict[int, list[int]] = {}
        rows = {}
        for r in self.exact:
            options.setdefault(r["gold_index"], []).append(r["prediction_index"])
            rows[r["gold_index"], r["prediction_index"]] = r
        self.out = {g: rows[g, p] for p, g in _matching(options).items()}
        for r in self.out.values():
            if r["end"] >= 0:
                self.taken.setdefault(r["prediction_index"], []).append((r["start"], r["end"]))

    def add(self, r: dict) -> None:
        if r["stage"] == 0:
            self.exact.append(r)
            return
        if self.out is None:
            self.settle()
        if r["gold_index"] in self.out:
            return
        p = r["prediction_index"]
        if r["basis"] == "local":
            if p in self.local:
                return
            self.local.add(p)
        else:
            spans = self.taken.setdefault(p, [])
            if any(r["start"] < e and s < r["end"] for s, e in spans):
                return
            spans.append((r["start"], r["end"]))
        self.out[r["gold_index"]] = r

    def matches(self) -> list[dict]:
        if self.out is None:
            self.settle()
        return list(self.out.values())


PAIR = "case_id long, gold_index long, prediction_index long, weight double, kind string, basis string, similarity double, expression string"


def _candidates(rows: list[dict], local: float, expression: float) -> list[dict]:
    """The candidates of a chunk in the order in which they are tried.

    Of each pair the best accepted expression by what the prediction makes of
    the words around it, exact or alike enough; and the stretches alike an
    accepted expression, of all that the prediction makes of the text of the
    gold it meets, in which it has a part.
    """
    near, asks, out = [], [], []
    for r in rows:
        if r["made"] is None:
            continue
        best, actual, changed = None, plain(r["left"] + r["made"] + r["right"]), r["before"] + r["made"]
        result, start, end = plain(changed + r["after"]), len(plain(r["before"])), len(plain(changed))
        for place, e in enumerate(r["accepted"] or ()):
            if e is None:
                continue
            asks.append((r, place, e, plain(e), result, start, end))
            expected = plain(r["own_left"] + e + r["own_right"])
            exact = actual == expected
            tried = (exact, 100.0 if exact else indel_ratio(actual, expected), -place, e)
            if (exact or tried[1] >= local) and (best is None or tried[:3] > best[:3]):
                best = tried
        if best:
            near.append((r, *best))
    candidate = lambda r, stage, kind, basis, similarity, place, e, start, end: {
        **{c: r[c] for c in ("case_id", "gold_index", "prediction_index", "weight")}, "stage": stage, "kind": kind, "basis": basis, "similarity": similarity, "place": place, "expression": e, "start": start, "end": end
    }
    whole: dict[tuple[int, int, int], tuple[int, int]] = {}
    for (r, place, e, _, _, start, end), windows in zip(asks, alike_windows_of([x[3] for x in asks], [x[4] for x in asks], expression), strict=True):
        for s, t, similarity in windows:
            if s < end and start < t:
                out.append(candidate(r, 1, "fuzzy", "expression", similarity, place, e, s, t))
                if similarity == 100:
                    whole.setdefault((r["gold_index"], r["prediction_index"], place), (s, t))  # windows come by start, then end
    for r, exact, similarity, place, e in near:
        span = whole.get((r["gold_index"], r["prediction_index"], -place), (-1, -1)) if exact else (-1, -1)
        out.append(candidate(r, 0 if exact else 1, "exact" if exact else "fuzzy", "local", similarity, -place, e, *span))
    return sorted(out, key=lambda c: (c["stage"], -c["similarity"], c["gold_index"], c["prediction_index"], c["basis"] != "local", c["place"], c["start"], c["end"]))


def assign(pairs: DataFrame, local: float, expression: float) -> DataFrame:
    """Every pair once, with the match if it is one; one match at most for each gold.

    Exact candidates are matched so that as many gold as possible have one.
    The others follow by falling similarity, gold, prediction: a prediction
    serves one gold by its local text, and any number by stretches of its
    result that do not overlap each other.  Candidates link within a chunk
    only, and a task holds one chunk's.  Pairs that are dealt out by chunk stay
    where they are.
    """
    names = [x.split()[0] for x in PAIR.split(", ")]

    def run(chunk: pa.Table) -> pa.Table:
        rows, unit = chunk.to_pylist(), _Unit()
        for r in _candidates(rows, local, expression):
            unit.add(r)
        matches = {(m["gold_index"], m["prediction_index"]): m for m in unit.matches()}
        out = [matches.get((r["gold_index"], r["prediction_index"]), r) for r in rows]
        kinds = [pa.int64()] * 3 + [pa.float64(), pa.string(), pa.string(), pa.float64(), pa.string()]
        return pa.table([pa.array([r.get(c) for r in out], kind) for c, kind in zip(names, kinds, strict=True)], names)

    return pairs.groupBy("unit").applyInArrow(run, PAIR)


def score_corrections(gold: DataFrame, predictions: DataFrame, sources: DataFrame, local: float = LOCAL, expression: float = EXPRESSION) -> tuple[DataFrame, DataFrame]:
    """(corrections, credits): each gold with its match, each prediction with its credit.

    gold: case_id, evidence_index, chunk_id, gold_index, start_char, end_char,
    accepted (array), weight.  predictions: case_id, evidence_index, chunk_id,
    prediction_index, start_char, end_char, original, resolved.  sources: the
    text of each chunk.  Indexes are unique in a case; spans count characters
    from 0.

    A prediction whose original is not what stands at its span can match
    nothing, but overlaps.  A correction passes with an exact or a fuzzy match;
    the strict (relaxed) credit of a prediction is the weight of its exact
    (all) matches over the weight of the gold it overlaps, 0 without any.
    """
    pairs = assign(_parts(overlaps(gold, predictions, sources)), local, expression)
    match = F.when(F.col("kind").isNotNull(), F.struct("prediction_index", "kind", "basis", "similarity", F.col("expression").alias("matched_expression")))
    of_gold = pairs.groupBy("case_id", "gold_index").agg(F.max(match).alias("m"), F.lit(True).alias("overlapping"))
    corrections = gold.select("case_id", "gold_index", "weight").join(of_gold, ["case_id", "gold_index"], "left").select("case_id", "gold_index", "weight", "m.*", "overlapping")
    corrections = corrections.withColumn("kind", F.coalesce("kind", F.lit("unmatched"))).withColumn("overlapping", F.coalesce("overlapping", F.lit(False)))
    weight = lambda c: F.sum(F.when(c, F.col("weight")).otherwise(0.0))
    sums = pairs.groupBy("case_id", "prediction_index").agg(
        F.sum("weight").alias("w"), weight(F.col("kind") == "exact").alias("strict"), weight(F.col("kind").isNotNull()).alias("relaxed"), F.min("similarity").alias("least"),
        F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), F.col("gold_index")))).alias("matched_gold"),
    )
    share = lambda c: F.when(F.coalesce(F.col("w"), F.lit(0.0)) > 0, F.col(c) / F.col("w")).otherwise(0.0)
    credits = predictions.select("case_id", "prediction_index").join(sums, ["case_id", "prediction_index"], "left")
    credits = credits.select("case_id", "prediction_index", "matched_gold", "least", share("strict").alias("strict_credit"), share("relaxed").alias("relaxed_credit"))
    full = F.col("relaxed_credit") == 1.0
    kind = F.when(full & (F.col("strict_credit") == 1.0), "exact").when(full, "fuzzy").otherwise("unmatched")
    none_matched = F.array().cast("array<bigint>")
    return corrections, credits.select("case_id", "prediction_index", F.coalesce("matched_gold", none_matched).alias("matched_gold"), kind.alias("kind"), F.when(full, F.col("least")).alias("similarity"), "strict_credit", "relaxed_credit")


def case_scores(corrections: DataFrame, credits: DataFrame) -> DataFrame:
    """Counts, weights and credits of each case that has gold or predictions."""
    n = lambda c: F.count_if(c)
    weight = lambda c: F.sum(F.when(c, F.col("weight")).otherwise(0.0))
    kind = F.col("kind")
    a = corrections.groupBy("case_id").agg(
        F.count("*").alias("gold"), n(kind == "exact").alias("exact"), n(kind == "fuzzy").alias("fuzzy"), F.sum("weight").alias("gold_weight"),
        weight(kind == "exact").alias("exact_weight"), weight(kind == "fuzzy").alias("fuzzy_weight"), n((kind == "unmatched") & ~F.col("overlapping")).alias("missed"),
    )
    b = credits.groupBy("case_id").agg(
        F.count("*").alias("predictions"), n(kind == "exact").alias("strict_predictions"), n(kind != "unmatched").alias("relaxed_predictions"),
        F.sum("strict_credit").alias("strict_credit"), F.sum("relaxed_credit").alias("relaxed_credit"), n(F.col("relaxed_credit") < 1.0).alias("incorrect"),
    )
    return a.join(b, "case_id", "full").na.fill(0)
