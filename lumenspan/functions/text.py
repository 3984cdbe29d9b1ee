"""Text functions as native columns; Python only where Spark has no such function."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normalize_search(text: Column, unicode: bool = True) -> Column:
    """NFKC, lower case, punctuation to blanks, blanks collapsed; ASCII text never leaves the JVM when unicode is off."""
    text = nfkc(text) if unicode else text
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"\p{P}", " "), r"\s+", " "))


#: The spoken form of each digit; one has two.
DIGITS = {"0": "零", "1": "一", "2": "二", "3": "三", "4": "四", "5": "五", "6": "六", "7": "七", "8": "八", "9": "九"}
SPOKEN_ONE = "幺"


def spoken_variants(plain: Column, most: int = 16) -> Column:
    """A text that normalize_search() made, then its digits spoken: every one plain, every one in its other form, then the mixed ways.

    Mixed ways count in binary, the first one being the lowest digit; there
    are ``most`` variants at most, each once.  Text without an ASCII digit has
    itself only, blank text none.
    """
    others = "".join(d for d in DIGITS if d != "1")
    parts = F.split(F.translate(plain, others, "".join(DIGITS[d] for d in others)), "1", -1)
    every = F.lit(-1).cast("long")
    ways = F.array(F.lit(0).cast("long"), every, *[F.lit(i).cast("long") for i in range(1, most)])
    other_form = lambda way, i: F.when(i > 62, way < 0).otherwise(F.expr("1") == F.call_function("shiftright", way, i).bitwiseAND(F.lit(1).cast("long")))
    said = lambda way: F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.when(i == F.size(parts) - 1, "").when(other_form(way, i), SPOKEN_ONE).otherwise(DIGITS["1"]))), "")
    spoken = F.slice(F.array_distinct(F.concat(F.array(plain), F.transform(ways, said))), 1, most)
    return F.when(F.coalesce(F.length(plain), F.lit(0)) == 0, F.array().cast("array<string>")).when(plain.rlike("[0-9]"), spoken).otherwise(F.array(plain))


def is_near(original: Column, changed: Column, most: float = 0.35) -> Column:
    """Whether a change is small enough to be taken: edits over the original's length, which counts as 1 at least."""
    return F.levenshtein(original, changed) / F.greatest(F.lit(1), F.length(original)) <= most


def retrieval_text(text: Column, topic: Column, terms: Column, context: Column) -> Column:
    """Lines of topic, distinct terms and context where present, then the text."""
    some = lambda c: F.when(F.trim(c) != "", c)
    joined = F.array_join(F.array_distinct(F.filter(terms, lambda t: F.trim(t) != "")), " ")
    return F.concat_ws("\n", some(topic), some(joined), some(context), text)


def sentences(text: Column) -> Column:
    """Sentences with their full stops; a point between digits ends none; blank pieces go."""
    pieces = F.split(text, r"(?<=。)|(?<=(?<![0-9])\.)|(?<=\.)(?![0-9])")
    return F.filter(pieces, lambda p: F.trim(p) != "")


def first_sentence(text: Column, most: int = 200) -> Column:
    """The first sentence without a bullet before it, cut to ``most`` characters."""
    bare = F.regexp_replace(text, r"^\s*[-*•]\s+", "")
    return F.left(F.trim(F.regexp_extract(bare, r"^([^.!?。！？]*[.!?。！？]?)", 1)), F.lit(most))


def block_text(blocks: Column) -> Column:
    """The joined texts of a JSON array's text blocks; of a comparison block the text of its primary variant."""
    kind = "array<struct<type: string, text: string, variants: array<struct<primary: boolean, text: string>>>>"
    own = lambda b: F.when(b["type"] == "text", b["text"]).when(
        b["type"] == "comparison", F.get(F.filter(b["variants"], lambda v: v["primary"]), F.lit(0))["text"]
    )
    return F.array_join(F.filter(F.transform(F.from_json(blocks, kind), own), lambda t: t.isNotNull()), "")


def token_estimate(text: Column) -> Column:
    """CJK characters, plus a quarter of the other bytes rounded up, plus 4."""
    cjk = r"[\x{3400}-\x{9fff}\x{f900}-\x{faff}]"
    other = F.octet_length(F.regexp_replace(text, cjk, ""))
    return F.regexp_count(text, F.lit(cjk)).cast("long") + F.ceil(other / F.lit(4.0)).cast("long") + 4


def render_lines(rows: Column, default: str = "Unknown") -> Column:
    """``label: text`` lines of an array of structs (label, text)."""
    return F.array_join(F.transform(rows, lambda r: F.concat(F.coalesce(r["label"], F.lit(default)), F.lit(": "), r["text"])), "\n")


def overlapping_starts(text: Column, needle: Column) -> Column:
    """All 1-based starts of needle in text, overlapping ones too; an empty needle has none."""
    one = F.array(F.struct(F.split(text, "").alias("t"), F.split(needle, "").alias("n")))
    last = lambda s: F.size(s["t"]) - F.size(s["n"]) + 1
    starts = lambda s: F.when(last(s) >= 1, F.filter(F.sequence(F.lit(1), last(s)), lambda i: F.slice(s["t"], i, F.size(s["n"])) == s["n"]))
    return F.when(F.length(needle) > 0, F.coalesce(F.get(F.transform(one, starts), F.lit(0)), F.array().cast("array<int>"))).otherwise(F.array().cast("array<int>"))


def fenced_object(text: Column) -> Column:
    """The object inside a fence of three back quotes, else the stretch from the first { to the last }; empty if there is none."""
    fenced = F.regexp_extract(text, r"(?is)```(?:json)?\s*(\{.*\})\s*```", 1)
    return F.when(fenced != "", fenced).otherwise(F.regexp_extract(text, r"(?s)(\{.*\})", 1))


def splice(text: Column, spans: Column) -> Column:
    """Replace spans (start, old, new) of the text from the right; a span whose old text is not there raises."""
    step = lambda acc, s: F.when(
        F.substring(acc, s["start"] + 1, F.length(s["old"])) == s["old"], F.overlay(acc, s["new"], s["start"] + 1, F.length(s["old"]))
    ).otherwise(F.raise_error(F.lit("stale span")).cast("string"))
    return F.aggregate(F.reverse(F.array_sort(spans)), text, step)


def cited(text: Column) -> Column:
    """Citation numbers of ``[n]`` marks in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[([0-9]+)\]"), F.lit(1)))


def renumbered(text: Column, known: Column) -> Column:
    """struct(text, cited, unknown): citation marks of known numbers (an array of whole numbers) counted anew by first appearance, others taken out.

    cited holds the known numbers in their new order, unknown the others, each
    once and in order.
    """
    number = lambda: F.transform(F.regexp_extract_all(text, F.lit(r"\[([0-9]+)\]"), F.lit(1)), lambda n: n.cast("decimal(38,0)"))
    has = lambda n: F.exists(known, lambda k: (k == n) & (k >= 1))
    marks = F.array(F.struct(number().alias("n"), F.split(text, r"\[[0-9]+\]").alias("pieces")))
    order = lambda m: F.array_distinct(F.filter(m["n"], has))

    def rewritten(m: Column, cited: Column) -> Column:
        mark = lambda i: F.when(has(F.get(m["n"], i)), F.concat(F.lit("["), F.array_position(cited, F.get(m["n"], i)).cast("string"), F.lit("]")))
        return F.array_join(F.transform(m["pieces"], lambda p, i: F.concat(p, F.coalesce(mark(i), F.lit("")))), "")

    one = lambda m: F.get(F.transform(F.array(order(m)), lambda c: F.struct(rewritten(m, c).alias("text"), c.alias("cited"), F.array_distinct(F.filter(m["n"], lambda n: ~has(n))).alias("unknown"))), F.lit(0))
    return F.get(F.transform(marks, one), F.lit(0))


@F.pandas_udf(StringType())
def casefold(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def normalize_expression(text: Column) -> Column:
    """Case-folded, blanks collapsed, and none left between an ASCII letter or digit and a Han character."""
    collapsed = F.trim(F.regexp_replace(casefold(text), r"\s+", " "))
    return F.regexp_replace(collapsed, r"(?<=[a-z0-9]) (?=[\x{4e00}-\x{9fff}])|(?<=[\x{4e00}-\x{9fff}]) (?=[a-z0-9])", "")


def plain_expression(text: str) -> str:
    """normalize_expression() of one text, for functions that have it in Python already."""
    collapsed = re.sub(r"[ \t\n\x0b\f\r]+", " ", unicodedata.normalize("NFKC", text).casefold()).strip(" ")
    return re.sub(r"(?<=[a-z0-9]) (?=[\u4e00-\u9fff])|(?<=[\u4e00-\u9fff]) (?=[a-z0-9])", "", collapsed)


def speaker_label(index: Column) -> Column:
    """Speaker A to Speaker Z, then numbers; the index counts from 0."""
    return F.when(index < 26, F.concat(F.lit("Speaker "), F.chr(index + 65))).otherwise(F.concat(F.lit("Speaker "), (index + 1).cast("string")))


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


NORMALIZERS = {
    ("strict", 1): lambda c: F.trim(nfc(c)),
    ("zh_asr", 1): lambda c: F.regexp_replace(F.lower(nfkc(c)), r"[\p{P}\p{S}\s]", ""),
}


def normalizer(name: str, version: int):
    """A registered evaluation normaliser; KeyError for an unknown one."""
    return NORMALIZERS[name, version]
