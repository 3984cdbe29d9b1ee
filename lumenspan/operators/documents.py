"""Structure of texts: sections, bounded search documents, unique contexts, balanced objects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import token_estimate

#: Headings of a text that speak of the whole, the labels of a search document's parts, and its limits in tokens.
WHOLE_HEADINGS = ["全局总结", "整体总结", "总体总结", "内容总结", "会议总结", "录音总结", "会议概述", "内容概述", "录音概述", "总结", "概述"]
WHOLE_ENDINGS = ["全局总结", "整体总结"]
TITLE, OVERVIEW, HEADINGS, LEADS, BETWEEN = "录音标题：", "全局概述：\n", "内容结构：\n", "章节要点：\n", "："
MOST_TOKENS, OVERVIEW_TOKENS, LEAD_CHARS = 512, 320, 200

_LINES = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
_HEADING = r"^\s{0,3}#{1,6}\s+(.+?)\s*#*\s*$"
_strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
_plain = lambda c: _strip(F.regexp_replace(c, r"[*_`]", ""))


def sections(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, section (0: what stands before the first heading), heading, body of every document's sections.

    A heading is a line of one to six # and a text.  Of a body, blank lines and
    rules become one blank line between others; emphasis marks go.  There is
    always a section 0, with a null heading and maybe an empty body; null text
    has none.  Lines are numbered by a running count of headings, and joined by
    section; a document's lines are what a task sorts.
    """
    lines = docs.where(F.col(text).isNotNull()).select(F.col(id_col), F.posexplode(F.concat(F.array(F.lit("")), F.split(text, _LINES))).alias("pos", "line"))
    lines = lines.withColumn("heading", F.when(F.col("line").rlike(_HEADING), _plain(F.regexp_extract("line", _HEADING, 1)))).withColumn("raw", _strip(F.col("line")))
    by = Window.partitionBy(id_col).orderBy("pos")
    lines = lines.withColumn("blank", F.col("raw").isin("", "---")).select(
        id_col, "pos", "heading", "raw", "blank", F.count("heading").over(by).alias("section"), F.lag("blank").over(by).alias("after_blank")
    )
    said = F.col("heading").isNull() & ~F.col("blank")
    piece = F.concat(F.when(F.col("after_blank"), "\n\n").otherwise("\n"), _plain(F.col("raw")))
    body = F.expr("listagg(piece, '') WITHIN GROUP (ORDER BY pos)")
    out = lines.withColumn("piece", F.when(said, piece)).groupBy(id_col, "section").agg(F.first("heading", ignorenulls=True).alias("heading"), body.alias("body"))
    return out.select(id_col, "section", "heading", _strip(F.coalesce("body", F.lit(""))).alias("body"))


def fit(text: Column, most: Column, count: Callable[[Column], Column] = token_estimate) -> Column:
    """The longest prefix, without blanks at its end, that ``count`` puts at ``most`` or less; found by halving.

    ``count`` must not fall as a text grows.
    """
    right = lambda c: F.regexp_replace(c, r"\s+$", "")
    at = lambda s: F.floor((s["low"] + s["high"] + 1) / 2).cast("int")

    def halve(s: Column, _: Column) -> Column:
        good = count(right(F.left(text, at(s)))) <= most
        return F.when(s["low"] >= s["high"], s).otherwise(F.struct(F.when(good, at(s)).otherwise(s["low"]).alias("low"), F.when(good, s["high"]).otherwise(at(s) - 1).alias("high")))

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.length(text) + 2)).cast("int"))
    found = F.aggregate(rounds, F.struct(F.lit(0).alias("low"), F.length(text).alias("high")), halve, lambda s: right(F.left(text, s["low"])))
    return F.when(count(text) <= most, text).otherwise(found)


def is_whole(heading: Column) -> Column:
    bare = F.regexp_replace(heading, r"[：:\s]", "")
    return bare.isin(WHOLE_HEADINGS) | bare.endswith(WHOLE_ENDINGS[0]) | bare.endswith(WHOLE_ENDINGS[1])


def lead(body: Column) -> Column:
    """The first sentence of a body's lines, without a bullet; the first 200 characters if none ends."""
    flat = F.regexp_replace(F.array_join(F.filter(F.transform(F.split(body, "\n"), _strip), lambda x: x != ""), " "), r"^[*+-]\s+", "")
    ended = F.regexp_extract(flat, r"^([^。！？!?；;]*[。！？!?；;])", 1)
    return _strip(F.when(ended != "", ended).otherwise(F.left(flat, F.lit(LEAD_CHARS))))


def _first_paragraph(body: Column) -> Column:
    return F.coalesce(F.get(F.filter(F.transform(F.split(body, r"\n\s*\n"), _strip), lambda x: x != ""), F.lit(0)), F.lit(""))


def search_documents(docs: DataFrame, title: str, text: str = "text", id_col: str = "doc_id", most: int = MOST_TOKENS, count: Callable[[Column], Column] = token_estimate) -> DataFrame:
    """id, document: one search text of at most ``most`` tokens for each row with an id of its own.

    Its parts are the title, an overview (the section that speaks of the
    whole, else the first paragraph before all headings, else that of the first
    section with a body), the headings and each section's first sentence.  The
    first part that passes the limit is cut and ends the document.  A text
    without anything but blanks has its title only.
    """
    if most <= 0:
        raise ValueError("a document needs room for a token at least")
    own = docs.select(id_col, F.concat(F.lit(TITLE), _strip(F.coalesce(title, F.lit("")))).alias("title"), _strip(F.coalesce(text, F.lit(""))).alias("text"))
    cut = sections(own, "text", id_col)
    rows = F.array_sort(F.collect_list(F.struct("section", "heading", "body")))  # the sections of one document
    of_doc = cut.groupBy(id_col).agg(rows.alias("s"))
    named = F.filter("s", lambda x: x["section"] > 0)
    whole = F.filter(named, lambda x: is_whole(x["heading"]) & (x["body"] != ""))
    others = F.filter(named, lambda x: ~is_whole(x["heading"]))
    before = F.get("s", F.lit(0))["body"]
    overview = F.when(F.size(whole) > 0, F.get(whole, F.lit(0))["body"]).when(before != "", _first_paragraph(before)).otherwise(
        F.coalesce(_first_paragraph(F.get(F.filter(named, lambda x: x["body"] != ""), F.lit(0))["body"]), F.lit(""))
    )
    leads = F.filter(F.transform(others, lambda x: F.struct(x["heading"].alias("h"), lead(x["body"]).alias("l"))), lambda x: x["l"] != "")
    parts = own.join(of_doc, id_col).select(
        id_col, "title", "text", overview.alias("overview"), F.transform(others, lambda x: F.concat(F.lit("- "), x["heading"])).alias("headings"),
        F.transform(leads, lambda x: F.concat(F.lit("- "), x["h"], F.lit(BETWEEN), x["l"])).alias("leads"),
    )
    room = F.lit(max(1, min(OVERVIEW_TOKENS, most * 2 // 3)))
    filled = lambda c, label, value: F.when(c, F.concat(F.lit(label), value))
    every = parts.withColumn("overview", fit(F.col("overview"), room, count)).select(
        id_col, F.col("text") == "", "title", filled(F.col("overview") != "", OVERVIEW, F.col("overview")).alias("b"),
        filled(F.size("headings") > 0, HEADINGS, F.array_join("headings", "\n")).alias("c"), filled(F.size("leads") > 0, LEADS, F.array_join("leads", "\n")).alias("d"),
    ).toDF(id_col, "empty", "a", "b", "c", "d")
    # parts in turn: what has been taken stays below the limit, and the part that passes it is cut
    state = F.struct(F.lit("").alias("text"), F.lit(False).alias("full"))

    def take(s: Column, part: Column) -> Column:
        longer = F.when(s["text"] == "", part).otherwise(F.concat(s["text"], F.lit("\n\n"), part))
        return F.when(s["full"], s).otherwise(F.struct(longer.alias("text"), (count(longer) > most).alias("full")))

    chosen = F.when(F.col("empty"), F.array("a")).otherwise(F.array_compact(F.array("a", "b", "c", "d")))
    return every.withColumn("t", F.aggregate(chosen, state, take)["text"]).select(id_col, F.regexp_replace(fit(F.col("t"), F.lit(most), count), r"\s+$", "").alias("document"))


def first_object(text: Column) -> Column:
    """The first { of a text to the } that closes it, null if none does; braces inside quotes don't count, nor quotes behind a backslash.

    The text from the first { on is cut into quoted strings, braces and what
    lies between; depth is counted over these.
    """
    rest = F.substring(text, F.instr(text, "{"), F.length(text))
    tokens = F.regexp_extract_all(rest, F.lit(r'(?s)"(?:[^"\\]++|\\.)*+(?:"|\\?$)|[{}]|[^"{}]++'), F.lit(0))
    state = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(-1).alias("end"))

    def step(s: Column, token: Column) -> Column:
        depth = s["depth"] + F.when(token == "{", 1).when(token == "}", -1).otherwise(0)
        end = F.when((depth == 0) & (token == "}"), s["n"] + 1).otherwise(-1)
        return F.when(s["end"] >= 0, s).otherwise(F.struct(depth.alias("depth"), (s["n"] + 1).alias("n"), end.alias("end")))

    closed = F.aggregate(tokens, state, step, lambda s: s["end"])
    return F.when((F.instr(text, "{") > 0) & (closed > 0), F.array_join(F.slice(tokens, F.lit(1), F.greatest(F.lit(0), closed)), ""))


#: Characters beyond which a context is widened no more.
WIDEST = 1_000
ENDS = "\n。！？!?"


def unique_context(text: Column, start: Column, length: Column, most: int = WIDEST) -> Column:
    """Whole sentences around the characters from ``start`` (counted from 0) on that stand nowhere else in the text; null if there are none.

    Sentences end with a line end or an end mark.  Beginning with those that
    the characters lie in, the nearer neighbour is added, the left one of
    equally near ones, until the stretch occurs once, counted without overlaps.
    A stretch of ``most`` characters is widened no more, nor is the whole text.
    """
    size, end = F.length(text), start + length
    back = lambda n: F.length(F.regexp_extract(F.left(text, F.greatest(F.lit(0), n)), f"(?s)^(.*[{ENDS}])", 1))  # noqa: E731  the last end of a sentence among the first n characters
    ahead = lambda n: n + F.length(F.regexp_extract(F.substring(text, n + 1, size), f"^[^{ENDS}]*[{ENDS}]?", 0))  # noqa: E731  the first one beyond them
    quote = lambda s: F.substring(text, s["a"] + 1, s["b"] - s["a"])
    once = lambda q: (F.length(q) > 0) & (size - F.length(F.replace(text, q, F.lit(""))) == F.length(q))

    def wider(s: Column, n: Column) -> Column:
        to_left = (s["a"] > 0) & ((s["b"] == size) | (start - (n["before"] - 1) <= n["after"] - start))
        return F.struct(F.when(to_left, n["before"]).otherwise(s["a"]).alias("a"), F.when(to_left, s["b"]).otherwise(n["after"]).alias("b"), F.lit(0).alias("done"))

    def step(s: Column, _: Column) -> Column:
        given_up = (s["b"] - s["a"] >= most) | ((s["a"] == 0) & (s["b"] == size))
        found = lambda k: F.struct(s["a"].alias("a"), s["b"].alias("b"), F.lit(k).alias("done"))
        beside = F.array(F.struct(back(s["a"] - 1).alias("before"), ahead(s["b"]).alias("after")))
        return F.when(s["done"] != 0, s).when(once(quote(s)), found(1)).when(given_up, found(2)).otherwise(F.get(F.transform(beside, lambda n: wider(s, n)), F.lit(0)))

    begun = F.struct(back(start).alias("a"), ahead(end).alias("b"), F.lit(0).alias("done"))
    found = F.aggregate(F.sequence(F.lit(0), F.lit(most)), begun, step, lambda s: F.when(s["done"] == 1, quote(s)))
    return F.when(size > 0, found)
