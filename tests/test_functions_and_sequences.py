import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenspan.functions import similarity as D
from lumenspan.functions import text as T
from lumenspan.operators import folds
from lumenspan.operators import sequences as Q


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_normalize_search(spark):
    assert one(spark, T.normalize_search(F.lit("Ｈello，\n WORLD!  x")))[0] == "hello world x"


def test_spoken_variants(spark):
    said = lambda *texts: [r.v for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.normalize_search(F.col("t")).alias("t")).select(T.spoken_variants(F.col("t")).alias("v")).collect()]
    got = said("会议室１０１７", "1121", "none", "", None, "1" * 10, "1" * 70)
    assert got[0] == ["会议室1017", "会议室一零一七", "会议室幺零幺七", "会议室幺零一七", "会议室一零幺七"]
    assert got[1][:3] == ["1121", "一一二一", "幺幺二幺"] and len(got[1]) == len(set(got[1])) == 9
    assert got[2:5] == [["none"], [], []]
    assert len(got[5]) == len(got[6]) == 16 and got[6][2] == "幺" * 70 and got[6][3] == "幺" + "一" * 69


def test_sentences_keep_decimals(spark):
    assert one(spark, T.sentences(F.lit("Take 3.5 mg. Then rest. end")))[0] == ["Take 3.5 mg.", " Then rest.", " end"]


def test_splice_and_stale_span(spark):
    span = lambda at, old, new: F.struct(F.lit(at).alias("start"), F.lit(old).alias("old"), F.lit(new).alias("new"))
    assert one(spark, T.splice(F.lit("abcdef"), F.array(span(0, "a", "XX"), span(3, "de", ""))))[0] == "XXbcf"
    with pytest.raises(Exception, match="stale"):
        one(spark, T.splice(F.lit("abc"), F.array(span(0, "z", "y"))))


def test_small_text_functions(spark):
    assert one(spark, T.token_estimate(F.lit("会议ab")))[0] == 2 + 1 + 4
    assert one(spark, T.overlapping_starts(F.lit("aaaa"), F.lit("aa")))[0] == [1, 2, 3]
    assert one(spark, T.cited(F.lit("x [2] y [1] z [2]")))[0] == ["2", "1"]
    assert one(spark, T.normalize_expression(F.lit("用 GPT  模型")))[0] == "用gpt模型"
    assert one(spark, T.speaker_label(F.lit(1)), T.speaker_label(F.lit(26))) == ("Speaker B", "Speaker 27")
    assert one(spark, T.retrieval_text(F.lit("body"), F.lit("topic"), F.array(F.lit("a"), F.lit("a"), F.lit(" ")), F.lit("")))[0] == "topic\na\nbody"
    assert one(spark, T.normalizer("zh_asr", 1)(F.lit("Ａ，b c。")))[0] == "abc"
    with pytest.raises(KeyError):
        T.normalizer("none", 1)


def test_edit_counts(spark):
    assert D.edit_counts(list("abcdef"), list("abXdefg")) == (1, 0, 1)
    assert D.edit_counts([], list("ab")) == (0, 0, 2)
    assert D.edit_counts("a b".split(), "a".split()) == (0, 1, 0)
    got = one(spark, D.word_edits(F.lit("the old cat"), F.lit("the cat")).alias("e"))[0]
    assert tuple(got) == (0, 1, 0)
    rate = lambda e, n: one(spark, D.error_rate(F.lit(e), F.lit(n)))[0]
    assert (rate(0, 0), rate(2, 0)) == (0.0, 1.0) and rate(2, 6) == pytest.approx(1 / 3)


def test_similarities():
    assert D.word_similarity("word", "two words") == pytest.approx(0.8)
    assert D.word_similarity("", "x") == 0.0 and D.word_similarity("cat", "cat") == 1.0
    assert D.indel_ratio("", "") == 100.0 and D.indel_ratio("abcd", "abcd") == 100.0
    assert D.indel_ratio("abc", "axc") == pytest.approx(200 * 2 / 6)


SECOND = 1000


def smoothed(*recordings, **limits):
    """The segments of each recording and how many were given away, all recordings smoothed together."""
    rows = [(k, int(a * SECOND), int(b * SECOND), c) for k, own in enumerate(recordings) for a, b, c in own]
    line, given = Q.smooth(*[np.array(x) for x in zip(*rows, strict=True)], **limits)
    return [([(a / SECOND, b / SECOND, c) for k, a, b, c in zip(*[x.tolist() for x in line], strict=True) if k == i], int((given == i).sum())) for i in range(len(recordings))]


def test_smoothing():
    one_, two, long = [(0, 10, "A"), (10, 11.5, "B"), (11.5, 20, "A")], [(0, 10, "A"), (10, 11, "B"), (11, 12, "A"), (12, 13, "B"), (13, 20, "A")], [(0, 10, "A"), (10, 12.001, "B"), (12.001, 20, "A")]
    assert smoothed(one_) == [([(0, 20, "A")], 1)]
    assert smoothed(long) == [(long, 0)]
    together = smoothed(one_, two, long, one_)
    assert [r for r, _ in together] == [[(0, 20, "A")], [(0, 20, "A")], long, [(0, 20, "A")]] and [n for _, n in together][::3] == [1, 1]


def test_windows():
    assert Q.windows([]) == []
    assert Q.windows([(0, 10_000), (10_000, 35_000), (36_000, 40_000)]) == [(0, 35_500, 0, 35_000, 2), (34_500, 40_500, 35_000, 40_000, 3)]
    cores = [w[2:4] for w in Q.windows([(0, 200_000)])]
    assert cores[0] == (0, 30_000) and cores[-1][1] == 200_000 and all(a[1] == b[0] for a, b in zip(cores, cores[1:], strict=False))


def test_chunks_and_batches(spark):
    rows = [{"utterance_index": i, "label": "A", "text": f"Sentence {i}. More.", "start_ms": i * 1000, "end_ms": i * 1000 + 900} for i in range(5)]
    chunks = Q.bounded_chunks(rows, Q.estimated_tokens, most_tokens=10_000)
    assert len(chunks) == 1 and chunks[0]["utterances"] == [0, 1, 2, 3, 4] and chunks[0]["text"].startswith("A: Sentence 0. More.\n")
    assert len(Q.bounded_chunks(rows, Q.estimated_tokens, most_utterances=2)) == 3
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate([5, 5, 5, 20, 1])], "k long, o long, n long")
    got = [tuple(r) for r in folds.budget_batches(df, "k", "o", "n", 10).orderBy("batch").collect()]
    assert got == [(1, 0, 2, 10), (1, 1, 1, 5), (1, 2, 1, 20), (1, 3, 1, 1)]


def test_chunks_keep_to_sections_and_count_their_search_text(spark):
    utt = [(1, i, "Speaker A", f"话{i + 1}。", i * 1_000, (i + 1) * 1_000) for i in range(4)] + [(2, 0, "B", "outside. of all", 0, 5), (2, 1, "B", "in. side", 5, 9)]
    utterances = spark.createDataFrame(utt, "recording_id long, utterance_index long, cluster string, text string, start_ms long, end_ms long")
    sections = spark.createDataFrame([(1, 0, 0, 0, " 花园 ", ["种子", "水", "种子", " "], "谁来浇水"), (1, 1, 1, 3, "其他", [], None), (2, 0, 1, 1, None, None, " ")], "recording_id long, section long, first_index long, last_index long, topic string, terms array<string>, search_context string")
    got = Q.search_chunks(utterances, sections).orderBy("recording_id", "chunk_index").collect()
    assert [(r.recording_id, r.chunk_index, r.utterances, r.topic, r.terms) for r in got] == [(1, 0, [0], "花园", ["种子", "水"]), (1, 1, [1, 2, 3], "其他", []), (2, 0, [1], None, [])]
    assert got[0].search_text == "花园\n种子 水\n谁来浇水\nSpeaker A: 话1。" and got[0].text == "Speaker A: 话1。"
    tokens = Q.estimated_tokens(got[1].text)
    assert len(Q.search_chunks(utterances, sections, most_tokens=tokens).where("recording_id = 1 and section = 1").collect()) == 2  # with its topic it has more
    assert len(Q.search_chunks(utterances, most_tokens=tokens).where("recording_id = 1").collect()) == 2
    assert Q.search_chunks(utterances.limit(0)).count() == 0


def test_lone_windows(spark):
    rows = [(1, 1, 0, 4_500), (1, 2, 4_500, 5_000), (1, 3, 6_000, 9_000), (1, 4, 8_999, 9_500), (1, 5, 9_400, 9_400), (1, 6, 20_000, 60_000), (1, 7, 30_000, 31_000), (1, 8, 59_999, 70_000), (2, 1, 0, 10)]
    got = Q.lone_windows(spark.createDataFrame(rows, "recording_id long, ordinal long, start_ms long, end_ms long"))
    assert sorted(map(tuple, got.collect())) == [(1, 1, 0, 0, 2_000), (1, 1, 1, 2_000, 4_000), (1, 1, 2, 4_000, 4_500), (1, 2, 0, 4_500, 5_000), (2, 1, 0, 0, 10)]


def test_renumbered_citations(spark):
    seen = lambda t, known: tuple(one(spark, T.renumbered(F.lit(t), F.lit(known).cast("array<int>")).alias("r"))[0])
    plain = lambda r: (r[0], [int(x) for x in r[1]], [int(x) for x in r[2]])
    assert plain(seen("a [3] b [1][3] c [9][0]", [0, 1, 3])) == ("a [1] b [2][1] c ", [3, 1], [9, 0])
    assert plain(seen("none [x] []", [1])) == ("none [x] []", [], []) and plain(seen("[2]", [])) == ("", [], [2])


def test_orders():
    assert Q.topological_order({"b": {"a"}, "a": set(), "c": {"a"}}) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        Q.topological_order({"a": {"b"}, "b": {"a"}})
    assert Q.pick_apart([(0, 5, 1.0, "x"), (3, 8, 2.0, "y"), (8, 9, 0.5, "z"), (20, 22, 0.1, "y")]) == [(3, 8, 2.0, "y"), (8, 9, 0.5, "z")]
