import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, size string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, copies, near copies, repeated rows, columns that clash with results."""
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    words = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base = [words(rng.randint(20, 80)) for _ in range(25)]
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(base)]
    rows += [(100 + i, base[i % 5], "en", "s0", 0) for i in range(12)]  # copies
    for i in range(12):  # near copies
        w = base[i % 3].split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((200 + i, " ".join(w), "fr", None, 1))
    rows += [(300, None, None, None, None), (301, "", "en", "s1", 0), (302, " \n\t", None, "s1", 3), (303, "12 34 !!", "en", "s1", 8)]
    rows += [(304, words(6000), "en", "s2", 1), (305, "x" * 40_000, "en", "s2", 1), (306, "ÀÉ ß 字 😀 " * 30, "de", "é", 1)]
    rows += [(307, "one two three", "en", "s3", 1), (308, "One TWO three", "en", "s3", 1), (309, "one", "en", "s3", 1)]
    rows += [(310, base[7], "en", "s3", 1)] * 2 + [(311, base[8], "en", "s3", 1), (311, base[9], "en", "s3", 1)]
    rows += [(None, base[3], "en", "s3", 1), (None, None, None, None, None), (None, words(30), "en", "s1", 1)]
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], DOC)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)
