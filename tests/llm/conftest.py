import os
import random

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Columns of the caller whose names clash with inner ones; no operator may read them or fail on them.
CLASHING = "node string, root string, size string, start string, place string, n_words string, `a.b` string, _take string"


def words(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 9))) for _ in range(n)]


def prose(seed: int, n: int) -> str:
    own = words(seed, n)
    return " ".join(w + (".\n" if i % 17 == 16 else "") for i, w in enumerate(own))


LONG = prose(99, 30_000)
#: (doc_id, text, source): nulls, empty and very long texts, texts without a word, ties and repeated rows.
EDGES = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "One", "b"), (5, "one two three four", "b"), (6, LONG, "c"), (7, LONG, "c"),
         (7, LONG, "c"), (8, prose(1, 80), None), (9, prose(1, 80).upper(), None), (None, prose(2, 60), "a"), (None, None, None),
         (10, "ein wörté 日本語 \U0001f600 <s> </s> <|endoftext|>", "b"), (11, "same " * 400, "b")]


def frame(spark, rows, lang="en"):
    """Documents with the columns of the real table and some that clash."""
    full = [(i, t, lang, s, None if t is None else len(t), *["x"] * 8) for i, t, s in rows]
    return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}")


@pytest.fixture(scope="session")
def edges(spark):
    return frame(spark, EDGES).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])
