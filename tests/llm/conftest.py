import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, keep_id string, text_sha256 int, score string, body int, "
    "fp string, id int, gram string, mark double, weight string, tokens string, predicted string, word string, kept string, start int"
)
EXTRA = ("x", 1, "y", 2, "z", 3, "g", 0.5, "w", "t", "p", "v", "k", 7)


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 8))) for _ in range(n))


def odd_rows():
    """(doc_id, text, lang, source): nulls, empty and very long texts, ties and repeated rows."""
    long = prose(1, 30_000)
    return [
        (1, "Hello big wide world. Licensed under CC BY-NC 4.0.", "en", "a"),
        (2, None, "en", "a"),
        (3, "", None, "b"),
        (4, " \n\t ", "en", None),
        (None, "Hello big wide world. Licensed under CC BY-NC 4.0.", None, None),
        (None, None, None, None),
        (5, long, "de", "a"),
        (6, long, "de", "a"),
        (7, long[:100_000] + " CHANGED " + long[100_000:], "de", "b"),
        (8, prose(2, 80), "fr", "a"),
        (8, prose(2, 80), "fr", "a"),
        (9, prose(2, 80).upper(), "fr", "a"),
        (10, "a" * 700, "en", "a"),
        (11, "x" + "a" * 150, "en", "c"),
        (12, prose(3, 60) + " 漢字 ü🙂 <|endoftext|> it's\x1c " + prose(4, 60), "en", "c"),
        (13, prose(5, 40) + " " + prose(4, 60), "en", "c"),
        (-3, "one", "en", "c"),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, lang, s, None if t is None else len(t), *EXTRA) for i, t, lang, s in odd_rows()]
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
