import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, row int, h long, top string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) pairs, with extra columns named like columns of the operators."""

    def make(pairs, lang="en"):
        rows = [(i, t, lang, "s", None if t is None else len(t), "x", None, 1, None, "y") for i, t in pairs]
        return spark.createDataFrame(rows, SCHEMA)

    return make


LONG = " ".join(f"word{i % 977}x{i}" for i in range(40_000))


@pytest.fixture(scope="session")
def odd_pairs():
    """Nulls, empty and blank texts, a very long text, repeated rows, equal and nearly equal texts."""
    plain = "The quick brown fox jumps over the lazy dog and then runs home to eat a large meal of fresh fish with friends by the river at night"
    return [
        (1, None), (2, ""), (3, " \t\n "), (4, plain), (5, plain.replace(" ", "  ")), (6, plain + " again"), (4, plain), (4, plain),
        (None, plain), (None, None), (7, LONG), (8, LONG), (9, "一二三四五\n" * 30), (10, "x"), (11, "aaaa" * 500), (12, "é" * 300 + " " + "ü" * 10),
    ]
