import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, and extra columns whose names clash with those inside the operators."""
    rng = random.Random(3)
    long_text = " ".join(f"w{rng.randrange(5000)}" for _ in range(60_000))
    rows = [
        (1, None, "en", "a", 0), (2, "", None, None, None), (3, " \t\n", "en", "a", 3), (None, "no id at all here my friend", "en", None, 27), (5, "same text for two of us now", "en", "a", 26),
        (6, "same text for two of us now", "en", "b", 26), (7, "same text for two of us now", "en", "b", 26), (7, "same text for two of us now", "en", "b", 26), (8, long_text, "en", "a", len(long_text)),
        (9, long_text + " tail", None, "b", None), (10, "ümläut çédille naïve 12 34", "fr", "c", 26), (11, "123 456 !!", "de", "c", 10), (12, None, None, None, None),
    ]
    extra = "id long, class long, salt int, key string, component long, n long, size long, y int, grp long, x string"
    return spark.createDataFrame([(*r, 1, 2, 3, "k", 4, 5, 6, 7, 8, "x") for r in rows], f"{DOCS}, {extra}")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
