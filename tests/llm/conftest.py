import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, score double, row string, w string, id long, _n long"


def prose(rng: random.Random, n: int) -> str:
    parts = "an ble ed en er es ha he in ing ly nd on or ou re sh st th ti tion wh".split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="session")
def prose_of():
    return prose


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with every odd case: nulls, empty and long texts, ties, repeats, clashing columns."""
    rng = random.Random(5)
    long = " ".join(prose(rng, 400) for _ in range(30))
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, "b"), (4, "...", "en", None), (5, long, "en", "a"),
            (6, "One line.", "en", "b"), (6, "One line.", "en", "b"), (None, prose(rng, 60), "en", "b"), (None, None, None, None),
            (7, long, "en", "a"), (8, "É À ñ ß 漢字 \U0001f600", "fr", "c"), (9, "word " * 3000, "en", "a")]
    return spark.createDataFrame([(i, t, l, s, len(t or ""), 1, 0.5, "r", "w", 3, 4) for i, t, l, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
