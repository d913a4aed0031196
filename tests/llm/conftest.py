import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, row_n string"


def words(rng, n):
    return " ".join("".join(rng.choice(["an", "the", "er", "st", "ion", "ou", "ch"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Null, empty, short, long, repeated and periodic texts."""
    rng = random.Random(5)
    base = words(rng, 120)
    out = [None, "", "a", " \n\t ", "éàü" * 60, "x" * 900, "ab" * 300, base, base, base.replace("the", "thy", 2), words(rng, 3000), "<|endoftext|> " + words(rng, 5)]
    return out + [words(rng, rng.randint(1, 80)) for _ in range(30)]


@pytest.fixture(scope="session")
def documents(spark, texts):
    """With columns whose names clash with those that operators use inside, and a repeated row."""
    rows = [(k, t, "en", "src0", len(t or ""), "l", "r") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[7:8], SCHEMA).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
