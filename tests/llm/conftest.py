import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, license string, topic string"


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, columns with clashing names."""
    rng = random.Random(4)
    base = words(rng, 120)
    lines = "\n".join(words(rng, 9) for _ in range(12))
    long = "\n".join(words(rng, 40) for _ in range(600))
    rows = [
        (1, base, "en"), (1, base, "en"), (2, base + " tail", "en"), (3, None, "de"), (4, "", None), (5, " \n\t ", "fr"), (None, base, "en"), (None, None, None),
        (6, lines, "en"), (7, lines, "en"), (8, "top line\n" + lines, None), (9, long, "en"), (10, long + " w1", "en"), (11, "one", "en"), (12, "one", "es"),
        (13, "x " * 500, "en"), (14, "### $$$ %%% " * 60 + base, "en"), (15, "Ünïcödé wörds ß " * 30, "de"), (16, "a\u0000b\\<|im_end|>", "en"), (17, "w" * 30000, "en"),
    ]
    return [(i, t, g, None if i in (3, None) else f"src{(i or 0) % 3}", None if t is None else len(t), "yes", None, "mine", None if i == 5 else "t") for i, t, g in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    from pyspark.sql import functions as F

    out = spark.createDataFrame(odd_rows, SCHEMA)
    # Names that operators use inside.
    for name in ("starts", "lines", "near", "__lines", "__gone", "__weight", "__folder", "sk", "label", "tokens", "weight"):
        out = out.withColumn(name, F.lit("mine"))
    return out


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def marks(spark):
    rows = [(1, 1, 0), (2, 1, 0), (6, 1, 0), (14, 0, 1), (None, 1, 1), (9, None, None), (14, 0, 1), (99, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
