import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def worded(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["an", "er", "tho", "re", "li", "so", "ka"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


#: Nulls in any column, empty and blank texts, repeated rows, repeated ids, one very long text and word, and text beyond the BMP.
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \t\n ", "en", "b", 4),
    (None, worded(1, 30), "en", "a", 9),
    (None, None, None, None, None),
    (4, worded(2, 40), "de", None, 9),
    (4, worded(2, 40), "de", None, 9),
    (5, worded(2, 40), "fr", "c", 9),
    (4, worded(3, 12), "es", "c", 9),
    (6, "x" * 30_000, "en", "d", 9),
    (7, worded(4, 20_000), "en", "d", 9),
    (8, "😀 é ⅷ x y <|endoftext|> the of 😀😀", "xx", "é", 9),
]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def clashing(odd):
    """Columns with the names of results."""
    from pyspark.sql import functions as F

    names = "spans ids n_tokens n_bytes over_limit score held_out predicted kept base_failed n_words size target taken copies source_size fingerprint _size _key".split()
    return odd.withColumns({x: F.lit("taken") for x in names})
