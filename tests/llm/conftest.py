import random

import pytest

SCHEMA = "doc_id long, text string, n_chars long, id string, part string, size string, bucket string, block string, node string"


def extra(rows):
    """Rows of (doc_id, text) with columns whose names the operators use themselves."""
    return [(k, t, len(t) if t is not None else None, "x", "x", "x", "x", "x", None) for k, t in rows]


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, very long, repeated, non-Latin and null-keyed documents."""
    random.seed(5)
    words = ["the", "of", "and", "Größe", "über", "don't", "I'll", "42", "x=1;", "été", "—", "token"]
    long = " ".join(random.choice(words) for _ in range(30_000))
    rows = [
        (1, None), (2, ""), (3, " "), (4, "\n\n  \t"), (5, "one"), (6, "one"), (7, "One two three. " * 40), (8, "One two three. " * 40),
        (9, long), (10, long[:5000] + " changed " + long[5000:]), (11, "日本語のテキスト 😀   İstanbul ΣΑΣ"), (12, "<|endoftext|> and <|startoftext|>"),
        (None, "One two three. " * 40), (13, long[3:90]), (14, long[200:4000]), (14, long[200:4000]), (15, "a" * 70_000), (16, "\x00\x1c\x85 b"),
    ]
    return rows, spark.createDataFrame(extra(rows), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
