import random

import pytest

CLASHES = ["n_lines", "kept", "shard", "spans", "row", "doc", "block", "score", "fp", "item_id", "n_words", "cell"]


def prose(n, seed, words=400):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghié") for _ in range(r.randint(1, 8))) for _ in range(words)]
    return " ".join(r.choice(vocabulary) for _ in range(n))


def messy_rows():
    """Null, empty, blank and very long texts, null and shared ids, repeated rows."""
    long = prose(60_000, 1, 5000)
    rows = [
        (1, None),
        (2, ""),
        (3, " \n\t\n "),
        (4, "word"),
        (5, "A b\x0bC  d\r\n\nA b C"),
        (6, long),
        (7, prose(300, 2)),
        (7, prose(300, 2)),
        (7, prose(300, 3)),
        (8, prose(300, 2)),
        (None, prose(120, 4)),
        (None, prose(120, 4)),
        (None, None),
        (10, "line feed\n" * 80),
        (11, "a" * 3000),
        (-5, "日本語 text 😀 " * 60),
    ]
    return rows


@pytest.fixture(scope="session")
def messy(spark):
    """The messy rows with extra columns named like the operators' own."""
    rows = [(*r, *["x"] * len(CLASHES)) for r in messy_rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHES))


@pytest.fixture(scope="session")
def no_rows(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(7, 1, 0), (8, 1, 0), (8, 0, 0), (10, 0, 1), (None, 1, 0), (3, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
