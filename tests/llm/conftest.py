import random

import pytest

WORDS = "the of and to in is was for on with alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def text(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with copies, near copies, shared passages, nulls, empties, one long text, and a column of a clashing name."""
    shared = text(1, 40)
    base = text(2, 120).split(" ")
    near = base.copy()
    near[60] = "changed"
    out = [
        (0, text(3, 80)),
        (1, text(4, 30) + " " + shared + " " + text(5, 30)),
        (2, shared + "\n" + text(6, 20)),
        (3, " ".join(base)),
        (4, " ".join(near)),
        (5, "  ".join(base) + "\t"),
        (6, None),
        (7, ""),
        (8, "   \n\t"),
        (9, "one"),
        (10, "ONE"),
        (11, "one two"),
        (12, text(7, 20_000)),
        (13, text(3, 80)),
        (14, "é à ü <|endoftext|> " + text(8, 15)),
        (None, shared),
        (None, None),
        (15, text(9, 12)),
        (15, text(9, 12)),
        (16, "x" * 40_000),
        (17, text(7, 300)),
    ]
    return [(i, t, "n_words", 5) for i, t in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, n long").repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, kept string, n long")
