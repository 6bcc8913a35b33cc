"""Small tables with awkward rows, shared by the tests of the training-data operators."""

import random

WORDS = "the of and river stone light walks under green hill slow water house bird winter road".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


def awkward(spark):
    """Nulls, empty, blank, repeated and long texts, and columns with clashing names."""
    rng = random.Random(3)
    long = prose(rng, 60_000)
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "One  two\tthree."), (5, "One two three."), (5, "One two three."),
            (None, "One two three."), (None, None), (6, long), (7, "a"), (8, "日本語 é ß 👍 <|endoftext|> x\x1cy")]
    return spark.createDataFrame([(i, t, "s", 9, 1.5, "z", 0, False) for i, t in rows],
                                 "doc_id long, text string, id string, row int, score double, sha string, a int, kept boolean")
