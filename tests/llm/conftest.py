import random

import pytest
from pyspark.sql import types as T

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, and columns whose names clash."""
    rng = random.Random(7)
    words = ["alpha", "Beta", "gamma", "delta", "épsilon", "zeta", "漢字", "eta."]
    long = " ".join(rng.choice(words) + str(rng.randrange(500)) for _ in range(30_000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \t\n ", "en", "s", 4), (4, "one two", "en", "s", 7),
        (4, "one two", "en", "s", 7), (4, "other words under the same id here", None, "s", 9), (None, "no id at all here", "en", None, None),
        (5, long, "en", "s", len(long)), (6, long + " tail", "en", "s", None), (7, "ONE two", "fr", "s", 7), (8, "x", "en", "s", 1),
        (None, None, None, None, None),
    ]
    extra = [(*r, i, f"f{i}", float(i), "k") for i, r in enumerate(rows)]
    return spark.createDataFrame(extra, f"{DOCS}, fingerprint int, component string, node double, key string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], T.StructType.fromDDL(DOCS))


def smallest_reachable(nodes, edges):
    """Brute force: the smallest node that each one reaches."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}
