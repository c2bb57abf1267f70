import numpy as np
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, node string, _s string, weight int, keys string, copies int, label int"


def prose(rng, n, words=400):
    return " ".join(f"w{rng.integers(words)}" for _ in range(n))


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and blank texts, ties, repeated rows and ids, one very long text, clashing names."""
    rng = np.random.default_rng(1)
    a, b = prose(rng, 60), prose(rng, 60)
    long = prose(rng, 250_000, 5_000)
    texts = [(1, a), (2, a), (3, a + " tail"), (4, b), (5, ""), (6, None), (7, " \n\t "), (8, "one two"), (9, "one two"), (10, "!!! ??? ..."), (11, long), (12, long + " end"), (13, "Ünïcode ñ 漢字 😀 \u0000 x" * 5), (4, b), (14, "x"), (14, prose(rng, 30)), (None, a), (None, None), (2**62, b)]
    rows = [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else f"s{k % 2}", None, "high", "n", "q", 3, "k", 7, 1) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def edge_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (4, 1, 1), (8, None, None), (None, 1, 1), (11, 1, 0), (99, 0, 1)], "doc_id long, quality int, toxic int")
