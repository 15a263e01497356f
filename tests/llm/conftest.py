import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, block long, row long, kept boolean, cluster long"


def _words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def edge_rows():
    """NULL in any column, empty and long texts, ties, repeated rows, near copies, odd characters."""
    rng = random.Random(5)
    base = [_words(rng, 60) for _ in range(6)]
    texts = [None, "", " \n\t ", "one", "One  two\n\nthree", *base, base[0], base[0].upper()]
    texts += [base[1] + " tail", "head " + base[2], base[3].replace(" ", "\n", 9)]
    texts += ["a<|endoftext|>b  <|endoftext|> c", "\x85 \x1c x y　z", "héé 日本語 🙂 ½ ²", "it's we'll 'S \r\n x"]
    texts += [_words(rng, 20000, 9000), "x" * 5000, "same line\n" * 40, "the the the the " * 30, "%%% ### $$$ " * 40]
    rows = [(k, t, "en" if k % 3 else None, "s", k, 7, 8, 9, True, 1) for k, t in enumerate(texts)]
    return rows + [rows[7], rows[7], (None, base[4], None, None, None, None, None, None, None, None), (None, None, "en", "s", 1, 1, 1, 1, False, 1)]


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int, text string")


@pytest.fixture(scope="session")
def some_labels(spark):
    rows = [(k, k % 2, (k + 1) % 2, "x") for k in range(28)] + [(3, None, None, "y"), (4, 1, 0, None), (None, 1, 1, "z")]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


def same(left, right):
    """Two lists of rows hold the same rows."""
    assert sorted(map(tuple, left), key=repr) == sorted(map(tuple, right), key=repr)
