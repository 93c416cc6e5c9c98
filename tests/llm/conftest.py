import random

import pytest

#: Column names that operators use inside; a table may bring them along.
EXTRA = ["score", "kept", "n", "fp", "batch", "label", "h", "name", "key", "size", "words", "rid"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)


def words_of(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def make_rows():
    """Nulls, empty and very long texts, ties, repeated rows, copies and near copies."""
    rng = random.Random(5)
    base = [words_of(rng, rng.choice([3, 20, 60, 200])) for _ in range(25)]
    long = words_of(rng, 9000, 5000)
    texts = [*base, None, "", "", "   \t\n", long, long.upper(), long + " tail", base[3], base[3].upper(), base[4], "Ä" * 50,
             "ä" * 50, "a b", "A b", "one", "x" * 5000, "é​z " * 300, "line\n" * 40 + "this is a line that repeats\n" * 3]
    texts += [base[7].replace("w1", "w2", 1), base[8] + " w9", " ".join(base[9].split()[:-1]) + " w7"]
    texts += [f"head {k}\nthis is a line that repeats\n" + base[10] for k in range(4)]
    rows = [(k, t, "en", None if k % 11 == 3 else f"s{k % 4}", None if t is None else len(t)) for k, t in enumerate(texts)]
    rows += [rows[2], rows[2], (None, "no id", None, None, None), (None, base[5], None, None, None), (None, None, None, None, None)]
    return [r + tuple(f"x{k % 3}" for _ in EXTRA) for k, r in enumerate(rows)]


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(rows):
    """(doc_id, text) of each row."""
    return [(r[0], r[1]) for r in rows]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x) for x in r))
