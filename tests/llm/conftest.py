from __future__ import annotations

import random

import pytest

WORDS = ["the", "and", "house", "Über", "straße", "señor", "niño", "déjà", "vu", "cat", "dog,", "runs!", "x1", "42", "a|b", "under", "river", "stone"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string, hits long, size double, label int, db int, key string, fp string, found int"
EXTRA = ("w", 1, 0.5, 3, 9, "k", "f", 7)


def text(seed: int, n: int) -> str:
    r = random.Random(seed)
    return "".join(r.choice(WORDS) + r.choice([" ", " ", " ", "\n", "  "]) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls in each column, empty and long texts, exact and near copies, repeated rows and shared passages."""
    shared = text(99, 40)
    out = []
    for i in range(40):
        t = text(i, 5 + 7 * i) + (shared if i % 5 == 0 else "")
        out.append((i, t, "en" if i % 2 else "de", f"s{i % 4}", len(t)))
    out += [(100, out[20][1], "en", "s0", 1), (101, out[20][1] + "tail", "en", None, 1), (102, out[30][1].replace("house", "hut", 1), None, "s1", None)]
    out += [(103, None, "en", "s1", None), (104, "", "de", "s2", 0), (105, " \n\t ", None, None, 0), (106, "one", "en", "s9", 3), (106, "one", "en", "s9", 3), (107, "... !!! 12", "en", "s0", 1)]
    out += [(None, out[10][1], "en", "s0", 5), (None, None, None, None, None), (108, text(7, 6000), "en", "s3", 1), (109, "nbsp here <|endoftext|> \x1c y", "en", "s3", 1)]
    return [r + EXTRA for r in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(45)] + [(3, None, 1), (None, 1, 0), (999, 0, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def benchmark(spark):
    shared = text(99, 40)
    return spark.createDataFrame([(1, shared), (2, shared[:90]), (3, "x1 42"), (3, "x1 42"), (4, None), (5, "... !"), (None, shared), (6, "never seen words at all in any of these documents today")], "item_id long, text string")
