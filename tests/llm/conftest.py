import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, h string, _row string"


def sample_rows():
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "épsilon", "zeta", "Eta", "theta,", "iota.", "κάππα"]

    def text(n):
        return " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))

    rows = [(i, text(rng.randrange(5, 160)), rng.choice(["en", "de", None]), rng.choice(["a", "b", "ß", None]), 1) for i in range(60)]
    long = text(9000)
    rows += [(60, None, "en", "a", None), (61, "", "en", "a", 0), (62, " \n\t ", None, "b", 4), (63, long, "en", "b", 5), (64, long + " more", "en", "b", 5)]
    rows += [(65, rows[0][1], "de", "c", 3), (66, rows[0][1].upper(), "de", "c", 3), (None, rows[1][1], None, None, None), (None, None, None, None, None)]
    rows += [rows[2]] * 3 + [(67, "one", "en", "a", 3), (68, "one two", "en", "a", 7), (69, "one two", "en", "a", 7)]
    return [(*r, "x", "y", "z") for r in rows]


@pytest.fixture(scope="session")
def docs(spark):
    """Rows with nulls, empty, white and very long texts, copies, repeated rows, and extra columns whose names clash with the operators' own."""
    return spark.createDataFrame(sample_rows(), SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(60)] + [(None, 1, 0), (3, None, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")
