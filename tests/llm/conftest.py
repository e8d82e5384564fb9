import random

import pytest

WORDS = ["alpha", "beta", "gamma", "delta", "épée", "Über", "mit", "license", "under", "the", "cc", "by", "nc", "42", "x1"]


@pytest.fixture(scope="session")
def texts():
    """doc_id -> text: random prose with shared passages, copies, blanks and one very long text."""
    draw = random.Random(4)
    prose = lambda n: " ".join(draw.choice(WORDS) + draw.choice(["", "", ",", "."]) for _ in range(n))
    shared, out = prose(60), {}
    for i in range(60):
        kind = i % 6
        if kind == 0:
            out[i] = prose(draw.randint(1, 90))
        elif kind == 1:
            out[i] = f"{prose(25)}\n{shared}\t{prose(5)}"
        elif kind == 2:
            out[i] = shared
        elif kind == 3:
            out[i] = "same words again " * draw.randint(1, 30)
        elif kind == 4:
            out[i] = draw.choice(["", " \n ", "one", "one two", "Ünï çødé x"])
        else:
            out[i] = None
    out[60] = prose(20_000) + " " + shared
    return out


@pytest.fixture(scope="session")
def rows(texts):
    return [(i, t, "en" if i % 2 else None, f"src{i % 4}" if i % 7 else None, len(t or "")) for i, t in texts.items()]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """The documents with columns named as the operators' own."""
    from pyspark.sql import functions as F

    names = "fp cell queue ids score toxic fold row hits words kept label n block shard n_words runs spans size n_tokens"
    return docs.select("*", *(F.lit(None).cast("string").alias(c) for c in names.split()))


@pytest.fixture(scope="session")
def broken(spark, rows):
    """A null id, rows that repeat, and a null in every column."""
    return spark.createDataFrame([*rows[:12], rows[0], rows[0], (None, "lost words " * 30, None, None, None), (None,) * 5], SCHEMA)
