import random

import pytest

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs():
    """Rows (doc_id, text, lang, source, n_chars) of every kind that is easily mishandled."""
    rng = random.Random(5)
    passage = sentence(rng, 60)
    long = sentence(rng, 30_000, 5000)
    once = sentence(rng, 90)
    texts = [
        None, "", "   \n\t ", "one", "two words", "A b  C", once, once, once.upper(), once + " tail",
        sentence(rng, 40) + " " + passage + "\n" + sentence(rng, 40), passage, passage + " x " + passage,
        "é Ünï 漢字 " + sentence(rng, 50), "same " * 200, "aa bb " * 80, long, long + " end",
        " nbsp stays " + sentence(rng, 36), "x" * 100_000, "line one\nline one\n\nline one\n" * 20,
    ]
    rows = [(i, t, "en", "src0" if i % 3 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [(100, once, None, "src1", 1), (100, once, None, "src1", 1)]  # a repeated row
    rows += [(101, sentence(rng, 50), "de", "src2", 0), (101, sentence(rng, 70), "de", "src2", 0)]  # a tie
    rows += [(None, sentence(rng, 80), "fr", "src3", None), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_docs):
    return spark.createDataFrame(odd_docs, DDL)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DDL)
