import random

import model
import pytest
from pyspark.sql import functions as F

from hushframe.functions.chunks import chunk_text, reassemble


def texts(seed, n=600):
    rnd = random.Random(seed)
    for _ in range(n):
        lines = []
        for _ in range(rnd.choice([1, 2, 5, 12])):
            width = rnd.choice([0, 0, 1, 3, 8, 20, 50])
            lines.append("".join(rnd.choices("aé€\U0001f600b ", k=width)))
        yield "\n".join(lines)


@pytest.mark.parametrize("limit", [8, 20, 33])
def test_against_model(spark, limit):
    given = list(texts(limit))
    df = spark.createDataFrame(list(enumerate(given)), "i int, text string").select(
        "i",
        F.expr(chunk_text("text", limit)).alias("ours"),
        F.expr(chunk_text("text", limit, parity=True)).alias("observed"),
    )
    joined = df.withColumn("joined", F.expr(reassemble("ours")))
    for i, ours, observed, whole in joined.collect():
        assert whole == given[i]
        assert all(model.size(c.text) <= limit for c in ours)
        # The SQL of the catalog states them exactly; here what holds of them. Only line
        # feeds are lost or gained, none begins a chunk, and what is over the limit is
        # one line.
        shown = [c.text for c in observed]
        assert "".join(shown).replace("\n", "") == given[i].replace("\n", "")
        if len(shown) > 1 or model.size(given[i]) > limit:
            assert not any(t.startswith("\n") for t in shown)
        assert all(model.size(t) <= limit or "\n" not in t for t in shown)
        for c in [*ours, *observed]:
            assert given[i][c.start : c.start + len(c.text)] == c.text


def chunk(spark, text, **options):
    df = spark.createDataFrame([(text,)], "text string")
    return df.select(F.expr(chunk_text("text", **options))).first()[0]


def test_short_text_is_one_chunk(spark):
    assert [tuple(c) for c in chunk(spark, "Hello, world!")] == [("Hello, world!", "", 0)]
    assert [tuple(c) for c in chunk(spark, "")] == [("", "", 0)]
    assert chunk(spark, None) is None


@pytest.mark.parametrize("parity", [False, True])
def test_splits_at_line_ends(spark, parity):
    text = "\n".join(["a" * 100] * 46)
    found = chunk(spark, text, parity=parity)
    assert len(found) > 1
    assert all(model.size(c.text) <= 4500 for c in found)
    assert "\n".join(c.text for c in found) == text


def test_long_line_behind_a_short_one(spark):
    text = "short\n" + "x" * 10_000
    assert max(model.size(c.text) for c in chunk(spark, text)) == 4500
    # Observed: the long line stays whole and goes over the limit.
    assert [model.size(c.text) for c in chunk(spark, text, parity=True)] == [5, 10_000]


def test_blank_lines(spark):
    text = "\n\n" + "\n".join(["b" * 99] * 60) + "\n\n"
    ours = chunk(spark, text)
    assert "".join(c.text + c.sep for c in ours) == text
    observed = chunk(spark, text, parity=True)
    assert "\n".join(c.text for c in observed) != text


def test_very_long_line(spark):
    text = "€" * 400_000
    found = chunk(spark, text)
    assert "".join(c.text for c in found) == text
    assert len(found) == -(-400_000 // 1500)
