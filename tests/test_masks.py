import random

import model
import pytest
from pyspark.sql import functions as F

from hushframe.functions import masks
from hushframe.operators.redact import mask_text, redact_text
from hushframe.operators.reports import pii_findings, redaction_summary

# text, masked text, count, kinds
EXAMPLES = [
    ("4111-1111-1111-1111", "****-****-****-1111", 1, ["credit_card"]),
    ("4111 1111 1111 1111", "**** **** **** 1111", 1, ["credit_card"]),
    ("1234-5678-9012-3456", "1234-5678-9012-3456", 0, []),
    ("123-45-6789", "***-**-****", 1, ["ssn"]),
    ("john.doe@bank.com", "j***@bank.com", 1, ["email"]),
    ("NL91ABNA0417164300", "NL91****4300", 1, ["iban"]),
    ("NL91ABNA041716", "NL91ABNA041716", 0, []),
    ("NL91ABNA0417164", "NL91****7164", 1, ["iban"]),
    ("NL91" + "A" * 30, "NL91****AAAA", 1, ["iban"]),
    ("NL91" + "A" * 31, "NL91" + "A" * 31, 0, []),
    ("ACTIVE", "ACTIVE", 0, []),
    ("+31 6 1234 5678", "+31***78", 1, ["phone"]),
    ("+15551234567", "+15***67", 1, ["phone"]),
    ("+1 555-123-4567", "+1 555-123-4567", 0, []),
    ("4111111111111111@x.com", "************1***@x.com", 2, ["credit_card", "email"]),
    ("é4111111111111111", "é************1111", 1, ["credit_card"]),
    ("4111 1111-1111 1111", "****-****-****-1111", 1, ["credit_card"]),
    ("4111\u00a01111\u00a01111\u00a01111", "************1111", 1, ["credit_card"]),
    ("a@b.co-x@y.com", "a***@b.co-***@y.com", 2, ["email"]),
    ("--a@b.co", "--a***@b.co", 1, ["email"]),
    ("a@b.co.x@y.com", "a***@b.co.***@y.com", 2, ["email"]),
    ("a@b@c.de", "a@b***@c.de", 1, ["email"]),
    ("two 4111111111111111 1234567890123456 5500000000000004",
     "two ************1111 1234567890123456 ************0004", 2, ["credit_card"]),
    ("", "", 0, []),
    (None, None, 0, []),
]


def adversarial(seed, n):
    rnd = random.Random(seed)
    seeds = [
        "4111111111111111", "4111 1111 1111 1111", "1234-5678-9012-3456", "5500000000000004",
        "123-45-6789", "john.doe@bank.com", "NL91ABNA0417164300", "+31 6 1234 5678",
        "+15551234567", "a@b.co", "-x@y.com", "%+-@q.zz", "DE8937040044", "a.b-c.d_e",
    ]
    glue = list(" .-_@+%*/\n\t") + ["\u00a0", "é", "\u2028", "A", "z", "0", "7", "42"]
    for _ in range(n):
        parts = []
        for _ in range(rnd.randint(1, 6)):
            piece = rnd.choice(seeds)
            if rnd.random() < 0.4:  # damage it
                at = rnd.randrange(len(piece))
                piece = piece[:at] + rnd.choice(glue) + piece[at + rnd.randint(0, 1) :]
            parts += [piece, "".join(rnd.choices(glue, k=rnd.randint(0, 3)))]
        yield "".join(parts)


def test_examples(spark):
    df = spark.createDataFrame([(i, e[0]) for i, e in enumerate(EXAMPLES)], "i int, text string")
    rows = redact_text(df, "text").orderBy("i").collect()
    for row, (_, masked, n, kinds) in zip(rows, EXAMPLES, strict=True):
        assert (row.text, row.redaction_count, row.redacted_types) == (masked, n, kinds)


def test_agrees_with_model_on_adversarial_text(spark):
    texts = list(adversarial(7, 12000))
    expected = [model.redact(t) for t in texts]
    assert sum(e[1] > 0 for e in expected) > 5000
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(8)
    done = redact_text(df, "text").select("i", "text", "redaction_count", "redacted_types")
    for i, text, n, kinds in done.collect():
        assert (text, n, kinds) == expected[i][:3], texts[i]
    found = {}
    for i, kind, ordinal, masked in sorted(
        pii_findings(df, "i", "text").collect(),
        key=lambda r: (r[0], list(masks.MASKS).index(r[1]), r[2]),
    ):
        found.setdefault(i, []).append((kind, masked))
    assert found == {i: e[3] for i, e in enumerate(expected) if e[3]}


def test_inside_a_lambda_as_at_top_level(spark):
    texts = list(adversarial(11, 500))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    inner = masks.redact("x")
    nested = df.select("i", F.expr(f"transform(array(text, 'a@b.co'), x -> {inner})").alias("r"))
    for i, results in nested.collect():
        value, n, each = results[0]
        assert (value, n, list(dict.fromkeys(each))) == tuple(model.redact(texts[i])[:3])
        assert len(each) == n
        assert tuple(results[1]) == ("a***@b.co", 1, ["email"])


@pytest.mark.parametrize("kind", list(masks.MASKS))
def test_one_mask_alone(spark, kind):
    texts = list(adversarial(13, 800))
    pattern, mask = {k: (p, m) for k, p, m in model.STEPS}[kind]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for i, text, n in mask_text(df, "text", kind).collect():
        assert text == pattern.sub(lambda m: mask(m.group()), texts[i])
        assert n == sum(mask(m) != m for m in pattern.findall(texts[i]))


def test_long_run_without_address_is_read_once(spark):
    # A pattern that restarts at every boundary would need some 10^11 steps.
    run = "k1-" * 300_000
    df = spark.createDataFrame([(f"{run} a@b.co {run}",)], "text string")
    row = redact_text(df, "text").first()
    assert row.text == f"{run} a***@b.co {run}"


def test_luhn(spark):
    numbers = ["4111111111111111", "1234 5678 9012 3456", "79927398713", "79927398714"]
    df = spark.createDataFrame([(n,) for n in numbers], "n string")
    valid = [r[0] for r in df.select(F.expr(masks.luhn_valid("n"))).collect()]
    assert valid == [True, False, True, False] == [model.luhn(n) for n in numbers]


def test_column_names_that_need_quoting(spark):
    df = spark.createDataFrame([("a@b.co",)], "`my text` string")
    assert redact_text(df, "my text").first()[0] == "a***@b.co"


def test_summary(spark):
    df = spark.createDataFrame(
        [("x", "a@b.co 123-45-6789"), ("x", "c@d.ee"), ("y", "nothing")], "src string, text string"
    )
    rows = redaction_summary(redact_text(df, "text", counts=True), ["src"]).collect()
    assert {tuple(r) for r in rows} == {
        ("x", "email", 2, 2), ("x", "ssn", 1, 1), ("y", None, 1, 0),
    }


def test_summary_counts_each_kind_for_itself(spark):
    text = "4111111111111111 a@b.co c@d.ee e@f.gg"
    df = spark.createDataFrame([("x", text)], "src string, text string")
    rows = redaction_summary(redact_text(df, "text", counts=True), ["src"]).collect()
    assert {tuple(r) for r in rows} == {("x", "credit_card", 1, 1), ("x", "email", 1, 3)}
