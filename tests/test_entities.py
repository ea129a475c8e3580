import random
import re
import time

import model
import pytest
from pyspark.sql import functions as F

from hushframe.functions import spans as s
from hushframe.functions.detectors import (
    AnyDetector,
    BatchDetector,
    PatternDetector,
    ip_detector,
    replaced,
)
from hushframe.operators import entities as e

KEYED = "key long, path string, chunk_idx int, ordinal int, type string, begin int, end int"


def one_text(spark, text, rows, types=None, **options):
    df = spark.createDataFrame([(1, text)], "key long, text string")
    table = spark.createDataFrame([(1, "text", *r) for r in rows], KEYED)
    done = e.redact_with_entities(df, table, "key", ["text"], types, **options).first()
    return done.text, done.redaction_count, done.redacted_types


def test_no_entities(spark):
    assert one_text(spark, "Nothing to see.", []) == ("Nothing to see.", 0, [])


def test_one_name(spark):
    rows = [(0, 0, "NAME", 6, 14)]
    assert one_text(spark, "Dear: Ada Byte; regards", rows) == (
        "Dear: [REDACTED:NAME]; regards", 1, ["NAME"],
    )


def test_last_span_first(spark):
    rows = [(0, 0, "NAME", 0, 3), (0, 1, "ADDRESS", 12, 20)]
    assert one_text(spark, "Bob sits at 7 Quay 9, now", rows) == (
        "[REDACTED:NAME] sits at [REDACTED:ADDRESS], now", 2, ["ADDRESS", "NAME"],
    )


def test_other_kinds_and_missing_offsets_are_ignored(spark):
    text = "Paid: 4111111111111111"
    rows = [
        (0, 0, "CREDIT_DEBIT_NUMBER", 6, 22),
        (0, 1, "NAME", None, 3),
        (0, 2, "NAME", 1, None),
        (0, 3, None, 1, 2),
    ]
    assert one_text(spark, text, rows) == (text, 0, [])


def test_allow_list(spark):
    rows = [(0, 0, "NAME", 0, 4), (0, 1, "AGE", 5, 7)]
    assert one_text(spark, "Jane 42", rows, ["AGE"]) == ("Jane [REDACTED:AGE]", 1, ["AGE"])


def test_overlapping_spans_use_their_own_offsets(spark):
    rnd = random.Random(5)
    text = "abcdefghijklmnopqrstuvwxyz"
    cases = []
    for i in range(200):
        spans = []
        for _ in range(rnd.randint(1, 4)):
            begin = rnd.randint(0, 20)
            kind = rnd.choice(["NAME", "AGE", "ADDRESS"])
            spans.append((kind, begin, begin + rnd.randint(1, 6)))
        cases.append((i, text, spans))
    schema = f"i int, text string, spans array<{s.SPAN}>"
    df = spark.createDataFrame(cases, schema)
    done = df.select("i", F.expr(s.apply_spans("text", s.spans_desc("spans"))).alias("t"))
    for i, got in done.collect():
        assert got == model.splice(text, cases[i][2])


def test_entities_anywhere_in_a_text_count(spark):
    text = "\n".join(["w" * 99] * 60) + "\nJohn"
    late = [(1, 0, "NAME", 1500, 1504)]  # 45 lines make the first chunk
    assert one_text(spark, text, late)[:2] == (text[:-4] + "[REDACTED:NAME]", 1)
    assert one_text(spark, text, late, parity=True)[:2] == (text[:-4] + "[REDACTED:NAME]", 1)


def test_prefilter_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "x")], "key long, text string")
    table = spark.createDataFrame(
        [(1, "text", 1, 0, "NAME", 1500, 1504), (2, "text", 0, 0, "URL", 0, 3)], KEYED
    )
    kept = e.prefilter(df, table, "key")
    assert sorted(r.key for r in kept.collect()) == [1, 2]


def test_parity_joins_cut_lines_with_a_line_feed(spark):
    text = "x" * 4500 + "John" + "y" * 100
    rows = [(1, 0, "NAME", 0, 4), (0, 0, "URL", 0, 1)]
    assert one_text(spark, text, rows)[0] == "x" * 4500 + "[REDACTED:NAME]" + "y" * 100
    assert one_text(spark, text, rows, parity=True)[0] == (
        "x" * 4500 + "\n[REDACTED:NAME]" + "y" * 100
    )


def test_offsets_of_pattern_spans(spark):
    rnd = random.Random(2)
    texts = [
        "".join(rnd.choice(["10.0.0.1", "é", " ", "1.2.3.4.5.6.7.8", "\U0001f600", "x"]) for _ in range(9))
        for _ in range(300)
    ]
    pattern = re.compile(r"(?<![A-Za-z0-9_])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![A-Za-z0-9_])")
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    found = df.select("i", F.expr(ip_detector().spans_of("text")).alias("s"))
    for i, spans in found.collect():
        assert [tuple(x) for x in spans] == [
            ("IP_ADDRESS", m.start(), m.end()) for m in pattern.finditer(texts[i])
        ]


def test_chunk_rows_with_spans_are_united_and_spliced(spark):
    rnd = random.Random(7)
    cases = []
    for i in range(300):
        text = "".join(rnd.choice("abc é\U0001f600\ufdd0" if i % 2 else "abcdef") for _ in range(90))
        spans = []
        for _ in range(rnd.randint(0, 70)):
            begin = rnd.randint(-2, 92)
            spans.append((rnd.choice(["NAME", "AGE", "URL"]), begin, begin + rnd.randint(-1, 6)))
        cases.append((i, text, spans))
    df = spark.createDataFrame(cases, f"i int, text string, spans array<{s.SPAN}>")
    for row in e.redact_chunk_rows(df, ["NAME", "AGE"]).collect():
        _, text, spans = cases[row.i]
        value, n, kinds = replaced(text, [(k, a, min(b, len(text))) for k, a, b in spans], {"NAME", "AGE"})
        assert (row.text, row.redaction_count, row.redacted_types) == (value, n, list(dict.fromkeys(kinds)))


def test_spans_of_texts_that_hold_the_mark(spark):
    texts = ["", "John", "\ufdd0John", "xJohnJohn\ufdd0 John\ufdd0", "\ufdd0"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for i, spans in df.select("i", F.expr(PatternDetector("NAME", "John").spans_of("text"))).collect():
        assert [tuple(x) for x in spans] == [("NAME", m.start(), m.end()) for m in re.finditer("John", texts[i])]


def test_many_spans_of_one_chunk_take_linear_time(spark):
    detector = AnyDetector(PatternDetector("NAME", "[A-Z][a-z]+ [a-z]+"), PatternDetector("ADDRESS", "[a-z]+[.]"))

    def seconds(n):
        df = spark.range(1).select(F.repeat(F.lit("Ada byte. "), n).alias("text"))
        found = df.select("text", F.expr(detector.spans_of("text")).alias("spans"))
        began = time.perf_counter()
        row = e.redact_chunk_rows(found).first()
        assert row.redaction_count == n and row.text == "[REDACTED:NAME] " * n
        return time.perf_counter() - began

    seconds(100)
    assert seconds(20_000) < 6


def python_detector():
    pattern = "John"

    def make():
        find = re.compile(pattern).finditer
        return lambda texts: [[("NAME", m.start(), m.end()) for m in find(t)] for t in texts]

    return BatchDetector(make)


LONG = "\n".join(["filler text " * 9] * 60)


def nested(spark):
    rows = [
        (1, ("Ann a@b.co", [f"John\n{LONG}\nJohn John", None, "x"]), {"k": "from John"}, 5),
        (2, ("nobody", []), {}, 6),
        (3, None, None, None),
    ]
    return spark.createDataFrame(
        rows, "key long, doc struct<head:string, parts:array<string>>, tags map<string,string>, n int"
    )


@pytest.mark.parametrize("source", ["native", "python", "table"])
def test_nested_records_from_every_source(spark, source):
    df = nested(spark)
    native = PatternDetector("NAME", "John")
    if source == "table":
        chunks = e.chunk_rows(df, "key")
        options = {"entities": e.detect_entities(chunks, python_detector(), "key"), "key": "key"}
    else:
        options = {"detector": native if source == "native" else python_detector()}
    done = {r.key: r for r in e.redact_deep(df, exclude=["key"], **options).collect()}
    assert done[1].doc.head == "Ann a***@b.co"
    assert done[1].doc.parts[0] == (
        f"[REDACTED:NAME]\n{LONG}\n[REDACTED:NAME] [REDACTED:NAME]"
    )
    assert done[1].doc.parts[1:] == [None, "x"]
    assert done[1].tags == {"k": "from [REDACTED:NAME]"}
    assert (done[1].redaction_count, done[1].redacted_types) == (5, ["email", "NAME"])
    assert (done[2].redaction_count, done[2].redacted_types) == (0, [])
    assert done[3].doc is None and done[3].redaction_count == 0
    assert done[1].n == 5


def test_native_and_table_entities_agree(spark):
    df = nested(spark)
    chunks = e.chunk_rows(df, "key")
    detector = AnyDetector(PatternDetector("NAME", "John"), PatternDetector("AGE", "filler"))
    found = e.detect_entities(chunks, detector, "key")
    one = e.redact_deep(df, detector=detector)
    two = e.redact_deep(df, entities=found, key="key")
    # Kinds come in order of discovery: in whole texts, and chunk by chunk.
    one, two = (d.withColumn("redacted_types", F.array_sort("redacted_types")) for d in (one, two))
    assert sorted(map(str, one.collect())) == sorted(map(str, two.select(one.columns).collect()))


def test_stage_two_off_is_stage_one(spark):
    df = spark.createDataFrame([(1, "a@b.co 10.0.0.1")], "key long, text string")
    row = e.redact_deep(df, ["text"]).first()
    assert (row.text, row.redaction_count) == ("a***@b.co 10.0.0.1", 1)


def test_orphans_and_null_keys_do_not_matter(spark):
    """A third of all entities on a key that no text has, and on the null key."""
    df = spark.range(100).select(F.col("id").alias("key"), F.lit("Hello John").alias("text"))
    good = df.select(
        "key", F.lit("text").alias("path"), F.lit(0).alias("chunk_idx"), F.lit(0).alias("ordinal"),
        F.lit("NAME").alias("type"), F.lit(6).alias("begin"), F.lit(10).alias("end"),
    )
    hot = spark.range(20_000).select(
        F.when(F.col("id") % 2 == 0, F.lit(-1)).cast("long").alias("key"),
        F.lit("text").alias("path"), F.lit(0).alias("chunk_idx"), F.lit(0).alias("ordinal"),
        F.lit("NAME").alias("type"), F.lit(6).alias("begin"), F.lit(10).alias("end"),
    )
    done = e.redact_with_entities(df, good.union(hot), "key", ["text"])
    assert [tuple(r) for r in done.groupBy("text", "redaction_count").count().collect()] == [
        ("Hello [REDACTED:NAME]", 1, 100)
    ]
    chunks = e.chunk_rows(df, "key", ["text"])
    joined = e.entities_to_chunks(chunks, good.union(hot), "key")
    assert joined.agg(F.count("*"), F.sum(F.size("spans"))).first()[:] == (100, 100)


def test_copies_of_entities_count_once(spark):
    """Half of all entity rows are copies of those of one text."""
    df = spark.range(50).select(F.col("id").alias("key"), F.lit("Hello John").alias("text"))
    table = spark.range(0, 20_000, 1, 8).select(
        F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 50).cast("long").alias("key"),
        F.lit("text").alias("path"), F.lit(0).alias("chunk_idx"), F.lit(0).alias("ordinal"),
        F.lit("NAME").alias("type"), F.lit(6).alias("begin"), F.lit(10).alias("end"),
    )
    done = e.redact_with_entities(df, table, "key", ["text"])
    rows = {r.key: (r.text, r.redaction_count) for r in done.collect()}
    assert rows[7] == rows[9] == ("Hello [REDACTED:NAME]", 1)
    assert len(rows) == 50
