import json
import random

import model
import pytest
from pyspark.sql import types as T

from hushframe.functions.detectors import AnyDetector, PatternDetector
from hushframe.functions.nested import pattern_leaf
from hushframe.operators.entities import native_leaf
from hushframe.operators.redact import redact_json, redact_table, text_columns
from hushframe.operators.reports import pii_findings_deep

ORDERS = {
    "page": {"of": 9},
    "orders": [
        {"nr": 17, "paid": {"card": "4111 1111 1111 1111", "from": "NL91ABNA0417164300", "sum": 12.5},
         "by": {"mail": "ada@shop.example", "tel": "+31 6 1234 5678", "number": "123-45-6789"}},
        {"nr": 18, "paid": {"card": "4111 1111 1111 1112", "sum": 3.0}, "by": {"name": "Ada"}},
        {"nr": 19, "paid": {"card": "4000-0000-0000-0002"}, "note": "ask bo@shop.example or 321-54-9876"},
    ],
}
SCHEMA = (
    "page struct<of:int>, orders array<struct<nr:int,paid:struct<card:string,`from`:string,sum:double>,"
    "by:struct<mail:string,tel:string,number:string,name:string>,note:string>>"
)


def test_deep_struct(spark):
    df = spark.createDataFrame(
        [((("eve@mail.example", "321-54-9876"),),)], "user struct<contact:struct<email:string,ssn:string>>"
    )
    row = redact_table(df).first()
    assert tuple(row.user.contact) == ("e***@mail.example", "***-**-****")
    assert (row.redaction_count, row.redacted_types) == (2, ["email", "ssn"])


def test_array(spark):
    df = spark.createDataFrame([(["cy@one.example", None, "di@two.example"],)], "emails array<string>")
    row = redact_table(df).first()
    assert row.emails == ["c***@one.example", None, "d***@two.example"]
    assert row.redaction_count == 2


def test_map_keys_stay(spark):
    df = spark.createDataFrame([({"x@y.com": "a@b.co", "n": None},)], "m map<string,string>")
    row = redact_table(df).first()
    assert row.m == {"x@y.com": "a***@b.co", "n": None}


def test_other_types_pass(spark):
    df = spark.createDataFrame(
        [(42, True, None, 4111111111111111, b"a@b.co")],
        "count int, active boolean, nothing void, card long, raw binary",
    )
    row = redact_table(df).first()
    assert row[:5] == (42, True, None, 4111111111111111, bytearray(b"a@b.co"))
    assert (row.redaction_count, row.redacted_types) == (0, [])


def test_null_containers(spark):
    schema = "s struct<a:string>, l array<string>, m map<string,string>, n array<array<struct<x:string>>>"
    df = spark.createDataFrame(
        [(None, None, None, None), ((None,), [], {}, [None, [], [None, ("a@b.co",)]])], schema
    )
    first, second = redact_table(df).collect()
    assert first[:4] == (None, None, None, None) and first.redaction_count == 0
    assert second.n[2][1].x == "a***@b.co" and second.redaction_count == 1
    assert redact_table(df).schema[:4] == df.schema[:4]


def test_kinds_in_order_of_discovery(spark):
    df = spark.createDataFrame([("a@b.co", ["123-45-6789", "c@d.ee"], "+15551234567")], "a string, b array<string>, c string")
    assert redact_table(df).first().redacted_types == ["email", "ssn", "phone"]


def test_choice_of_columns(spark):
    df = spark.createDataFrame([("a@b.co", "c@d.ee", "e@f.gg")], "a string, b string, c string")
    row = redact_table(df, include=["a", "b"], exclude=["b"]).first()
    assert row[:4] == ("a***@b.co", "c@d.ee", "e@f.gg", 1)
    assert text_columns(df, exclude=["a"]) == ["b", "c"]


def test_names_that_need_quoting(spark):
    schema = T.StructType([T.StructField("a b", T.StructType([T.StructField("c.d `e'", T.StringType())]))])
    df = spark.createDataFrame([(("a@b.co",),)], schema)
    row = redact_table(df).first()
    assert row[0][0] == "a***@b.co"


def walk(value, found):
    if isinstance(value, str):
        text, n, kinds, _ = model.redact(value)
        found.extend([n, k] for k in kinds[:1] or [None])
        walk.kinds += [k for k in kinds if k not in walk.kinds]
        return text
    if isinstance(value, list):
        return [walk(v, found) for v in value]
    if isinstance(value, dict):
        return {k: walk(v, found) for k, v in value.items()}
    return value


def expected(value):
    found, walk.kinds = [], []
    redacted = walk(value, found)
    return redacted, sum(n for n, _ in found), walk.kinds


def test_payload_with_and_without_schema(spark):
    text = json.dumps(ORDERS)
    df = spark.createDataFrame([(text,)], "doc string")
    redacted, n, kinds = expected(ORDERS)
    plain = redact_json(df, "doc").first()
    assert json.loads(plain.doc) == redacted
    assert (plain.redaction_count, plain.redacted_types) == (n, kinds) == (8, kinds)
    typed = redact_json(df, "doc", SCHEMA).first()
    assert typed.redaction_count == 8
    assert typed.doc.orders[1].paid.card == "4111 1111 1111 1112"
    assert typed.doc.orders[2].note == redacted["orders"][2]["note"]


def test_random_json_against_model(spark):
    rnd = random.Random(4)
    words = [
        "a@b.co", 'say "hi" c@d.ee', "back\\", "tab\t4111\t1111\t1111\t1111", "\ufdd0x@y.zz\ufdd1", "é\n",
        "123-45-6789", "plain", "", "\\u0040", ": ", '"', "/", "\u2028 \x01",
    ]

    def value(depth):
        kind = rnd.random()
        if depth and kind < 0.3:
            return [value(depth - 1) for _ in range(rnd.randint(0, 3))]
        if depth and kind < 0.6:
            return {rnd.choice(words) + str(i): value(depth - 1) for i in range(rnd.randint(0, 3))}
        return rnd.choice([None, True, 1500.0, 4111111111111111, *words])

    values = [value(3) for _ in range(600)]
    texts = [json.dumps(v, ensure_ascii=bool(i % 2), indent=i % 3 or None) for i, v in enumerate(values)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, doc string").repartition(8)
    for i, doc, n, kinds in redact_json(df, "doc").collect():
        redacted, count, found = expected(values[i])
        assert json.loads(doc) == redacted, texts[i]
        assert (n, kinds) == (count, found), texts[i]
        if not count:
            assert doc == texts[i]


def test_text_that_is_not_json(spark):
    df = spark.createDataFrame([("see a@b.co {",), (None,)], "doc string")
    assert [r.doc for r in redact_json(df, "doc").collect()] == ["see a***@b.co {", None]


def test_findings_at_any_depth(spark):
    schema = "k long, a struct<`x.y`: string, n: int>, l array<array<string>>, m map<string, string>, t string"
    rows = [
        (1, ("mail nora.field@example.org", 4), [["SSN 123-45-6789", None], None, []], {"a[b": "nora.field@example.org"}, "quiet"),
        (2, None, None, None, None),
        (3, ("", None), [["+14155550123 and +14155550124"]], {}, "x@y.org"),
    ]
    df = spark.createDataFrame(rows, schema)
    found = pii_findings_deep(df, "k")
    assert found.columns == ["k", "path", "type", "ordinal", "masked"]
    got = sorted((r["k"], r["type"], r["ordinal"], r["masked"]) for r in found.collect())
    assert [g[:3] for g in got] == [
        (1, "email", 0), (1, "email", 0), (1, "ssn", 0), (3, "email", 0), (3, "phone", 0), (3, "phone", 1),
    ]
    assert not any("nora" in g[3] or "6789" in g[3] for g in got)
    paths = {r["path"] for r in found.collect()}
    assert {"l[0][0]", "t"} <= paths and len(paths) == 4
    # As many as the redaction counts.
    done = {r["k"]: r["redaction_count"] for r in redact_table(df, exclude=["k"]).collect()}
    assert done == {1: 3, 2: 0, 3: 3}
    assert pii_findings_deep(df, "k", ["t"]).count() == 1
    assert pii_findings_deep(df.limit(0), "k").collect() == []
    with pytest.raises(ValueError, match="result column"):
        pii_findings_deep(df.withColumnRenamed("k", "path"), "path")
    with pytest.raises(ValueError, match="VARIANT"):
        pii_findings_deep(df.selectExpr("k", "array(parse_json('1')) v"), "k")


def test_variant_is_written_as_text_once_and_each_rule_scans_its_text_once():
    detector = AnyDetector(PatternDetector("NAME", "[A-Z][a-z]+"), PatternDetector("AGE", "[0-9]+ years", "[0-9] y"))
    for leaf in (pattern_leaf, native_leaf(detector, "array('NAME', 'AGE')")):
        assert leaf.variant("v").count("to_json(v)") == 1
    assert detector.redacted("t", "array('NAME', 'AGE')").count("t RLIKE") == 1  # the hint that is no pattern


def test_variant_of_many_types(spark):
    row = "named_struct('d', double('NaN'), 'q', 'say \"a@b.co\" \\\\ é', 'n', 4111111111111111, 'k@x.yz', array(date'2024-01-02', null))"
    df = spark.sql(f"SELECT 1 AS id, to_variant_object({row}) AS v")
    done = redact_table(df).selectExpr("to_json(v) AS v", "redaction_count AS n").first()
    assert (json.loads(done.v), done.n) == (
        {"d": "NaN", "q": 'say "a***@b.co" \\ é', "n": 4111111111111111, "k@x.yz": ["2024-01-02", None]}, 1
    )
