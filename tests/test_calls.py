import pytest
from pyspark.sql import functions as F

from hushframe.functions.detectors import PatternDetector, ip_detector
from hushframe.operators import calls as c
from hushframe.operators import merge
from hushframe.operators import profiles as p
from hushframe.operators.redact import redact_text
from hushframe.plans.chain import compose
from test_entities import python_detector

SCHEMA = (
    "call_id long, is_error boolean, failure string, profile string, "
    "content array<struct<type:string,text:string,data:string,mimeType:string>>"
)


def text(value):
    return ("text", value, None, None)


def image(value):
    return ("image", None, value, "image/png")


def run(spark, *rows, **options):
    given = [(i, *r) for i, r in enumerate(rows)]
    done = c.redact_calls(spark.createDataFrame(given, SCHEMA), **options)
    return [
        (None if r.content is None else [tuple(b) for b in r.content], r.redaction_count, r.redacted_types)
        for r in done.orderBy("call_id").collect()
    ]


def test_blocks(spark):
    rows = run(
        spark,
        (False, None, "DORA", [text("mail jane@example.com"), image("a@b.co"), text("123-45-6789 x@y.zz")]),
        (True, None, "DORA", [text("error for a@b.co")]),
        (None, None, "DORA", []),
        (False, None, "DORA", None),
        (False, "down", "DORA", [text("a@b.co")]),
        (False, None, "DORA", [text(None), (None, "a@b.co", None, None)]),
    )
    assert rows == [
        ([text("mail j***@example.com"), image("a@b.co"), text("***-**-**** x***@y.zz")], 3, ["email", "ssn"]),
        ([text("error for a@b.co")], 0, []),
        ([], 0, []),
        (None, 0, []),
        ([text("a@b.co")], 0, []),
        ([text(None), (None, "a@b.co", None, None)], 0, []),
    ]


@pytest.mark.parametrize("detector", [PatternDetector("NAME", "John"), python_detector()])
def test_two_stages_by_profile(spark, detector):
    blocks = [text("John 4111111111111111"), image("John"), text("a@b.co John")]
    rows = run(
        spark,
        *[(False, None, name, blocks) for name in ("GDPR", "DORA", "full", "nobody knows")],
        detector=detector,
    )
    deep = [text("[REDACTED:NAME] ************1111"), image("John"), text("a***@b.co [REDACTED:NAME]")]
    first = [text("John ************1111"), image("John"), text("a***@b.co John")]
    kinds = ["credit_card", "NAME", "email"]
    assert rows == [
        (deep, 4, kinds), (first, 2, ["credit_card", "email"]), (deep, 4, kinds), (deep, 4, kinds),
    ]


def test_entity_kinds_of_a_profile(spark):
    row = (False, None, "GDPR", [text("host 10.0.0.1")])
    assert run(spark, row, detector=ip_detector()) == [([text("host 10.0.0.1")], 0, [])]
    # Observed: the subset of a profile is not read.
    assert run(spark, row, detector=ip_detector(), parity=True) == [
        ([text("host [REDACTED:IP_ADDRESS]")], 1, ["IP_ADDRESS"])
    ]


def test_first_stage_off_switches_off_both(spark):
    off = (*p.PROFILES, p.Profile("off", stage1=False, stage2=True))
    row = (False, None, "off", [text("a@b.co 10.0.0.1")])
    assert run(spark, row, detector=ip_detector(), profiles=off) == [([text("a@b.co 10.0.0.1")], 0, [])]


def test_resources(spark):
    df = spark.createDataFrame(
        [("u", [("u", "text/plain", "SSN 123-45-6789", None), ("u", None, None, "a@b.co")]), ("v", None)],
        "uri string, contents array<struct<uri:string,mimeType:string,text:string,blob:string>>",
    )
    done = c.redact_resources(df, profile="GDPR")
    assert done.columns == df.columns
    rows = {r.uri: r.contents for r in done.collect()}
    assert [tuple(x) for x in rows["u"]] == [
        ("u", "text/plain", "SSN ***-**-****", None), ("u", None, None, "a@b.co"),
    ]
    assert rows["v"] is None


def test_profiles(spark):
    table = {r.name: r for r in p.profile_table(spark).collect()}
    assert tuple(table) == p.PROFILE_NAMES == ("GDPR", "DORA", "PCI_DSS", "full")
    assert [(r.stage1, r.stage2) for r in table.values()] == [
        (True, True), (True, False), (True, False), (True, True),
    ]
    assert table["GDPR"].entity_types == ["NAME", "ADDRESS", "DATE_TIME", "PASSPORT_NUMBER", "DRIVER_ID"]
    assert len(table["full"].entity_types) == 12
    assert p.get_profile("PCI_DSS").name == "PCI_DSS"
    assert p.get_profile("gdpr").name == "GDPR"
    df = spark.createDataFrame([("full",), ("FULL",), (None,)], "profile string")
    rows = p.with_profile(df).select("profile", "profile_name", "profile_fallback").collect()
    assert {tuple(r) for r in rows} == {("full", "full", False), ("FULL", "GDPR", True), (None, "GDPR", True)}


def test_merge_groups_keeps_order_and_survives_a_hot_key(spark):
    """A third of all rows on one key, spread over all tasks before the shuffle."""
    n = 30_000
    blocks = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 100).alias("call_id"),
        F.col("id").alias("block_idx"),
        F.element_at(
            F.array(F.lit("none"), F.lit("+15551234567 a@b.co"), F.lit("123-45-6789")),
            (F.col("id") % 7 % 3 + 1).cast("int"),
        ).alias("text"),
    )
    done = merge.merge_groups(redact_text(blocks, "text"), ["call_id"], "block_idx")
    rows = {r.call_id: r for r in done.collect()}
    assert len(rows) == 101

    def expected(ids):
        kinds, total = [], 0
        for i in ids:
            here = [[], ["email", "phone"], ["ssn"]][i % 7 % 3]
            total += len(here)
            kinds += [k for k in here if k not in kinds]
        return total, kinds

    assert (rows[-1].redaction_count, rows[-1].redacted_types) == expected(range(0, n, 3))
    assert (rows[5].redaction_count, rows[5].redacted_types) == expected(
        i for i in range(n) if i % 3 and i % 100 == 5
    )


def test_compose_order(spark):
    df = spark.createDataFrame([("a",)], "x string")
    add = lambda suffix: lambda d: d.withColumn("x", F.concat("x", F.lit(suffix)))
    assert compose(add("b"), add("c"))(df).first().x == "abc"
    assert compose()(df).first().x == "a"
