"""Nothing is lost at an edge, by size, or without a word."""

import json
import random
import re
import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from hushframe.functions.detectors import (
    GROUP,
    AnyDetector,
    BatchDetector,
    PatternDetector,
    ip_detector,
    replaced,
    windows,
)
from hushframe.operators import calls, merge
from hushframe.operators import entities as e
from hushframe.operators.profiles import Profile, profile_table
from hushframe.operators.redact import redact_json, redact_table, redact_text
from hushframe.sources.tables import workspace

IP = "192.168.100.200"


def python_ips(answered=None):
    def make_client():
        import re

        find = re.compile(r"(?<![A-Za-z0-9_])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![A-Za-z0-9_])").finditer
        return lambda texts: [[("IP_ADDRESS", m.start(), m.end()) for m in find(t)] for t in texts][:answered]

    return BatchDetector(make_client)


OFFSETS = [*range(4480, 4506), *range(8980, 9010)]


@pytest.mark.parametrize("filler", ["x", "é", "w "])
@pytest.mark.parametrize("detector", [ip_detector(), python_ips()], ids=["native", "python"])
def test_an_address_at_every_offset_around_an_edge(spark, detector, filler):
    rows = []
    for at in OFFSETS:
        head = (filler * at)[: at - 1] + "-"
        rows.append((at, head + IP + "-" + (filler * 9000)[:9000]))
    df = spark.createDataFrame(rows, "key long, text string")
    for r in e.redact_deep(df, ["text"], detector=detector).collect():
        text = dict(rows)[r.key]
        assert (r.text, r.redaction_count) == (text.replace(IP, "[REDACTED:IP_ADDRESS]"), 1)


NAME = "Ann Lee"
SLID = [*range(4400, 4601), *range(8900, 9101)]


def python_rules():
    def make_client():
        find = re.compile(r"Ann Lee|(?<![A-Za-z0-9_])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![A-Za-z0-9_])").finditer
        return lambda texts: [[("NAME" if m[0][0] == "A" else "IP_ADDRESS", m.start(), m.end()) for m in find(t)] for t in texts]

    return BatchDetector(make_client)


@pytest.mark.parametrize("filler", ["w ", "some words\n", "x"])
@pytest.mark.parametrize("path", ["python", "table of python", "table of native", "native"])
def test_no_entity_is_lost_or_doubled_wherever_it_lies(spark, path, filler):
    rows, want = [], {}
    for i, at in enumerate(SLID):
        for j, (entity, kind) in enumerate(((NAME, "NAME"), (IP, "IP_ADDRESS"))):
            head, tail = (filler * at)[: at - 1] + "-", "-" + (filler * 9000)[:9000]
            rows.append((2 * i + j, head + entity + tail))
            want[2 * i + j] = (f"{head}[REDACTED:{kind}]{tail}", 1)
    df = spark.createDataFrame(rows, "key long, text string").repartition(8)
    native = AnyDetector(ip_detector(), PatternDetector("NAME", NAME))
    detector = native if "native" in path else python_rules()
    if "table" in path:
        found = e.detect_entities(e.chunk_rows(df, "key", ["text"]), detector, "key")
        done = e.redact_with_entities(df, found, "key", ["text"])
    else:
        done = e.redact_entities(df, detector, ["text"])
    assert {r.key: (r.text, r.redaction_count) for r in done.collect()} == want


@pytest.mark.parametrize("filler", ["w ", "x"])
def test_an_entity_longer_than_a_halo_is_put_together(spark, filler):
    """Windows show parts of it; what they cover together is one placeholder."""

    def make_client():
        find = re.compile(r"Q+").finditer
        return lambda texts: [[("NAME", m.start(), m.end()) for m in find(t)] for t in texts]

    detector = BatchDetector(make_client)
    rows = [(n, (filler * 4000)[:4000] + "-" + "Q" * n + "-" + filler * 3000) for n in (200, 600, 3000, 6000, 20_000)]
    df = spark.createDataFrame(rows, "key long, text string")
    found = e.detect_entities(e.chunk_rows(df, "key", ["text"]), detector, "key")
    for done in (e.redact_entities(df, detector, ["text"]), e.redact_with_entities(df, found, "key", ["text"])):
        for r in done.collect():
            assert (r.text, r.redaction_count) == (dict(rows)[r.key].replace("Q" * r.key, "[REDACTED:NAME]"), 1)


def test_paths_agree_on_overlapping_rules(spark):
    """An allowed entity is not hidden by a kind that is not allowed, and nothing of a span survives."""
    rng = random.Random(8)
    rules = [("DATE_TIME", r"[0-9]+\.[0-9]+\.[0-9]+"), ("IP_ADDRESS", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"), ("AGE", "[0-9]x+"), ("NAME", "x+y?")]
    detector = AnyDetector(*[PatternDetector(*r) for r in rules])
    rows = [(i, "".join(rng.choices(["1", ".", "10.0.0.1", "x", "y", " ", "é"], k=rng.randrange(1, 25)))) for i in range(10_000)]
    df = spark.createDataFrame(rows, "key long, text string").repartition(8)
    found = e.detect_entities(e.chunk_rows(df, "key", ["text"]), detector, "key")
    for types in (None, ["IP_ADDRESS"], ["IP_ADDRESS", "NAME"], ["NAME", "AGE"]):
        want = {}
        for i, t in rows:
            spans = [(k, m.start(), m.end()) for k, p in rules for m in re.finditer(p, t)]
            text, n, kinds = replaced(t, spans, set(types or [k for k, _ in rules]))
            want[i] = text, n, list(dict.fromkeys(kinds))
        for done in (
            e.redact_entities(df, detector, ["text"], types=types),
            e.redact_with_entities(df, found, "key", ["text"], types),
        ):
            assert {r.key: (r.text, r.redaction_count, r.redacted_types) for r in done.collect()} == want
    one = spark.createDataFrame([("addr 10.0.0.1 x",)], "text string")
    row = e.redact_entities(one, detector, types=["IP_ADDRESS"]).first()
    assert (row.text, row.redaction_count) == ("addr [REDACTED:IP_ADDRESS] x", 1)


def test_spans_of_a_table_take_time_by_their_number(spark):
    def seconds(lines):
        text = "\n".join(f"{i % 250}.1.2.3 and some words" for i in range(lines))
        df = spark.createDataFrame([(1, text)], "key long, text string")
        found = e.detect_entities(e.chunk_rows(df, "key"), ip_detector(), "key").cache()
        assert found.count() == lines
        began = time.perf_counter()
        assert e.redact_with_entities(df, found, "key").first().redaction_count == lines
        return time.perf_counter() - began

    seconds(1000)
    half = seconds(40_000)
    whole = seconds(80_000)
    assert whole < 12 and whole < 2 * half + 2


def test_windows_own_a_text_without_gaps_and_overlap_at_every_cut():
    for text in ("a" * 50, "ab cd " * 20, "é" * 33 + "\n" + "x" * 7, "", "\n\n", "x y" * 3 + "z" * 40, "😀" * 30):
        found = windows(text, 16)
        at = 0
        for begin, end, own, cut in found:
            assert len(text[begin:end].encode()) <= 16
            assert begin <= own <= cut <= end and own == at
            at = cut
            wide = len(text[max(0, own - 1) : own].encode()) > 2  # a halo is two bytes here
            assert own == 0 or begin < own or wide
        assert at == len(text)


def test_replacing_spans_unites_overlaps():
    spans = [("NAME", 0, 4), ("AGE", 5, 7), ("URL", 0, 1), ("NAME", None, 3)]
    assert replaced("Jane 42!", spans, {"NAME", "AGE"}) == ("[REDACTED:NAME] [REDACTED:AGE]!", 2, ["AGE", "NAME"])
    overlapping = [("B", 2, 4), ("A", 0, 3), ("C", 3, 9), ("D", 9, 9), ("E", 7, 2), ("F", 99, 100)]
    assert replaced("abcdef", overlapping, set("ABCDEF")) == ("[REDACTED:A]", 1, ["A"])
    assert replaced("abcdef", [("A", 0, 3), ("B", 2, 4)], {"A", "B"}, parity=True)[0] == "[REDACTED:A]REDACTED:B]ef"


def test_several_rules_with_groups_in_one_pass(spark):
    rules = AnyDetector(PatternDetector("AGE", "(4)(2)"), PatternDetector("NAME", "J(o)hn|Jane"), ip_detector())
    df = spark.createDataFrame([(1, f"Jane 42 {IP} John 42"), (2, None), (3, "none")], "key long, text string")
    got = {r.key: r for r in e.redact_entities(df, rules, types=["AGE", "NAME"]).collect()}
    assert got[1].text == f"[REDACTED:NAME] [REDACTED:AGE] {IP} [REDACTED:NAME] [REDACTED:AGE]"
    assert (got[1].redaction_count, got[1].redacted_types) == (4, ["AGE", "NAME"])
    assert (got[2].text, got[3].text) == (None, "none")


@pytest.mark.parametrize("detector", [ip_detector(), python_ips()], ids=["native", "python"])
def test_cost_follows_the_length_of_a_text(spark, detector):
    def seconds(lines):
        text = "\n".join(f"{i % 250}.1.2.3 and some forty characters of other text" for i in range(lines))
        df = spark.createDataFrame([(1, text)], "key long, text string")
        began = time.perf_counter()
        assert e.redact_deep(df, ["text"], detector=detector).first().redaction_count == lines
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(80_000) < 4 * seconds(20_000) + 3


@pytest.mark.parametrize("detector", [ip_detector(), python_ips()], ids=["native", "python"])
def test_cost_follows_the_number_of_texts(spark, detector):
    df = spark.createDataFrame([(1, [f"at 10.0.{i % 250}.1" for i in range(16_000)])], "key long, lines array<string>")
    began = time.perf_counter()
    assert e.redact_deep(df, ["lines"], detector=detector).first().redaction_count == 16_000
    assert time.perf_counter() - began < 10


@pytest.mark.parametrize("detector", [ip_detector(), python_ips()], ids=["native", "python"])
def test_records_of_every_shape(spark, detector):
    schema = (
        "key long, s string, a array<array<string>>, m map<string, struct<x: string, n: int>>, "
        "r struct<`a.b`: string, `a{b`: string, l: array<struct<t: string>>>"
    )
    row = (
        1, IP, [[IP, None], None, [f"{IP} {IP}"]], {"k": (IP, 1), "l": (None, 2), IP: None},
        ("pl" + "x" * len(IP) + "less", IP, [(IP,), None]),
    )
    got = e.redact_deep(spark.createDataFrame([row, (2, None, None, None, None)], schema), detector=detector)
    one, two = got.orderBy("key").collect()
    x = "[REDACTED:IP_ADDRESS]"
    assert (one.s, one.a, one.redaction_count) == (x, [[x, None], None, [f"{x} {x}"]], 7)
    assert {k: v and tuple(v) for k, v in one.m.items()} == {"k": (x, 1), "l": (None, 2), IP: None}
    assert (one.r[0], one.r[1], [t and t.t for t in one.r[2]]) == ("pl" + "x" * len(IP) + "less", x, [x, None])
    assert (two.redaction_count, two.redacted_types) == (0, [])


def test_paths_of_like_names_stay_apart(spark):
    schema = "key long, r struct<`a.b`: string, a: struct<b: string>>, m map<string, string>, `r.a` struct<b: string>"
    df = spark.createDataFrame([(1, ("harmless text", ("John",)), {"x]": "John", "x": "other"}, ("John",))], schema)
    chunks = e.chunk_rows(df, "key")
    paths = [r.path for r in chunks.collect()]
    assert len(set(paths)) == 5
    found = e.detect_entities(chunks, PatternDetector("NAME", "John"), "key")
    row = e.redact_with_entities(df, found, "key").first()
    assert (row.r[0], row.r.a.b, row["r.a"].b, row.redaction_count) == (
        "harmless text", "[REDACTED:NAME]", "[REDACTED:NAME]", 3,
    )
    assert row.m == {"x]": "[REDACTED:NAME]", "x": "other"}


def test_a_client_must_answer_every_text(spark):
    df = spark.createDataFrame([(1, [IP, IP, IP])], "key long, lines array<string>")
    for answered in (1, 0):
        with pytest.raises(Exception, match="answered"):
            e.redact_deep(df, ["lines"], detector=python_ips(answered)).collect()
        with pytest.raises(Exception, match="answered"):
            e.detect_entities(e.chunk_rows(df, "key"), python_ips(answered), "key").collect()


def test_a_client_gets_bounded_groups(spark):
    def make_client():
        def client(texts):
            assert len(texts) <= GROUP
            return [[] for _ in texts]

        return client

    df = spark.createDataFrame([(1, ["x"] * 2000)], "key long, lines array<string>")
    assert e.redact_deep(df, ["lines"], detector=BatchDetector(make_client)).first().redaction_count == 0


def test_merging_kinds_that_no_list_names(spark):
    rows = [(1, 0, 2, ["CUSTOM", "email"]), (1, 1, 3, ["NAME", "CUSTOM"]), (2, 0, 0, []), (3, 1, 1, ["b"]), (3, 0, 1, ["a"])]
    df = spark.createDataFrame(rows, "k int, pos int, redaction_count int, redacted_types array<string>")
    got = {r.k: (r.redaction_count, r.redacted_types) for r in merge.merge_groups(df, ["k"], "pos").collect()}
    assert got == {1: (5, ["CUSTOM", "email", "NAME"]), 2: (0, []), 3: (2, ["a", "b"])}


def test_user_columns_are_kept(spark):
    item = "array<struct<uri: string, mimeType: string, text: string, blob: string>>"
    df = spark.createDataFrame([("full", [("u", None, "a@b.co", None)], 7, "mine")], f"profile string, contents {item}, redaction_count int, entity_types string")
    row = calls.redact_resources(df).first()
    assert (row.contents[0].text, row.redaction_count, row.entity_types) == ("a***@b.co", 7, "mine")
    df = spark.createDataFrame([("a@b.co", 5, "w", "m")], "text string, redaction_count int, _walk_0 string, _masked string")
    for done in (redact_text(df, "text"), redact_table(df, ["text"]), e.redact_deep(df, ["text"], detector=ip_detector())):
        row = done.first()
        assert (row.text, row.redaction_count, row.redaction_count_input) == ("a***@b.co", 1, 5)
        assert (row["_walk_0"], row["_masked"]) == ("w", "m")


def test_text_keys_are_masked_after_the_join(spark):
    df = spark.createDataFrame([("a@b.co", "Hi John")], "mail string, text string")
    table = spark.createDataFrame(
        [("a@b.co", "text", 0, 0, "NAME", 3, 7)],
        "mail string, path string, chunk_idx int, ordinal int, type string, begin int, end int",
    )
    row = e.redact_deep(df, entities=table, key="mail").first()
    assert (row.mail, row.text, row.redaction_count, row.redacted_types) == (
        "a***@b.co", "Hi [REDACTED:NAME]", 2, ["email", "NAME"],
    )
    assert e.redact_deep(df, ["text"], entities=table, key="mail").first().mail == "a@b.co"


def test_profile_names_are_unique(spark):
    twice = [Profile("GDPR", True, True), Profile("GDPR", True, False)]
    with pytest.raises(ValueError, match="same name"):
        profile_table(spark, twice)


def test_stray_entities_never_reach_an_array(spark):
    df = spark.range(3).select(F.col("id").alias("key"), F.lit("Hello John").alias("text"))
    made = {"chunk_idx": F.lit(0), "ordinal": F.col("id").cast("int"), "type": F.lit("NAME")}
    stray = spark.range(200_000).select(
        F.lit(1).cast("long").alias("key"), F.when(F.col("id") % 2 == 0, "text").otherwise("unknown").alias("path"),
        *[c.alias(n) for n, c in made.items()], F.lit(50).alias("begin"), F.lit(60).alias("end"),
    )
    chunks = e.chunk_rows(df, "key", ["text"])
    hits = e.join_hits(df, chunks, stray, "key")
    assert {r.n for r in hits.select(F.size("_hits").alias("n")).collect()} == {0}


# --- JSON and VARIANT -------------------------------------------------------


def test_json_is_told_alike_at_any_size(spark):
    big = '{"k@x.co": "' + "a" * 21_000_000 + ' a@b.co"}'
    deep = "[" * 1100 + '{"k@x.co": "a@b.co"}' + "]" * 1100
    df = spark.createDataFrame([(1, big), (2, deep), (3, '{"k@x.co": "a@b.co"}')], "i int, doc string")
    for r in redact_json(df, "doc").collect():
        assert r.redaction_count == 1 and '"k@x.co": "' in r.doc and "a***@b.co" in r.doc


@pytest.mark.parametrize(
    "text", ["a@b.co", "{a@b.co", '["a@b.co"', '{"a@b.co"}', '["a@b.co" "c"]', '["x",] a@b.co', "[,]a@b.co", '{"a": "a@b.co"]', "a@b.co 12"]
)
def test_what_is_no_document_is_plain_text(spark, text):
    row = redact_json(spark.createDataFrame([(text,)], "doc string"), "doc").first()
    assert row.doc == text.replace("a@b.co", "a***@b.co")


@pytest.mark.parametrize(
    "doc", ['{"a@b.co": 1}', "[]", "4111111111111111", "[4111111111111111, -1.5e3, true, null]", '{"a@b.co": {"c@d.ee": [{}, [[]]]}}']
)
def test_keys_and_numbers_of_documents_stay(spark, doc):
    row = redact_json(spark.createDataFrame([(doc,)], "doc string"), "doc").first()
    assert (row.doc, row.redaction_count) == (doc, 0)


@pytest.mark.parametrize(
    "text",
    [
        '{"a":"bad \\x jane@example.com"}', '{"a":"raw\n \\" jane@example.com"}', '{"a":[4111111111111111}]',
        '{"a":1,4111111111111111}', "[1:4111111111111111]", "[4111111111111111]]", "{4111111111111111:1}",
        '["\ufdd2", \ufdd2, 4111111111111111]', '[04111111111111111, "jane@example.com"]',
        "[" * 30 + "4111111111111111" + "]" * 29 + "}",
    ],
)
def test_malformed_documents_are_plain_text(spark, text):
    df = spark.createDataFrame([(text,)], "doc string")
    plain = redact_text(df.withColumnRenamed("doc", "t"), "t").first()
    row = redact_json(df, "doc").first()
    assert (row.doc, row.redaction_count) == (plain.t, plain.redaction_count)


def test_a_literal_beyond_the_parser_is_masked(spark):
    doc = '{"k": "\\t' + "a" * 20_100_000 + ' a@b.co"}'
    row = redact_json(spark.createDataFrame([(doc,)], "doc string"), "doc").first()
    assert row.redaction_count == 1 and "a@b.co" not in row.doc


def test_documents_are_those_of_a_parser(spark):
    """10,000 documents with one edit each: numbers of documents stay, those of other texts are masked."""
    rng = random.Random(9)
    card = "4111111111111111"

    def value(depth):
        kind = rng.randrange(7 if depth < 7 else 4)
        if kind > 3:
            inner = [value(depth + 1) for _ in range(rng.randrange(4))]
            return inner if kind == 4 else {f"k{i}": x for i, x in enumerate(inner)}
        return [rng.randrange(100), rng.choice(["s", 'q"', "\\", "\t", "é"]), rng.choice([None, True, False]), -1.5e9][kind]

    def strict(text):
        def refuse(_):
            raise ValueError

        try:
            json.loads(text, parse_constant=refuse)
        except (ValueError, RecursionError):
            return False
        return True

    rows = []
    for i in range(10_000):
        text = json.dumps([int(card), value(0), {"x": value(1)}], indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)
        at = rng.randrange(text.index(",") + 1, len(text))  # behind the number
        edit = rng.choice(list('{}[]:,"\\0 1.-etrue\n\t') + ["", "null", "{}", "[]"])
        rows.append((i, text[:at] + edit + text[at + rng.randrange(2) :]))
    df = spark.createDataFrame(rows, "i int, doc string").repartition(8)
    wrong = [rows[r.i][1] for r in redact_json(df, "doc").collect() if (card in r.doc) != strict(rows[r.i][1])]
    assert not wrong
    kept = sum(strict(t) for _, t in rows)
    assert 1000 < kept < 9000


def test_json_deep(spark):
    doc = {"a": [f"{IP} \"q\"", {"m": "a@b.co 10.0.0.1", "10.0.0.1": 7}], "n": 4111111111111111}
    df = spark.createDataFrame([(json.dumps(doc),), (None,), ("plain " + IP,)], "doc string")
    got = e.redact_json_deep(df, "doc", detector=ip_detector()).collect()
    x = "[REDACTED:IP_ADDRESS]"
    assert json.loads(got[0].doc) == {"a": [f"{x} \"q\"", {"m": f"a***@b.co {x}", "10.0.0.1": 7}], "n": 4111111111111111}
    assert (got[0].redaction_count, got[0].redacted_types) == (3, ["email", "IP_ADDRESS"])
    assert (got[1].doc, got[1].redaction_count, got[2].doc) == (None, 0, "plain " + x)
    with pytest.raises(ValueError, match="native"):
        e.redact_json_deep(df, "doc", detector=python_ips())


def test_variant(spark):
    df = spark.range(1).select(
        F.parse_json(F.lit('{"e": "a@b.co", "n": 1, "l": ["10.0.0.1"]}')).alias("v"),
        F.array(F.struct(F.parse_json(F.lit('"c@d.ee"')).alias("w"))).alias("s"),
    )
    row = redact_table(df).select(F.to_json("v").alias("v"), F.to_json(F.col("s")[0]["w"]).alias("w"), "redaction_count").first()
    assert (json.loads(row.v), row.w, row.redaction_count) == ({"e": "a***@b.co", "n": 1, "l": ["10.0.0.1"]}, '"c***@d.ee"', 2)
    deep = e.redact_deep(df, detector=ip_detector()).select(F.to_json("v").alias("v"), "redaction_count").first()
    assert (json.loads(deep.v)["l"], deep.redaction_count) == (["[REDACTED:IP_ADDRESS]"], 3)
    with pytest.raises(ValueError, match="VARIANT"):
        e.redact_entities(df, python_ips())


def test_workspace_needs_a_shared_folder(spark, tmp_path):
    assert workspace(spark, "x", f"file://{tmp_path}/").startswith(f"file://{tmp_path}/x-")
    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        workspace(unset, "x")


@pytest.mark.parametrize(
    "value", ["4111\t1111\n1111\r1111", "4111 1111 1111 1111", "a@b.co", "+31\f6 1234 5678", "123-45-6789"]
)
def test_escapes_in_documents(spark, value):
    for doc in (json.dumps([value]), json.dumps([value]).replace("@", "\\u0040").replace("+", "\\u002b")):
        row = redact_json(spark.createDataFrame([(doc,)], "doc string"), "doc").first()
        assert row.redaction_count == 1
        assert json.loads(row.doc) != [value]
