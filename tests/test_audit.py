import json
from datetime import datetime, timezone

from pyspark.sql import functions as F

from hushframe.operators import audit as a
from hushframe.operators.calls import redact_calls
from hushframe.sources.tables import jsonl_writer, workspace, write_audit

SCHEMA = (
    "call_id long, tool_name string, arguments string, started_at timestamp, finished_at timestamp, "
    "failure string, profile string, is_error boolean, "
    "content array<struct<type:string,text:string,data:string,mimeType:string>>"
)


def at(millis):
    return datetime.fromtimestamp(1704067200 + millis / 1000, tz=timezone.utc)


def calls(spark, *rows):
    base = {
        "tool_name": "search", "arguments": '{"q":1}', "started_at": at(0), "finished_at": at(245),
        "failure": None, "profile": "GDPR", "is_error": None, "content": [("text", "clean response", None, None)],
    }
    names = SCHEMA.replace("struct<type:string,text:string,data:string,mimeType:string>", "x").split(", ")
    order = [n.split()[0] for n in names]
    given = [tuple((base | {"call_id": i} | r)[n] for n in order) for i, r in enumerate(rows)]
    return spark.createDataFrame(given, SCHEMA)


def records(spark, *rows, **options):
    done = a.audit_lines(a.audit_log(redact_calls(calls(spark, *rows)), **options))
    return [json.loads(r.line) for r in done.collect()]


def test_success(spark):
    (entry,) = records(spark, {"content": [("text", "mail a@b.co", None, None)]})
    assert list(entry) == list(a.AUDIT_COLUMNS[:-1])
    size = len(json.dumps({"content": [{"type": "text", "text": "mail a***@b.co"}]}, separators=(",", ":")))
    assert entry == {
        "timestamp": "2024-01-01T00:00:00.245Z", "upstream_tool": "search", "compliance_profile": "GDPR",
        "input_parameters": '{"q":1}', "execution_time_ms": 245, "output_size_bytes": size,
        "redaction_count": 1, "redacted_types": ["email"], "status": "success",
    }


def test_error_result_and_failure(spark):
    error, failure = records(
        spark,
        {"is_error": True, "content": [("text", "a@b.co", None, None)]},
        {"failure": "upstream down", "content": None},
    )
    assert (error["status"], error["redaction_count"], error["redacted_types"]) == ("error", 0, [])
    assert "error_message" not in error and error["output_size_bytes"] > 0
    assert failure["status"] == "error" and failure["error_message"] == "upstream down"
    assert (failure["output_size_bytes"], failure["redaction_count"]) == (0, 0)


def test_no_raw_data_in_the_log(spark):
    row = {"arguments": '{"to":"a@b.co"}', "failure": "no route to c@d.ee"}
    (entry,) = records(spark, row)
    assert entry["input_parameters"] == '{"to":"a***@b.co"}'
    assert entry["error_message"] == "no route to c***@d.ee"
    # Observed: both are logged as they are.
    (entry,) = records(spark, row, parity=True)
    assert entry["input_parameters"] == row["arguments"]
    assert entry["error_message"] == row["failure"]


def test_truncation(spark):
    (entry,) = records(spark, {"arguments": "x" * 600})
    assert entry["input_parameters"] == "x" * 500 + "...[truncated]"
    # A match across the cut is masked, not halved.
    (entry,) = records(spark, {"arguments": "x" * 490 + " 4111111111111111"})
    assert "4111" not in entry["input_parameters"]
    exact, absent = records(spark, {"arguments": "x" * 500}, {"arguments": None})
    assert exact["input_parameters"] == "x" * 500
    assert absent["input_parameters"] == "{}"


def test_unknown_profile_is_logged_as_the_fallback(spark):
    (entry,) = records(spark, {"profile": "what"})
    assert entry["compliance_profile"] == "GDPR"


def test_size_counts_bytes_of_the_redacted_result(spark):
    text = 'é "quoted"\n  x'
    (entry,) = records(spark, {"content": [("text", text, None, None)]})
    body = json.dumps(
        {"content": [{"type": "text", "text": text}]}, separators=(",", ":"), ensure_ascii=False
    )
    assert entry["output_size_bytes"] == len(body.encode())


def test_timestamp_is_utc_in_any_session(spark):
    df = calls(spark, {"finished_at": at(-86_400_000 * 20000 + 7)}, {"finished_at": at(1_999)})
    shown = df.select(a.iso_utc(F.col("finished_at")).alias("t"))
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert [r.t for r in shown.collect()] == ["1969-03-30T00:00:00.007Z", "2024-01-01T00:00:01.999Z"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_stats_from_a_table(spark):
    df = calls(spark, {}, {})
    stats = spark.createDataFrame(
        [(0, 3, ["email", "ssn"])], "call_id long, redaction_count int, redacted_types array<string>"
    )
    rows = a.attach_stats(df, stats).orderBy("call_id").collect()
    assert [(r.redaction_count, r.redacted_types) for r in rows] == [(3, ["email", "ssn"]), (0, [])]


def test_writers(spark):
    log = a.audit_log(redact_calls(calls(spark, {}, {})))
    path = workspace(spark, "audit")
    write_audit(log, jsonl_writer(path))
    write_audit(log, jsonl_writer(path))
    assert len([json.loads(r.value) for r in spark.read.text(path).collect()]) == 4
    seen = []
    write_audit(log, seen.append, enabled=False)
    assert seen == []
    write_audit(log, lambda df: seen.append(df.count()))
    assert seen == [2]
