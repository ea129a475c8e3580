"""Audit records: one per call, built from the redacted frame.

The functions only ever see the output of ``redact_calls``, so no raw result can
reach the log.  Totals ride in the row; there is no join and no second scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.functions.masks import NO_TYPES, redact
from hushframe.functions.patterns import MAX_INPUT_CHARS, TRUNCATION_MARK
from hushframe.operators.redact import COUNT, TYPES, compute

# Order of the fields in a record.
AUDIT_COLUMNS = (
    "timestamp",
    "upstream_tool",
    "compliance_profile",
    "input_parameters",
    "execution_time_ms",
    "output_size_bytes",
    "redaction_count",
    "redacted_types",
    "status",
    "error_message",
)


def truncate_input(text: Column, limit: int = MAX_INPUT_CHARS) -> Column:
    """First ``limit`` characters and a mark, where the text is longer."""
    return F.when(
        F.length(text) > limit,
        F.concat(F.substring(text, 1, limit), F.lit(TRUNCATION_MARK)),
    ).otherwise(text)


def iso_utc(at: Column) -> Column:
    """ISO-8601 in UTC with milliseconds, whatever the session's time zone is."""
    millis = F.unix_millis(at)
    second = F.make_timestamp_ntz(
        *[F.lit(v) for v in (1970, 1, 1, 0, 0, 0)]
    ) + F.make_dt_interval(secs=F.floor(millis / 1000))
    return F.concat(
        F.replace(second.cast("string"), F.lit(" "), F.lit("T")),
        F.lit("."),
        F.lpad(F.pmod(millis, F.lit(1000)).cast("string"), 3, "0"),
        F.lit("Z"),
    )


# Columns of a call that are part of its result, and their names in it.
RESULT_FIELDS = {
    "content": "content",
    "is_error": "isError",
    "structured_content": "structuredContent",
    "meta": "_meta",
}


def result_json(df: DataFrame, fields: dict[str, str] | None = None) -> Column:
    """JSON of a call's whole result; absent fields are left out.

    ``fields`` maps columns to their names in the result, those of ``RESULT_FIELDS`` that
    the frame has by default.
    """
    known = RESULT_FIELDS if fields is None else fields
    parts = [F.col(f"`{c}`").alias(n) for c, n in known.items() if c in df.columns]
    return F.to_json(F.struct(*parts))


def attach_stats(
    calls: DataFrame, stats: DataFrame, key: str = "call_id"
) -> DataFrame:
    """Attach totals kept in a table of their own; absent means none.

    Only needed when totals were computed apart from the calls; ``redact_calls``
    already carries them in the row.
    """
    return calls.join(stats.select(key, COUNT, TYPES), key, "left").withColumns(
        {
            COUNT: F.coalesce(F.col(COUNT), F.lit(0)),
            TYPES: F.coalesce(F.col(TYPES), F.expr(NO_TYPES)),
        }
    )


def audit_base(df: DataFrame) -> dict[str, Column]:
    """Fields every record has."""
    return {
        "timestamp": iso_utc(F.col("finished_at")),
        "upstream_tool": F.col("tool_name"),
        "compliance_profile": F.col("profile_name"),
        "input_parameters": truncate_input(F.col("_parameters")),
        "execution_time_ms": F.unix_millis("finished_at") - F.unix_millis("started_at"),
    }


def audit_outcome(df: DataFrame, result: dict[str, str] | None = None) -> dict[str, Column]:
    """Fields that tell success, error result and failure apart."""
    failed = F.col("failure").isNotNull()
    is_error = F.coalesce(F.col("is_error"), F.lit(False))
    return {
        "output_size_bytes": F.when(failed, F.lit(0))
        .otherwise(F.octet_length(result_json(df, result)))
        .cast("long"),
        "redaction_count": F.when(failed, F.lit(0)).otherwise(F.col(COUNT)),
        "redacted_types": F.when(failed, F.expr(NO_TYPES)).otherwise(F.col(TYPES)),
        "status": F.when(failed | is_error, "error").otherwise("success"),
        "error_message": F.col("_message"),
    }


def audit_log(
    df: DataFrame,
    *,
    parity: bool = False,
    keep: tuple[str, ...] = (),
    result: dict[str, str] | None = None,
) -> DataFrame:
    """Audit records of redacted calls, one row each.

    Parameters and failure messages are redacted in full before the parameters are
    truncated, so a cut cannot hide half a match; ``parity`` logs them as they are.

    ``keep`` names columns of the calls to carry along, such as a key; ``result`` maps
    the columns that make up the result, whose size is logged, to their names in it.
    """
    parameters, message = "coalesce(arguments, '{}')", "failure"
    if not parity:
        parameters = f"{redact(parameters)}.value"
        message = f"{redact(message)}.value"
    ready = compute(df, _parameters=parameters, _message=message)
    fields = audit_base(ready) | audit_outcome(ready, result)
    return ready.select(*keep, *[fields[c].alias(c) for c in AUDIT_COLUMNS])


def audit_lines(audit: DataFrame) -> DataFrame:
    """Each record as one JSON line; ``error_message`` is absent when null."""
    return audit.select(
        F.to_json(F.struct(*[F.col(c) for c in AUDIT_COLUMNS])).alias("line")
    )
