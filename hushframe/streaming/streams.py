"""Streams: the batch operators on ``readStream``.

Both stages are projections over one row, so they run in append mode without
state, watermark or join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from hushframe.operators.audit import audit_lines, audit_log
from hushframe.operators.calls import redact_calls
from hushframe.operators.entities import Detector, redact_deep
from hushframe.operators.redact import redact_table
from hushframe.sources.tables import BatchWriter, Writer, once_writer


def stream_redact(df: DataFrame, include: list[str] | None = None) -> DataFrame:
    """Pattern stage on a stream."""
    return redact_table(df, include)


def stream_redact_deep(
    df: DataFrame, detector: Detector, include: list[str] | None = None
) -> DataFrame:
    """Both stages on a stream; spans stay in the row."""
    return redact_deep(df, include, detector=detector)


def stream_audit(calls: DataFrame, *, detector: Detector | None = None) -> DataFrame:
    """Audit records of calls as they arrive, in one projection."""
    return calls.transform(lambda d: redact_calls(d, detector=detector)).transform(
        audit_log
    )


def start(
    df: DataFrame,
    path: str,
    checkpoint: str,
    *,
    fmt: str = "parquet",
    once: bool = True,
    every: str | None = None,
) -> StreamingQuery:
    """Write a stream to files, exactly once per input row."""
    writer = (
        df.writeStream.format(fmt)
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    if every is not None:
        writer = writer.trigger(processingTime=every)
    elif once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def start_audit_lines(audit: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Audit records of a stream as JSON lines."""
    return start(audit_lines(audit), path, checkpoint, fmt="text")


def start_writer(df: DataFrame, writer: Writer, checkpoint: str) -> StreamingQuery:
    """Hand each micro-batch to a user writer.

    A batch may be delivered again after a failure, so the writer should be
    idempotent; ``start_batches`` tells it which batch it is.
    """
    return (
        df.writeStream.foreachBatch(lambda batch, _: writer(batch))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def start_batches(df: DataFrame, writer: BatchWriter, checkpoint: str) -> StreamingQuery:
    """Hand each micro-batch to a user writer with the id of the stream and its number.

    Both stay the same when a batch is delivered again, also after a restart from the
    same checkpoint, so a writer can tell what it has written before.
    """

    def deliver(batch: DataFrame, number: int) -> None:
        # Spark keeps the id of the stream in this file of its checkpoint.
        kept = batch.sparkSession.read.schema("id string").json(f"{checkpoint.rstrip('/')}/metadata")
        writer(batch, kept.first()["id"], number)

    return (
        df.writeStream.foreachBatch(deliver)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def start_once(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Micro-batches written to ``path``, each once whatever is delivered again."""
    return start_batches(df, once_writer(path, fmt), checkpoint)
