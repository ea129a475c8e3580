"""Reading the data to redact and writing what comes out."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from hushframe.operators.audit import audit_lines

Writer = Callable[[DataFrame], None]
BatchWriter = Callable[[DataFrame, str, int], None]  # batch, id of its stream, its number


def read_table(
    spark: SparkSession,
    path: str | Sequence[str],
    *,
    fmt: str = "parquet",
    schema: T.StructType | str | None = None,
    **options: str,
) -> DataFrame:
    """A table of parquet, orc, json, csv or text files."""
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path if isinstance(path, str) else list(path))


def spread(df: DataFrame, partitions: int, key: str | None = None) -> DataFrame:
    """The rows dealt to so many partitions, for a table whose files give fewer tasks
    than there are cores. The caller knows; nothing here looks at its size. With a ``key``
    that few rows share they are dealt by it, which needs no sort."""
    return df.repartition(partitions) if key is None else df.repartition(partitions, key)


def stream_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    *,
    fmt: str = "parquet",
    glob: str | None = None,
    files_per_batch: int | None = None,
) -> DataFrame:
    """A folder of files as a stream, optionally only those that match ``glob``."""
    reader = spark.readStream.format(fmt).schema(schema)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def workspace(spark: SparkSession, name: str, folder: str | None = None) -> str:
    """A new folder for written intermediate results, below ``folder``.

    By default that is the folder the cluster names in ``spark.checkpoint.dir``, which
    all executors share; without that setting ``folder`` must be given.
    """
    shared = folder or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_redacted(
    df: DataFrame,
    path: str,
    *,
    fmt: str = "parquet",
    mode: str = "errorifexists",
    partition_by: Sequence[str] = (),
) -> None:
    """Write a redacted table with all its other columns as they were."""
    df.write.format(fmt).mode(mode).partitionBy(*partition_by).save(path)


def jsonl_writer(path: str, mode: str = "append") -> Writer:
    """Writer that appends audit records to ``path`` as JSON lines."""
    return lambda audit: audit_lines(audit).write.mode(mode).text(path)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def once_writer(path: str, fmt: str = "parquet") -> BatchWriter:
    """Writer of micro-batches that has each batch in ``path`` once.

    A batch goes to the folder ``stream=<id>/batch=<number>``. Spark puts the file
    ``_SUCCESS`` there last: a batch delivered again is skipped if it is there, and
    replaces what an earlier attempt left if it isn't. Another checkpoint is another
    stream, so its batches are never taken for those of the first. Columns named
    ``stream`` and ``batch`` are refused, as readers find the folders under these names.
    """

    def write(batch: DataFrame, stream: str, number: int) -> None:
        taken = {"stream", "batch"} & {c.lower() for c in batch.columns}
        if taken:
            raise ValueError(f"columns {sorted(taken)} are names of folders; rename them first")
        folder = f"{path.rstrip('/')}/stream={stream}/batch={number}"
        if not _exists(batch.sparkSession, f"{folder}/_SUCCESS"):
            batch.write.format(fmt).mode("overwrite").save(folder)

    return write


def write_audit(audit: DataFrame, writer: Writer, *, enabled: bool = True) -> None:
    """Hand the audit records to a writer; when disabled nothing is computed."""
    if enabled:
        writer(audit)
