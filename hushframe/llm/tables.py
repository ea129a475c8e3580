"""Reading tables, staging intermediate results, rows of Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

Batches = Iterator[pa.RecordBatch]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which all executors share.

    Only a local session (tests) may go without that setting.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="llm-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    The lineage ends there: later stages survive a lost executor by reading the
    files, and the planner knows the written size.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(columns: Sequence[str], wanted: str) -> str:
    """``wanted``, with underscores in front until no column has that name."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def set_aside(df: DataFrame, added: Sequence[str]) -> DataFrame:
    """``df`` with its columns of the names that are to be added renamed to ``<name>_input``
    (with underscores in front where that is taken as well)."""
    for name in added:
        for own in [c for c in df.columns if c.lower() == name.lower()]:
            df = df.withColumnRenamed(own, free_name([*df.columns, *added], f"{own}_input"))
    return df


def named_apart(id_col: str, results: Sequence[str]) -> None:
    """Raises if the id column has the name of a result."""
    if id_col.lower() in {r.lower() for r in results}:
        raise ValueError(f"{id_col} is the name of a result column; rename the id first")


def sliced(batches: Batches, rows: int = 512) -> Batches:
    """The batches in parts of few rows, so that Python objects of one part exist at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def groups(batches: Batches, key: Sequence[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with equal ``key`` in batches that are sorted by it; one run at a time."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c) for c in key]
        edges = _edges(columns)
        for start, end in zip(edges, [*edges[1:], batch.num_rows]):
            here = tuple(c[start].as_py() for c in columns)
            if held and here != last:
                yield last, pa.Table.from_batches(held)
                held = []
            last = here
            held.append(batch.slice(start, end - start))
    if held:
        yield last, pa.Table.from_batches(held)


def _edges(columns: Sequence[pa.Array]) -> list[int]:
    import numpy as np

    n = len(columns[0])
    new = np.zeros(n, bool)
    new[0] = True
    for c in columns:
        v = c.to_numpy(zero_copy_only=False)
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new).tolist()


def arrow(df: DataFrame, fn: Callable[[Batches], Batches], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)
