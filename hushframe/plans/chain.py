"""Composition of user steps over a frame."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.functions.masks import redact
from hushframe.functions.nested import field
from hushframe.operators.redact import compute

Step = Callable[[DataFrame], DataFrame]


def compose(*steps: Step) -> Step:
    """One step from several; the first is closest to the data.

    A step may change its input, its output or both.  Catalyst sees one plan.
    """
    return lambda df: reduce(lambda d, step: d.transform(step), steps, df)


def answer(wanted: Column, reply: Step, *rest: Step) -> Step:
    """Rows that are ``wanted`` are answered by ``reply``; the steps of ``rest`` run over
    the others alone.

    A row where the condition is null is not answered.  Columns that only one side has
    are null on the other.
    """
    later = compose(*rest)

    def step(df: DataFrame) -> DataFrame:
        met = F.coalesce(wanted, F.lit(False))
        return later(df.where(~met)).unionByName(reply(df.where(met)), allowMissingColumns=True)

    return step


def failures_to_results(df: DataFrame) -> DataFrame:
    """Failed calls become error results: the failure is their one block of text.

    Like other error results they are not redacted afterwards, so the message is masked
    here.
    """
    fields = df.schema["content"].dataType.elementType.fields
    values = {"type": "'text'", "text": field(redact("failure"), "value")}
    block = ", ".join(
        f"'{f.name}', {values.get(f.name, f'cast(NULL AS {f.dataType.simpleString()})')}" for f in fields
    )
    made = compute(df, _failed=f"CASE WHEN failure IS NOT NULL THEN array(named_struct({block})) END")
    failed = F.col("_failed").isNotNull()
    return made.withColumns(
        {
            "content": F.coalesce("_failed", "content"),
            "is_error": F.when(failed, True).otherwise(F.col("is_error")),
            "failure": F.lit(None).cast("string"),
        }
    ).drop("_failed")
