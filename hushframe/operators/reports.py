"""Reports over redacted tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.functions.masks import findings, may_hold_pii
from hushframe.functions.nested import escaped, text_leaves
from hushframe.functions.sqltext import filter_, lit, name
from hushframe.operators.redact import COUNTS


def pii_findings(df: DataFrame, key: str, column: str) -> DataFrame:
    """One row per masked match: key, type, ordinal, masked value.

    Raw matches never leave the expression.  Rows without a candidate are dropped
    by a native filter before any pattern runs.
    """
    return (
        df.where(may_hold_pii(name(column)))
        .select(key, F.inline(F.expr(findings(name(column)))))
        .select(key, "type", "ordinal", "masked")
    )


def pii_findings_deep(
    df: DataFrame, key: str, include: Sequence[str] | None = None
) -> DataFrame:
    """One row per masked match in any text of the columns, at any depth: key, path, type,
    ordinal, masked.

    ``path`` is the place of the text (``column.field[2][key]``, names and keys escaped);
    ordinals count in one text. All columns but the key are searched, or those of
    ``include``; other types than text, and nulls, give no rows. A column of JSON text is
    one text. VARIANT is refused. No shuffle: texts without a candidate drop out in the row,
    before any pattern runs.
    """
    if key in ("path", "text", "type", "ordinal", "masked"):
        raise ValueError(f"{key} is the name of a result column; rename the key first")
    columns = [c for c in df.columns if c != key] if include is None else list(include)
    kinds = {c: df.schema[c].dataType for c in columns}
    unread = [c for c, kind in kinds.items() if "variant" in kind.simpleString().lower()]
    if unread:
        raise ValueError(f"columns {unread} hold VARIANT; name other columns")
    parts = [
        filter_(text_leaves(name(c), kind, lit(escaped(c))), lambda x: may_hold_pii(f"{x}.text"))
        for c, kind in kinds.items()
    ]
    if not parts:
        raise ValueError("no columns to search")
    texts = df.select(F.col(name(key)), F.inline(F.expr(f"concat({', '.join(parts)})")))
    return texts.select(F.col(name(key)), "path", F.inline(F.expr(findings("text"))))


def redaction_summary(df: DataFrame, by: Sequence[str], counts: str = COUNTS) -> DataFrame:
    """Rows that hold each kind, and its redactions, by group.

    ``counts`` is the map of redactions by kind.  One row per group and kind; rows
    without redactions count under a null kind.  Partial aggregation comes before the
    shuffle, so a hot group is no burden.
    """
    return (
        df.select(*by, F.explode_outer(counts).alias("type", "n"))
        .groupBy(*by, "type")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_redactions"),
        )
    )
