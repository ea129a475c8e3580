"""Pattern stage over tables: text columns, nested records, JSON documents.

Every operator is a pure projection: no shuffle, no Python worker, and the same
function works on a stream.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.functions.jsontext import redact_json_text
from hushframe.functions.masks import MASKS, NO_TYPES, each_kind, kinds, mask_all, total
from hushframe.functions.masks import counts as kind_counts
from hushframe.functions.nested import (
    PATHS,
    Leaf,
    escaped,
    holds_text,
    pattern_leaf,
    rewrite,
)
from hushframe.functions.patterns import PATTERN_TYPES
from hushframe.functions.sqltext import Sql, lit, name, struct

COUNT = "redaction_count"
TYPES = "redacted_types"
COUNTS = "redacted_counts"


def compute(df: DataFrame, **columns: Sql) -> DataFrame:
    """Add columns that are evaluated once per row, whatever comes after.

    In a plain projection the optimizer would copy a whole redaction into every
    filter on its result, once per reference and per level of nesting.  As the
    output of a one-row generator the columns are a barrier: filters on them stay
    above it, while filters on other columns still go down to the scan.
    """
    return df.select("*", F.inline(F.expr(f"array({struct(**columns)})")))


def text_columns(
    df: DataFrame,
    include: Sequence[str] | None = None,
    exclude: Sequence[str] = (),
) -> list[str]:
    """Columns that can hold text, in table order, narrowed by name."""
    names = [f.name for f in df.schema.fields if holds_text(f.dataType)]
    if include is not None:
        unknown = set(include) - set(df.columns)
        if unknown:
            raise ValueError(f"no such column: {sorted(unknown)}")
        names = [n for n in names if n in set(include)]
    return [n for n in names if n not in set(exclude)]


def mask_text(df: DataFrame, column: str, kind: str) -> DataFrame:
    """One of the five masks alone; adds ``redaction_count``."""
    df = set_aside(df, [COUNT] if column != COUNT else [])
    (masked,) = helper_names(df, 1, "masked")
    return (
        compute(df, **{masked: MASKS[kind](name(column))})
        .withColumns({column: F.col(f"{masked}.value"), COUNT: F.col(f"{masked}.n")})
        .drop(masked)
    )


def redact_text(
    df: DataFrame, column: str, *, by_kind: bool = False, counts: bool = False
) -> DataFrame:
    """All five masks on one text column.

    Adds ``redaction_count`` and ``redacted_types``; with ``by_kind`` also one
    count column per kind (``n_credit_card`` ...), with ``counts`` a map of them,
    ``redacted_counts``.  A column of the frame with such a name is kept as
    ``<name>_input``.
    """
    new = [COUNT, TYPES, *([COUNTS] if counts else []), *([f"n_{k}" for k in PATTERN_TYPES] if by_kind else [])]
    df = set_aside(df, [c for c in new if c != column])
    (masked,) = helper_names(df, 1, "masked")
    added = {
        column: F.col(f"{masked}.value"),
        COUNT: F.expr(total(masked)),
        TYPES: F.expr(kinds(masked)),
    }
    if by_kind:
        added |= {f"n_{k}": F.col(f"{masked}.{k}") for k in PATTERN_TYPES}
    if counts:
        added[COUNTS] = F.expr(kind_counts(each_kind(masked)))
    return compute(df, **{masked: mask_all(name(column))}).withColumns(added).drop(masked)


def helper_names(df: DataFrame, n: int, stem: str) -> list[str]:
    """Column names that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    prefix = f"_{stem}_"
    while any(f"{prefix}{i}" in taken for i in range(n)):
        prefix = "_" + prefix
    return [f"{prefix}{i}" for i in range(n)]


def set_aside(df: DataFrame, added: Sequence[str]) -> DataFrame:
    """``df`` with its columns of the names that are to be added renamed to ``<name>_input``."""
    for new in added:
        for own in [c for c in df.columns if c.lower() == new.lower()]:
            free = f"{own}_input"
            while free.lower() in {c.lower() for c in df.columns}:
                free = "_" + free
            df = df.withColumnRenamed(own, free)
    return df


def aside(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The frame without columns of the totals' names, and what ``columns`` are called now."""
    names = df.columns
    df = set_aside(df, (COUNT, TYPES))
    now = dict(zip(names, df.columns))
    return df, [now[c] for c in columns]


_WALK = "walk\u200b"  # no column of a user has this name


def walk_helpers(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith(_WALK)]


def walk_table(
    df: DataFrame,
    columns: Sequence[str],
    leaf: Leaf,
    places: dict[str, str] | None = None,
    nav: type = PATHS,
) -> tuple[DataFrame, Column, Column, Column]:
    """Rewrite the texts of ``columns`` in place.

    ``places`` names the column that holds the counterpart of each; without it a text's
    place is its path.  Returns the frame (with one helper column per rewritten column
    still on it) and the record's count, pattern kinds and entity kinds.
    """
    kinds_of = {f.name: f.dataType for f in df.schema.fields}
    helpers = {f"{_WALK}{i}": column for i, column in enumerate(columns)}
    walked = df
    if helpers:
        walked = compute(
            df,
            **{
                h: rewrite(
                    name(c), kinds_of[c], name(places[c]) if places else lit(escaped(c)), leaf, nav
                )
                for h, c in helpers.items()
            },
        )
    values = walked.withColumns({c: F.col(f"`{h}`.value") for h, c in helpers.items()})
    n = " + ".join(f"`{h}`.n" for h in helpers) or "0"
    first = ", ".join(f"`{h}`.types" for h in helpers) or NO_TYPES
    second = ", ".join(f"`{h}`.entity_types" for h in helpers) or NO_TYPES
    return (
        values,
        F.expr(n),
        F.expr(f"array_distinct(concat({first}))"),
        F.expr(f"array_distinct(concat({second}))"),
    )


def redact_table(
    df: DataFrame,
    include: Sequence[str] | None = None,
    exclude: Sequence[str] = (),
) -> DataFrame:
    """All string values of a record, at any depth; the record's totals are added.

    Numbers, booleans and nulls pass unchanged; map keys and field names stay.
    """
    columns = text_columns(df, include, exclude)
    df, columns = aside(df, columns)
    values, n, types, _ = walk_table(df, columns, pattern_leaf)
    return values.withColumns({COUNT: n, TYPES: types}).drop(*walk_helpers(values))


def redact_json(
    df: DataFrame, column: str, schema: T.DataType | str | None = None
) -> DataFrame:
    """Document mode on a column of JSON text: values only, keys untouched.

    Without a schema the document's own literals are rewritten in place, which
    keeps numbers, nulls, key order and mixed types and needs no pass to infer a
    schema.  With a schema the column becomes typed and is walked as a record.
    Whether a text is a document is told from the text, alike at any size.
    """
    if schema is not None:
        typed = df.withColumn(column, F.from_json(F.col(column), schema))
        return redact_table(typed, [column])
    return json_column(df, column, redact_json_text(name(column)))


def json_column(df: DataFrame, column: str, redacted: Sql) -> DataFrame:
    """``column`` by a JSON redaction; adds count and kinds."""
    df = set_aside(df, [c for c in (COUNT, TYPES) if c != column])
    (masked,) = helper_names(df, 1, "masked")
    return (
        compute(df, **{masked: redacted})
        .withColumns(
            {
                column: F.col(f"{masked}.value"),
                COUNT: F.col(f"{masked}.n"),
                TYPES: F.array_distinct(F.concat(f"{masked}.types", f"{masked}.entity_types")),
            }
        )
        .drop(masked)
    )
