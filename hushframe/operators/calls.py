"""Tool calls and resource reads: redaction of the blocks inside a row.

A call is one row with its blocks as an array; order is the array's, totals are
carried in the row, and nothing is exploded or grouped.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.functions.detectors import PatternDetector, apply_hits
from hushframe.functions.masks import NO_TYPES
from hushframe.functions.masks import counts as kind_counts
from hushframe.functions.nested import Leaf, escaped, field, pattern_leaf
from hushframe.functions.spans import hits_leaf
from hushframe.functions.sqltext import (
    Sql,
    aggregate,
    let,
    lit,
    name,
    struct,
    transform,
    transform_indexed,
    when,
    zip_with,
)
from hushframe.operators.entities import (
    Detector,
    chunk_rows,
    found_leaf,
    join_hits,
    native_leaf,
)
from hushframe.operators.profiles import (
    PROFILES,
    Profile,
    with_fixed_profile,
    with_profile,
)
from hushframe.operators.redact import COUNT, COUNTS, TYPES, compute, set_aside

_PROFILE_COLUMNS = ("profile_name", "stage1", "stage2", "entity_types")
_ADDED = (COUNT, TYPES, COUNTS, "profile_fallback", *_PROFILE_COLUMNS)


def is_text_block(block: Sql) -> Sql:
    return f"coalesce({block}.type = 'text', false)"


def has_text(item: Sql) -> Sql:
    return f"{item}.text IS NOT NULL"


def explode_blocks(df: DataFrame, key: str, content: str = "content") -> DataFrame:
    """One row per block, in order; a call without blocks keeps one empty row."""
    return df.select(
        key, F.posexplode_outer(content).alias("block_idx", "_block")
    ).select(key, "block_idx", "_block.*")


def explode_items(df: DataFrame, key: str, contents: str = "contents") -> DataFrame:
    """One row per item of a resource read."""
    # Outer, then filtered: from an inner generator Catalyst infers a filter on the
    # array and pushes a copy of the whole redaction below it.
    return (
        df.select(key, F.posexplode_outer(contents).alias("item_idx", "_item"))
        .where(F.col("item_idx").isNotNull())
        .select(
            key,
            "item_idx",
            F.col("_item.uri").alias("item_uri"),
            "_item.mimeType",
            "_item.text",
            "_item.blob",
        )
    )


def _rewrite_blocks(
    blocks: Sql, fields: Sequence[str], wanted: Callable[[Sql], Sql], leaf: Leaf
) -> Sql:
    """array<struct<block, n, types, entity_types>>, aligned with ``blocks``.

    ``fields`` names the fields of a block; all but ``text`` are kept.
    """

    def one(block: Sql, index: Sql) -> Sql:
        def with_text(r: Sql) -> Sql:
            kept = {
                f: f"{r}.value" if f == "text" else field(block, f) for f in fields
            }
            return struct(
                block=struct(**kept),
                n=f"{r}.n",
                types=f"{r}.types",
                entity_types=f"{r}.entity_types",
            )

        hit = let(leaf(f"{block}.text", f"cast({index} AS string)"), with_text)
        return when(
            (wanted(block), hit),
            other=struct(block=block, n="0", types=NO_TYPES, entity_types=NO_TYPES),
        )

    return transform_indexed(blocks, one)


def _two_stages(
    df: DataFrame,
    column: str,
    wanted: Callable[[Sql], Sql],
    active: Sql,
    detector: Detector | None,
    parity: bool,
    entities: DataFrame | None = None,
    key: str | Sequence[str] | None = None,
) -> DataFrame:
    """Redact the blocks of ``column`` where ``active``, by the row's profile.

    Entities of a table have the paths of ``chunk_rows`` over the redacted column:
    ``content[2].text``.
    """
    blocks = name(column)
    fields = df.schema[column].dataType.elementType.names
    first = _rewrite_blocks(blocks, fields, wanted, pattern_leaf)
    out = compute(df, _first=when((f"{active} AND stage1", first)))
    steps = ["_first"]
    if entities is not None:
        if key is None:
            raise ValueError("an entity table needs the key of the calls")
        keys = [key] if isinstance(key, str) else list(key)
        texts = transform(
            "_first.block",
            lambda b: f"named_struct('text', {when((wanted(b), f'{b}.text'), other='cast(NULL AS string)')})",
        )
        shown = out.where("stage2").select(*keys, F.expr(texts).alias(column))
        chunks = chunk_rows(shown, keys, [column], parity=parity)
        out = join_hits(out, chunks, entities, keys, parity=parity)
        if parity:
            hits = hits_leaf("_hits", "entity_types", parity=True)

            def from_table(text: Sql, place: Sql) -> Sql:
                return hits(text, f"concat({lit(escaped(column) + '[')}, {place}, {lit('].text')})")

        else:
            asked = when(("size(_hits) > 0", transform(texts, lambda b: f"{b}.text")))
            kind = T.ArrayType(T.StringType())
            out = compute(out, _found=asked).withColumn(
                "_found", apply_hits(F.col("_found"), F.col("_hits"), F.col("entity_types"), kind)
            )

            def from_table(text: Sql, place: Sql) -> Sql:
                return found_leaf(text, f"get(_found, cast({place} AS int))")

        second = _rewrite_blocks("_first.block", fields, wanted, from_table)
        out = compute(out, _second=second)
        steps.append("_second")
    elif detector is not None:
        if isinstance(detector, PatternDetector):
            native = native_leaf(detector, "entity_types", parity=parity)

            def leaf(text: Sql, place: Sql) -> Sql:
                nothing = struct(value=text, n="0", types=NO_TYPES, entity_types=NO_TYPES)
                return when(("stage2", native(text, place)), other=nothing)

        else:
            # The texts of a call in one array, null where nothing is asked.
            asked = transform(
                "_first.block",
                lambda b: when(
                    (f"stage2 AND {wanted(b)} AND {detector.may_match(f'{b}.text')}", f"{b}.text"),
                    other="cast(NULL AS string)",
                ),
            )
            texts = compute(out, _found=asked)
            kind = T.ArrayType(T.StringType())
            out = texts.withColumn(
                "_found", detector.mirrored(F.col("_found"), F.col("entity_types"), kind, parity=parity)
            )

            def leaf(text: Sql, place: Sql) -> Sql:
                return found_leaf(text, f"get(_found, cast({place} AS int))")

        second = _rewrite_blocks("_first.block", fields, wanted, leaf)
        out = compute(out, _second=second)
        steps.append("_second")

    last = steps[-1]
    counts = [aggregate(step, "0", lambda n, r: f"{n} + {r}.n") for step in steps]
    # Per block the pattern kinds come before the entity kinds; blocks in order.
    per_block = (
        f"{last}.types"
        if len(steps) == 1
        else zip_with(
            "_first", "_second", lambda a, b: f"concat({a}.types, {b}.entity_types)"
        )
    )
    return out.withColumns(
        {
            column: F.expr(
                when((f"{last} IS NOT NULL", f"{last}.block"), other=blocks)
            ),
            COUNT: F.expr(f"coalesce({' + '.join(counts)}, 0)"),
            TYPES: F.expr(
                f"coalesce(array_distinct(flatten({per_block})), {NO_TYPES})"
            ),
            COUNTS: F.expr(kind_counts(f"coalesce(flatten({per_block}), {NO_TYPES})")),
        }
    ).drop("_first", "_second", "_found", "_hits")


def _resolve(
    df: DataFrame,
    profile: str | None,
    profile_column: str,
    profiles: Sequence[Profile],
    parity: bool,
) -> DataFrame:
    if profile is not None:
        return with_fixed_profile(df, profile, profiles, parity=parity)
    return with_profile(df, profile_column, profiles, parity=parity)


def redact_calls(
    df: DataFrame,
    *,
    profile: str | None = None,
    profile_column: str = "profile",
    profiles: Sequence[Profile] = PROFILES,
    detector: Detector | None = None,
    entities: DataFrame | None = None,
    key: str | Sequence[str] | None = None,
    parity: bool = False,
) -> DataFrame:
    """Redact tool-call results in the row.

    Only blocks of type ``text`` change.  Error results, failed calls and results
    without a content array pass through and carry no redactions.  The profile is
    one for all rows, or looked up per row.  Adds ``redaction_count``,
    ``redacted_types``, ``redacted_counts`` (a map), ``profile_name`` and
    ``profile_fallback``; a column of such a name is kept as ``<name>_input``.
    """
    active = "NOT coalesce(is_error, false) AND content IS NOT NULL"
    if "failure" in df.columns:
        active += " AND failure IS NULL"
    df = set_aside(df, _ADDED)
    resolved = _resolve(df, profile, profile_column, profiles, parity)
    done = _two_stages(
        resolved, "content", is_text_block, active, detector, parity, entities, key
    )
    return done.drop("stage1", "stage2", "entity_types")


def redact_resources(
    df: DataFrame,
    *,
    profile: str | None = None,
    profile_column: str = "profile",
    profiles: Sequence[Profile] = PROFILES,
    detector: Detector | None = None,
    entities: DataFrame | None = None,
    key: str | Sequence[str] | None = None,
    parity: bool = False,
) -> DataFrame:
    """Redact resource reads: items with text change, blobs stay; no totals."""
    # No totals are added, so the user's own columns of those names come back as they were.
    original = df.columns
    df = set_aside(df, _ADDED)
    renamed = dict(zip(df.columns, original))
    resolved = _resolve(df, profile, renamed_to(renamed, profile_column), profiles, parity)
    done = _two_stages(
        resolved, "contents", has_text, "contents IS NOT NULL", detector, parity, entities, key
    )
    return done.drop(*_ADDED).withColumnsRenamed({k: v for k, v in renamed.items() if k != v})


def renamed_to(renamed: dict[str, str], column: str) -> str:
    """What a column is called now."""
    return next((now for now, before in renamed.items() if before == column), column)


def redact_by_profile(
    df: DataFrame,
    column: str,
    *,
    profile_column: str = "profile",
    profiles: Sequence[Profile] = PROFILES,
    detector: Detector | None = None,
    parity: bool = False,
) -> DataFrame:
    """Each row's text under its own profile.

    The text travels as a one-block array, so gates, entity kinds and totals are
    the ones of a call.
    """
    df = set_aside(df, _ADDED)
    block = F.array(F.struct(F.lit("text").alias("type"), F.col(column).alias("text")))
    resolved = with_profile(df, profile_column, profiles, parity=parity)
    done = _two_stages(
        resolved.withColumn("_content", block),
        "_content",
        is_text_block,
        f"{name(column)} IS NOT NULL",
        detector,
        parity,
    )
    return done.withColumn(column, F.col("_content")[0]["text"]).drop(
        "_content", "stage1", "stage2", "entity_types"
    )
