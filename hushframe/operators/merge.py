"""Merging counts and kinds over blocks, chunks and stages.

Kinds keep the order in which they were first found.  The grouped form never
collects a group: per kind it keeps the smallest position, so it aggregates before the
shuffle and one hot key costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.operators.redact import COUNT, TYPES

def merge_stages(
    n1: Column, types1: Column, n2: Column, types2: Column
) -> tuple[Column, Column]:
    """Counts add up; kinds of the first stage come first."""
    return n1 + n2, F.array_distinct(F.concat(types1, types2))


def merge_groups(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    count: str = COUNT,
    types: str = TYPES,
) -> DataFrame:
    """Sum of counts and ordered union of kinds per key, whatever the kinds are.

    ``position`` orders the rows of a group (block or chunk number).  A group is first
    brought down to one row per kind, with its first place, before any list is made.
    """
    place, kind, at = "_place", "_kind", "_at"
    first = F.coalesce(F.col(place), F.lit(0)) == 0
    # One long for row and place in it: a minimum that hash aggregation can keep.
    rank = F.shiftleft(F.col(position).cast("long"), 31) + F.col(place)
    rows = df.select(*keys, position, count, F.posexplode_outer(types).alias(place, kind))
    per_kind = rows.groupBy(*keys, kind).agg(
        F.sum(F.when(first, F.col(count))).alias(count),
        F.min(rank).alias(at),
    )
    seen = F.when(F.col(kind).isNotNull(), F.struct(F.col(at), F.col(kind).alias("kind")))
    return per_kind.groupBy(*keys).agg(
        F.sum(count).alias(count),
        F.transform(F.array_sort(F.collect_list(seen)), lambda x: x["kind"]).alias(types),
    )
