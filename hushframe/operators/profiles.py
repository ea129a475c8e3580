"""Compliance profiles: which stages run and which entity kinds are redacted."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.functions.patterns import ENTITY_TYPES


@dataclass(frozen=True)
class Profile:
    name: str
    stage1: bool
    stage2: bool
    entity_types: tuple[str, ...] | None = None  # None: all kinds


# The four profiles and the fallback for unknown names.
PROFILES = (
    Profile(
        "GDPR",
        stage1=True,
        stage2=True,
        entity_types=("NAME", "ADDRESS", "DATE_TIME", "PASSPORT_NUMBER", "DRIVER_ID"),
    ),
    Profile("DORA", stage1=True, stage2=False),
    Profile("PCI_DSS", stage1=True, stage2=False),
    Profile("full", stage1=True, stage2=True),
)
FALLBACK = "GDPR"

PROFILE_NAMES = tuple(p.name for p in PROFILES)


def get_profile(name: str, profiles: Sequence[Profile] = PROFILES) -> Profile:
    """Profile by exact name; the fallback profile for an unknown one."""
    known = {p.name: p for p in profiles}
    return known.get(name, known[FALLBACK])


def _as_struct(profile: Profile, parity: bool) -> Column:
    # Observed behaviour ignores a profile's subset of entity kinds.
    subset = None if parity else profile.entity_types
    types = ENTITY_TYPES if subset is None else subset
    return F.struct(
        F.lit(profile.name).alias("name"),
        F.lit(profile.stage1).alias("stage1"),
        F.lit(profile.stage2).alias("stage2"),
        F.array(*[F.lit(t) for t in types]).alias("entity_types"),
    )


def profile_table(
    spark: SparkSession,
    profiles: Sequence[Profile] = PROFILES,
    *,
    parity: bool = False,
) -> DataFrame:
    """One row per profile: name, stage1, stage2, entity_types.

    A literal relation: its size is the number of profiles, never that of data.
    """
    names = [p.name for p in profiles]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"profiles of the same name: {twice}")
    rows = F.array(*[_as_struct(p, parity) for p in profiles])
    return spark.range(1).select(F.inline(rows))


def with_profile(
    df: DataFrame,
    column: str = "profile",
    profiles: Sequence[Profile] = PROFILES,
    *,
    parity: bool = False,
) -> DataFrame:
    """Resolve each row's profile name.

    Adds ``profile_name``, ``stage1``, ``stage2``, ``entity_types`` and
    ``profile_fallback`` (true where the name was unknown).  The broadcast side
    has one row per profile.
    """
    table = F.broadcast(
        profile_table(df.sparkSession, profiles, parity=parity).select(
            F.col("name").alias("_name"),
            F.struct("name", "stage1", "stage2", "entity_types").alias("_found"),
        )
    )
    fallback = _as_struct(get_profile(FALLBACK, profiles), parity)
    used = F.coalesce(F.col("_found"), fallback)
    return (
        df.join(table, F.col(column) == F.col("_name"), "left")
        .withColumns(
            {
                "profile_name": used["name"],
                "stage1": used["stage1"],
                "stage2": used["stage2"],
                "entity_types": used["entity_types"],
                "profile_fallback": F.col("_found").isNull(),
            }
        )
        .drop("_name", "_found")
    )


def with_fixed_profile(
    df: DataFrame, name: str, profiles: Sequence[Profile] = PROFILES, *, parity: bool = False
) -> DataFrame:
    """The same columns for one profile that holds for all rows; no join."""
    used = get_profile(name, profiles)
    row = _as_struct(used, parity)
    return df.withColumns(
        {
            "profile_name": row["name"],
            "stage1": row["stage1"],
            "stage2": row["stage2"],
            "entity_types": row["entity_types"],
            "profile_fallback": F.lit(used.name != name),
        }
    )
