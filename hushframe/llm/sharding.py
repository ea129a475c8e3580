"""Assignment of rows to shards by a hierarchical weighted hash tree.

Shards are leaves of a tree of regions and racks. Every leaf draws an exponential
variate of its weight from a hash of the row's key; a rack draws the least of its
shards' draws, a region the least of its racks'. A row descends from the root to the
child of least draw. The least of exponential draws is itself one whose rate is the sum
of the weights, so each level chooses in proportion to the weight below it. A changed
weight changes one leaf's draws and those above it: rows move only into or out of that
subtree, and a new shard takes rows only into itself.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.llm.tables import free_name, set_aside, staged

SHARDS = 24
PER_RACK = 2
RACKS = 4  # of a region
BUCKET = 20_000  # rows of a shard that are numbered together, on average
ADDED = ["shard", "slot"]

Tree = Sequence[Sequence[Mapping[int, float]]]  # regions of racks of {shard: weight}


def tree(shards: int, per_rack: int = PER_RACK, racks: int = RACKS) -> Tree:
    """Equal shards filled into racks and regions in order."""
    rack_list = [
        {s: 1.0 for s in range(at, min(at + per_rack, shards))} for at in range(0, shards, per_rack)
    ]
    return [rack_list[at : at + racks] for at in range(0, len(rack_list), racks)]


def _draw(key: Column, shard: int, weight: float) -> Column:
    """An exponential variate of rate ``weight``: 53 bits of the key's and shard's hash."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double")
    return -F.log((bits + 0.5) / float(1 << 53)) / weight


def _least(draws: Sequence[Column]) -> Column:
    """The least of ``struct(draw, shard)`` columns; equal draws go to the lower shard."""
    return draws[0] if len(draws) == 1 else F.least(*draws)


def shard_of(key: Column, regions: Tree) -> Column:
    """The shard a key descends to. A null key is a key like others."""

    def leaf(shard: int, weight: float) -> Column:
        return F.struct(_draw(key, shard, weight).alias("draw"), F.lit(shard).alias("shard"))

    region_draws = []
    for racks in regions:
        rack_draws = [
            _least([leaf(s, w) for s, w in rack.items() if w > 0])
            for rack in racks
            if any(w > 0 for w in rack.values())
        ]
        if rack_draws:
            region_draws.append(_least(rack_draws))
    return _least(region_draws)["shard"]


def assign(
    rows: DataFrame, key_col: str, regions: Tree, grown: Tree | None = None,
    order: Sequence[str] = (), bucket: int = BUCKET,
) -> DataFrame:
    """``rows`` with ``shard``, its gapless ``slot`` in the shard, and ``grown_shard``.

    Rows of a shard are numbered in buckets of a hash of the key and the reading task, so
    a shard of any size, and a key with any number of rows, is numbered by many tasks.
    Within a bucket rows are ordered by key and ``order``. A null key is a key like others, an empty
    table gives an empty result, other columns are kept and those of the new names
    are kept as ``<name>_input``. ``grown_shard`` is the shard under the tree ``grown``, null without one.
    """
    rows = set_aside(rows, [*ADDED, "grown_shard"])
    part, size, before = (free_name(rows.columns, x) for x in ("bucket", "size_of_bucket", "before"))
    key = F.col(f"`{key_col}`")
    placed = rows.withColumn("shard", shard_of(key, regions)).withColumn(
        "grown_shard", shard_of(key, grown) if grown else F.lit(None).cast("int")
    )
    leaves = sum(len(rack) for racks in regions for rack in racks)
    buckets = max(1, -(-rows.count() // (leaves * bucket)))
    # With the task that read it, so that many equal rows still spread; written once below.
    spread = F.pmod(F.xxhash64(F.lit(1), key, F.spark_partition_id()), F.lit(buckets))
    placed = staged(placed.withColumn(part, spread), "placed")
    counts = placed.groupBy("shard", part).agg(F.count("*").alias(size))
    shards = Window.partitionBy("shard").orderBy(part)
    earlier = F.sum(size).over(shards.rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("shard", part, F.coalesce(earlier, F.lit(0)).alias(before))
    place = F.row_number().over(Window.partitionBy("shard", part).orderBy(*[f"`{c}`" for c in [key_col, *order]]))
    return (
        placed.withColumn("slot", place)
        .join(counts, ["shard", part])
        .select(
            *[F.col(f"`{c}`") for c in rows.columns], "shard",
            (F.col(before) + F.col("slot") - 1).alias("slot"), "grown_shard",
        )
    )
