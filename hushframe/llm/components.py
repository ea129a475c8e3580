"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.tables import staged


def components(links: DataFrame) -> DataFrame:
    """``node, root``: every node of ``links(a, b)`` (longs) with the least node it reaches.

    Alternating large-star and small-star contraction: a logarithmic number of
    rounds on chains as well as on stars. Only minima are grouped (combined before
    the shuffle); the joins on a node have nothing above them that would keep
    adaptive execution from splitting a hot one. Each round is written out.
    """
    links = staged(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    before = None
    while (state := _state(links)) != before:
        before = state
        if not state[0]:
            break
        links = staged(_small_star(_large_star(links)), "links")
    # Every link now leads from a node straight to its root.
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def _state(links: DataFrame) -> tuple:
    row = links.agg(
        F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    ).first()
    return tuple(row)


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least neighbour (or the node)."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    return (
        both.join(least, "a")
        .where("b > a")
        .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """The smaller neighbours of a node, and the node, are linked to the least of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    return (
        links.join(least, "a")
        .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("l"))
        .select("l.a", "l.b")
        .where("a <> b")
        .distinct()
    )
