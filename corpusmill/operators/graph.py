"""Connected components over an edge table (alternating large and small stars)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import discard, materialize


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above u goes to u's smallest neighbour (u itself included)."""
    both = _both(edges)
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and all its smaller neighbours go to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 64) -> DataFrame:
    """(id, component) for every node that has an edge; component is the smallest id reachable.

    Loops, repeated and null edges are ignored. Each round is written to the
    shared folder, so the plan stays short and a lost executor costs one round.
    Only two numbers a round come to the driver, and the round before goes.
    """
    now = materialize(
        edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).filter("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct(),
        "edges",
    )
    mark = None
    for _ in range(max_rounds):
        before, now = now, materialize(_small_star(_large_star(now)), "edges")
        discard(before)
        new = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if new == mark:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
        mark = new
    raise RuntimeError("components did not settle")
