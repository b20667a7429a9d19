"""Exact dedup and conflicts of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def copies(df: DataFrame, key: Column, order: list[str | Column], out: str) -> DataFrame:
    """df plus each row's number among the rows of its key, in order."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def first_of(df: DataFrame, key: Column, order: list[str | Column]) -> DataFrame:
    """The first row of each key. Spark limits the groups before it shuffles."""
    return copies(df, key, order, "__copy").filter("__copy = 1").drop("__copy")


def priority_dedup(df: DataFrame, key: Column, split: str, priority: list[str], order: list[str]) -> DataFrame:
    """One row of each key, taken from the split that stands first in priority."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(p) for p in priority]), F.col(split)), F.lit(0))
    return first_of(df, key, [F.when(rank == 0, len(priority) + 1).otherwise(rank), *order])


def group_dedup(df: DataFrame, key: Column, group: str, order: list[str]) -> DataFrame:
    """Of groups that share a key the smallest stays, the others go whole; then one row of each key and group."""
    keyed = df.withColumn("__key", key)
    least = keyed.groupBy("__key").agg(F.min(group).alias("__least"))
    lost = keyed.join(least, "__key").filter(F.col(group) != F.col("__least")).select(group).distinct()
    return first_of(keyed.join(lost, group, "left_anti"), F.col("__key"), order).drop("__key")


def key_conflicts(df: DataFrame, key: Column, payload: Column) -> DataFrame:
    """(key, n, n_payloads, kind) of keys that repeat: with equal or with conflicting payloads."""
    g = df.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.count_distinct(payload).alias("n_payloads")).filter("n > 1")
    return g.withColumn("kind", F.when(F.col("n_payloads") > 1, "conflicting").otherwise("equal"))
