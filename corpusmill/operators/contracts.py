"""Rejection ledgers, split contracts and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that holds, or null. Put cheap rules first: later ones aren't evaluated."""
    out = F.when(F.lit(False), F.lit(""))
    for name, rule in rules:
        out = out.when(rule, name)
    return out.otherwise(None)


def ledger(df: DataFrame, counts: list[Column], reason: str = "reason") -> DataFrame:
    """Counts for each reason; rows without one are 'kept'."""
    return df.groupBy(F.coalesce(F.col(reason), F.lit("kept")).alias(reason)).agg(*counts)


def leaks(df: DataFrame, keys: list[str], split: str = "split") -> DataFrame:
    """(field, value, n_splits): values of key columns that stand in several splits; empty if the splits are disjoint."""
    long = df.select(split, F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).cast("string").alias("value")) for k in keys])).alias("x"))
    return long.select(split, "x.field", "x.value").filter("value IS NOT NULL").groupBy("field", "value").agg(F.count_distinct(split).alias("n_splits")).filter("n_splits > 1")


def missing(inner: DataFrame, outer: DataFrame, key: str) -> DataFrame:
    """Rows of inner whose key isn't in outer; empty if inner is nested in outer."""
    return inner.join(outer.select(key), key, "left_anti")


def alignment(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, verdict) for each key: left_only, right_only, repeated or matched. Both tables fit one to one if all keys are matched."""
    x = a.groupBy(F.col(key).alias("__a")).agg(F.count("*").alias("__x"))
    y = b.groupBy(F.col(key).alias("__b")).agg(F.count("*").alias("__y"))
    j = x.join(y, F.col("__a") == F.col("__b"), "full")
    verdict = F.when(F.col("__y").isNull(), "left_only").when(F.col("__x").isNull(), "right_only").when((F.col("__x") > 1) | (F.col("__y") > 1), "repeated").otherwise("matched")
    return j.select(F.coalesce("__a", "__b").alias(key), verdict.alias("verdict"))


def row_sum(df: DataFrame) -> Column:
    """An order-free hash of all rows: the sum of their hashes, so repeated rows count."""
    return F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)"))


def manifest(df: DataFrame, by: list[str], key: str) -> DataFrame:
    """Row count and order-free content hash for each group."""
    return df.groupBy(*by).agg(F.count("*").alias("n_rows"), F.count_distinct(key).alias("n_keys"), row_sum(df).alias("content"))
