"""Ranks and running totals over a whole table without a single task that sees every row.

Rows fall into ordered buckets (by the leading digits of a hash, or by approximate
quantiles of a value). Totals of the buckets, at most a few thousand for the table
or for each group, are accumulated and joined back; the rest is a window within
each bucket.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _with_offsets(df: DataFrame, bucket: str, values: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    keys = by or []
    w = Window.partitionBy(*keys).orderBy(bucket) if keys else Window.orderBy(bucket)  # a row for each bucket
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys, bucket).agg(*[F.sum(v).alias(f"__sum_{n}") for n, v in values.items()])
    base = sums.select(*keys, bucket, *[F.coalesce(F.sum(f"__sum_{n}").over(before), F.lit(0)).alias(f"__base_{n}") for n in values])
    if not keys:
        return df.join(F.broadcast(base), bucket)
    base = base.select(*[F.col(k).alias(f"__own_{k}") for k in [*keys, bucket]], *[f"__base_{n}" for n in values])
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__own_{k}")) for k in [*keys, bucket]])  # null keys are a group like any other
    return df.join(base, match, "left").drop(*[f"__own_{k}" for k in [*keys, bucket]])


def hash_rank(df: DataFrame, key: Column, tie: list[str], out: str = "rank", by: list[str] | None = None) -> DataFrame:
    """df plus each row's place in the order of a hexadecimal hash, over the table or within each group of `by`.

    The buckets are the hash's first three digits, so a group that holds a third of the rows is ranked by up to 4,096 tasks.
    """
    d = df.withColumn("__key", key).withColumn("__bucket", F.substring("__key", 1, 3))
    d = _with_offsets(d, "__bucket", {"n": F.lit(1)}, by)
    w = Window.partitionBy(*(by or []), "__bucket").orderBy("__key", *tie)
    return d.withColumn(out, F.col("__base_n") + F.row_number().over(w)).drop("__key", "__bucket", "__base_n")


def hash_totals(df: DataFrame, key: Column, tie: list[str], value: str, out: str = "before") -> DataFrame:
    """df plus the sum of `value` over the rows before each row in the order of a hexadecimal hash."""
    d = df.withColumn("__key", key).withColumn("__bucket", F.substring("__key", 1, 3))
    d = _with_offsets(d, "__bucket", {"v": F.col(value)})
    own = Window.partitionBy("__bucket").orderBy("__key", *tie).rowsBetween(Window.unboundedPreceding, -1)
    return d.withColumn(out, F.col("__base_v") + F.coalesce(F.sum(value).over(own), F.lit(0))).drop("__key", "__bucket", "__base_v")


def value_rank(df: DataFrame, by: list[str], order: str, tie: list[str] | None = None, out: str = "rank", buckets: int = 128) -> DataFrame:
    """df plus each row's place within its group in the order of a number; the table's approximate quantiles bound the buckets of a group."""
    d = df.withColumn("__bucket", _bucket(df, order, buckets))
    d = _with_offsets(d, "__bucket", {"n": F.lit(1)}, by)
    w = Window.partitionBy(*by, "__bucket").orderBy(order, *(tie or []))
    return d.withColumn(out, F.col("__base_n") + F.row_number().over(w)).drop("__bucket", "__base_n")


def _bucket(df: DataFrame, order: str, buckets: int) -> Column:
    """The bucket of a value: how many of the table's approximate quantiles lie below it. An outlier moves no other row."""
    x = F.col(order).cast("double")
    marks = df.agg(F.percentile_approx(F.when(~F.isnan(x), x), F.lit([i / buckets for i in range(1, buckets)]), F.lit(20 * buckets)).alias("m")).first()[0]
    marks = sorted(set(marks or []))
    return F.coalesce(_place(f"double(`{order}`)", marks), F.lit(0))


def _place(x: str, marks: list[float]) -> Column:
    """width_bucket over unequal bounds, as a balanced tree of comparisons."""

    def tree(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        return f"CASE WHEN {x} < double('{marks[mid]!r}') THEN {tree(lo, mid)} ELSE {tree(mid + 1, hi)} END"

    return F.expr(tree(0, len(marks)))


def running_totals(df: DataFrame, order: str, values: list[str], descending: bool = False, buckets: int = 128) -> DataFrame:
    """df plus cum_<value> for each value: its sum over this row and those before it in order. One row per order value is expected.

    Buckets are bounded by approximate quantiles of the order value, so each holds about the same number of rows wherever the values lie.
    """
    place = _bucket(df, order, buckets)
    d = df.withColumn("__bucket", -place if descending else place)
    d = _with_offsets(d, "__bucket", {v: F.col(v) for v in values})
    w = Window.partitionBy("__bucket").orderBy(F.col(order).desc() if descending else F.col(order))
    return d.withColumns({f"cum_{v}": F.col(f"__base_{v}") + F.sum(v).over(w) for v in values}).drop("__bucket", *[f"__base_{v}" for v in values])
