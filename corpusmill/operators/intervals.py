"""Ordered-row operators: runs, merged intervals, balances, sliding sums, as-of lookups and chunk packing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Maximal runs of equal values: (by, value, run, first, last, n), where first and last are the run's first order column."""
    w = Window.partitionBy(*by)
    d = df.withColumns({"__a": F.row_number().over(w.orderBy(*order)), "__b": F.row_number().over(Window.partitionBy(*by, value).orderBy(*order))})
    return d.groupBy(*by, value, (F.col("__a") - F.col("__b")).alias("run")).agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("n"))


def balanced(df: DataFrame, by: str, order: list[str], step: Column) -> DataFrame:
    """(by, lowest, final, balanced): whether the running sum of step never falls below zero and ends at zero."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = df.withColumns({"__sum": F.sum(step).over(w), "__step": step})
    return d.groupBy(by).agg(F.min("__sum").alias("lowest"), F.sum("__step").alias("final")).withColumn("balanced", (F.col("lowest") >= 0) & (F.col("final") == 0))


def best_window(df: DataFrame, by: str, order: list[str], value: str, width: int) -> DataFrame:
    """(by, start, total): the `width` consecutive rows with the largest sum; the earliest at a tie. Shorter groups have none."""
    w = Window.partitionBy(by).orderBy(*order)
    d = df.withColumns({
        "__at": F.row_number().over(w) - 1,
        "__n": F.count("*").over(Window.partitionBy(by)),
        "__sum": F.sum(value).over(w.rowsBetween(0, width - 1)),
    }).filter(F.col("__at") + width <= F.col("__n"))
    best = d.groupBy(by).agg(F.max(F.struct(F.round("__sum", 6).alias("total"), (-F.col("__at")).alias("__neg"))).alias("x"))
    return best.select(by, (-F.col("x.__neg")).alias("start"), F.col("x.total").alias("total"))


def latest_before(df: DataFrame, by: str, time: str, cutoff: Column, value: str, tie: str) -> DataFrame:
    """(by, value): the last row of each group before the cutoff; one aggregate, no sort."""
    return df.filter(F.col(time) < cutoff).groupBy(by).agg(F.max_by(value, F.struct(time, tie)).alias(value))


def asof_join(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, value: str, out: str) -> DataFrame:
    """left plus the value of the last right row at or before its time. Both sides are dealt once, by key; a running last value does the rest."""
    a = left.select(F.col(by), F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"), F.lit(None).cast(right.schema[value].dataType).alias("__v"))
    b = right.select(F.col(by), F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), F.col(value).alias("__v"))
    w = Window.partitionBy(by).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return a.unionByName(b).withColumn(out, F.last("__v", ignorenulls=True).over(w)).filter("__side = 1").select("__row.*", out)


def pack_chunks(parts: Column, sizes: Column, most: int, least: int, longest: int | None = None, keep_short: bool = False, between: str = "\n") -> Column:
    """Parts joined into chunks of struct<text, n>: a chunk is closed when the next part would lift it over `most`; chunks under `least` are dropped.

    Parts longer than `longest` are left out. With keep_short, a chunk under `least` isn't closed but takes the next part too,
    and chunks that grew over `longest` so are dropped. An array fold, so nothing is shuffled. Parts and sizes are arrays of equal length.
    """
    pairs = F.arrays_zip(parts.alias("p"), sizes.alias("n"))
    if longest is not None:
        pairs = F.filter(pairs, lambda x: x["n"] <= longest)
    empty = F.struct(F.array().cast("array<struct<text:string,n:int>>").alias("done"), F.lit("").alias("text"), F.lit(0).alias("n"))

    def close(acc: Column) -> Column:
        fits = acc["n"] >= least
        if keep_short and longest is not None:
            fits &= acc["n"] <= longest
        return F.when(fits, F.concat(acc["done"], F.array(F.struct(acc["text"].alias("text"), acc["n"].alias("n"))))).otherwise(acc["done"])

    def step(acc: Column, x: Column) -> Column:
        over = (acc["n"] >= (max(least, 1) if keep_short else 1)) & (acc["n"] + x["n"] > most)
        return F.when(over, F.struct(close(acc).alias("done"), x["p"].alias("text"), x["n"].alias("n"))).otherwise(
            F.struct(acc["done"].alias("done"), F.when(acc["n"] == 0, x["p"]).otherwise(F.concat(acc["text"], F.lit(between), x["p"])).alias("text"), (acc["n"] + x["n"]).alias("n"))
        )

    return F.aggregate(pairs, empty, step, close)


def sections(df: DataFrame, by: str, place: str, start: list[str] | None = None, stop: list[str] | None = None, skip: list[str] | None = None, mark: str | None = None) -> DataFrame:
    """df (by, place, tag, text) without its heading rows, plus `heading`: rows behind the first heading that begins like one of
    `start` (or from the beginning) and before the first that begins like one of `stop`, except under headings that begin like one of `skip`.
    With `mark`, the other rows stay too, and this column says which lie inside."""
    head = F.when(F.col("tag").rlike("^h[1-6]$"), F.col("text"))
    like = lambda names: F.coalesce(reduce(lambda a, b: a | b, [head.startswith(n) for n in names]), F.lit(False)) if names else F.lit(False)
    w = Window.partitionBy(by).orderBy(place)
    seen = lambda names: F.max(like(names).cast("int")).over(w) == 1
    d = df.withColumns({"heading": F.last(head, ignorenulls=True).over(w), "__on": seen(start) if start else F.lit(True), "__off": seen(stop)})
    skipped = F.coalesce(reduce(lambda a, b: a | b, [F.col("heading").startswith(n) for n in skip]), F.lit(False)) if skip else F.lit(False)
    inside = F.col("__on") & ~F.col("__off") & ~skipped
    d = d.filter(head.isNull())
    return (d.withColumn(mark, inside) if mark else d.filter(inside)).drop("__on", "__off")
