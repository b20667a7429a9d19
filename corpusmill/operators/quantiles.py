"""Order statistics of groups without gathering a group's values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_quantiles(df: DataFrame, by: list[str], value: str, places: dict[str, Callable[[Column], Column]], extra: list[Column] | None = None) -> DataFrame:
    """For each group the values at the given places (0-based, from the number of rows n) of its sorted values.

    Equal values are counted first, so the window sees each distinct value once.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__c"))
    w = Window.partitionBy(*by)
    d = counts.withColumns({"__end": F.sum("__c").over(w.orderBy(value)), "__n": F.sum("__c").over(w)})
    hit = lambda place: (place(F.col("__n")) < F.col("__end")) & (place(F.col("__n")) >= F.col("__end") - F.col("__c"))
    return d.groupBy(*by).agg(*[F.max(F.when(hit(p), F.col(value))).alias(n) for n, p in places.items()], *(extra or []))
