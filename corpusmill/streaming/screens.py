"""Structured Streaming form of the text dedup; an addition, the batch form is the reference point."""

from __future__ import annotations

from pyspark.sql import DataFrame

from corpusmill.functions.text import norm_key


def dedup_stream(stream: DataFrame, time: str, text: str, delay: str) -> DataFrame:
    """First row of each normalised text within the watermark; state is a key a text, dropped as time goes on."""
    return stream.withWatermark(time, delay).withColumn("__key", norm_key(text)).dropDuplicatesWithinWatermark(["__key"]).drop("__key")
