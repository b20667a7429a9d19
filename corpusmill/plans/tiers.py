"""Build a corpus tier from end to end: conform, dedup, rank, cut tiers, check."""

from __future__ import annotations

from pyspark.sql import DataFrame

from corpusmill.functions.text import norm_key, salted
from corpusmill.operators.contracts import leaks, manifest
from corpusmill.operators.dedup import priority_dedup
from corpusmill.operators.sampling import tiers


def build_tiers(rows: DataFrame, label: str, split: str, priority: list[str], sizes: dict[str, int], salt: str, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tiers, manifest, leaks): balanced nested tiers of deduplicated rows, their counts and content hashes, and texts in several splits (must be empty)."""
    unique = priority_dedup(rows, norm_key("text"), split, priority, [id_col]).withColumn("text_key", norm_key("text"))
    out = tiers(unique, label, [salted(salt, id_col), id_col], sizes)
    return out, manifest(out, [split, "tier", label], id_col), leaks(out, ["text_key"], split)
