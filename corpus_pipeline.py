"""A cleaning pipeline over `documents`, counted as part of the subpackage llm.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which run() writes as Parquet in the shared folder and
reads again as the next stage's docs. Extra columns of docs are left out, empty
tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.decontaminate import decontaminate
from corpusmill.llm.line_rules import line_rules
from corpusmill.llm.queries import tokenizer_path
from corpusmill.llm.sentencepiece_codec import encode
from corpusmill.llm.simhash_dedup import keep_one
from corpusmill.llm.substring_dedup import substring_dedup
from corpusmill.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_text(df: DataFrame, text: str) -> DataFrame:
    """The columns of documents, with a new text and its length."""
    return df.select("doc_id", F.col(text).alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go (null and empty texts are rejected); the others lose the lines above the limit. Repeated rows stay as often as they come."""
    return _with_text(line_rules(docs.select(*COLUMNS)).filter("kept"), "clean_text")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: that of the smallest doc_id (nulls last), of repeated rows one. Rows count, not ids: a repeated id with another text is another document."""
    return keep_one(docs.select(*COLUMNS))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays, without the windows that start earlier elsewhere."""
    return _with_text(substring_dedup(docs.select(*COLUMNS)), "text")


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in whose text a benchmark item matches go, whatever their ids; null texts match nothing."""
    return decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each row's text, with their number, checksum and whether they decode to the text; null for a null text."""
    return encode(docs.select(*COLUMNS), tokenizer_path("piece_bpe_32k.model")).select("doc_id", "lang", "source", "n_chars", "ids", "n_pieces", "ids_crc32", "round_trip")


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_near_dedup),
    ("substring dedup", substring_stage),
    ("benchmark decontamination", benchmark_stage),
    ("SentencePiece encoding and decoding", sentencepiece_stage),
]

#: Fingerprints, edit distances and SentencePiece ids have no SQL form; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage{i}")
    return docs
