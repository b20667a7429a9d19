"""One query per operator of this subpackage, over whole tables, with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm.decontaminate import benchmark_matches
from corpusmill.llm.html_templates import extract_main_text
from corpusmill.llm.line_rules import line_rules
from corpusmill.llm.pu_toxicity import toxicity
from corpusmill.llm.sentencepiece_codec import encode
from corpusmill.llm.shard_lookup import assign_shards
from corpusmill.llm.simhash_dedup import near_duplicates
from corpusmill.llm.substring_dedup import substring_dedup
from corpusmill.llm.token_counts import section_tokens
from corpusmill.llm.token_store import verify, write_store
from corpusmill.session import new_folder


def tokenizer_path(name: str) -> str:
    """Where this machine keeps a public vocabulary file: the folder in CORPUSMILL_TOKENIZERS, else the installed package."""
    if folder := os.environ.get("CORPUSMILL_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "tokens")
    write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, tokenizer_path("byte_bpe_50k.json"))
    return verify(spark, path)


def op3_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return line_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return substring_dedup(docs, window=20).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, tokenizer_path("piece_bpe_32k.model"), keep_ids=False).select("doc_id", "n_pieces", "ids_crc32", "round_trip")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("byte_bpe_50k.tiktoken"))


def op7_shard_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return assign_shards(docs, [f"shard-{i:05d}" for i in range(256)], ["doc_id"])


def op8_html_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars", "by_template")


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4, max_bits=4)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pu_toxicity": op1_pu_toxicity,
    "op2_token_store": op2_token_store,
    "op3_line_frequency": op3_line_frequency,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_token_counts": op6_token_counts,
    "op7_shard_lookup": op7_shard_lookup,
    "op8_html_templates": op8_html_templates,
    "op9_simhash_dedup": op9_simhash_dedup,
    "op10_sentencepiece": op10_sentencepiece,
}

#: Where DuckDB can say the same on whole tables.
ORACLES: dict[str, str] = {
    "op3_line_frequency": r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
raw AS (SELECT doc_id, host, unnest(string_split(t, chr(10))) AS l FROM d),
lines AS (SELECT doc_id, host, l, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n,
  lower(trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g'))) AS h FROM raw WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines FROM lines GROUP BY doc_id),
one AS (SELECT DISTINCT doc_id, host, h FROM lines),
-- a document is its set of lines: exact copies are one
docs AS (SELECT doc_id, md5(string_agg(h, chr(10) ORDER BY h)) AS document FROM one GROUP BY doc_id),
often AS (SELECT host, h FROM one JOIN docs USING (doc_id) GROUP BY host, h HAVING count(DISTINCT document) > 100),
gone AS (SELECT doc_id, sum(n) AS n FROM lines SEMI JOIN often USING (host, h) GROUP BY doc_id),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d))),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM win, (SELECT unnest(range(3)) AS j) WHERE k > 1 GROUP BY doc_id),
b AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(length(array_to_string(w, '')), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(gone.n, 0) AS gone FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT gone > 0.5 * n_words AS kept FROM f""",
    "op4_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, sha256(array_to_string(w[s:s + 19], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d)),
later AS (SELECT doc_id, s FROM win QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, s + k AS p FROM later, (SELECT unnest(range(20)) AS k)),
kept AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.p) AS t FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) x
  LEFT JOIN gone g ON g.doc_id = x.doc_id AND g.p = x.p WHERE g.p IS NULL GROUP BY x.doc_id),
n AS (SELECT doc_id, count(*) AS c FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n.c, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)""",
}
