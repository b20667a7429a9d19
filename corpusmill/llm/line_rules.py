"""Quality rules: base counts of a text, and cross-document line frequency.

Native: DataFrame functions only, no Python on the executors.

Line frequency: lines are normalised (white space runs become one space, ends
trimmed, lower case) and hashed together with their host. Per host and line the
distinct documents are counted; a line that stands in more than `max_docs`
documents of a host is removed there. What stands for a document is a hash of the
sorted set of its line hashes, so exact copies of a text count once, and a group
of copies doesn't make its own text look like boilerplate; documents that differ
in any line count each, whatever lines they share. A document that loses more
than `max_lost` of its words is depleted and rejected.

The lines above the limit number at most (document, line) pairs / max_docs. Up to
`max_listed` of them (counted first) go into the plan as a set, so texts are
never shuffled; beyond that an equivalent join is used.

Nulls: a null text is empty (rejected by the base rules), null hosts form one
host. Empty tables give empty results. The result has a row for each input row,
repeated rows included; input columns with the names of results (n_words, kept,
clean_text, ...) are replaced, all others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def base_counts(df: DataFrame, text: str) -> DataFrame:
    """df plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long)."""
    keep = df.columns
    raw = F.filter(F.split(F.col(text), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.select(*keep, split_words(F.col(text)).alias("__w"), raw.alias("__raw"))
    # hashes of the 3-word windows
    df = df.select(
        *keep,
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(F.col(text), r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("__raw") - F.size(F.array_distinct("__raw"))).cast("long").alias("n_dup_lines"),
        F.expr("IF(size(__w) > 2, transform(sequence(0, size(__w) - 3), i -> xxhash64(__w[i], __w[i + 1], __w[i + 2])), array())").alias("__h"),
    )
    counts = [*keep, *_COUNTS[:4]]
    # only texts that repeat a window pay for the sort
    df = df.select(*counts, F.expr("IF(size(array_distinct(__h)) < size(__h), sort_array(transform(__h, (x, i) -> struct(x AS x, i AS i))), NULL)").alias("__s"))
    df = df.select(
        *counts,
        F.expr(
            "IF(__s IS NULL, NULL, sort_array(transform(filter(sequence(0, size(__s) - 1),"
            " k -> (k > 0 AND __s[greatest(k - 1, 0)].x = __s[k].x) OR (k < size(__s) - 1 AND __s[least(k + 1, size(__s) - 1)].x = __s[k].x)), k -> __s[k].i)))"
        ).alias("__p"),
    )
    covered = "IF(__p IS NULL, 0L, aggregate(sequence(0, size(__p) - 1), 0L, (a, k) -> a + IF(k = size(__p) - 1, 3, least(3, __p[least(k + 1, size(__p) - 1)] - __p[k]))))"
    # The row number, times zero, keeps filters on the counts above these projections: pushed through
    # them, a condition would be written out with every nested array once for each mention.
    return df.select(*counts, (F.expr(covered).cast("long") + 0 * F.monotonically_increasing_id()).alias("n_repeat_words"))


def base_failed(min_words: int = 50, max_repeat: float = 0.5) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > int(100 * max_repeat) * F.col("n_words"))


def _line_hash(host: str, line: Column) -> Column:
    """64-bit hash of host and normalised line; null for a line without words."""
    norm = F.lower(F.trim(F.regexp_replace(line, SPACE, " ")))
    return F.when(norm != "", F.xxhash64(F.col(host), norm))


def _hashed(df: DataFrame, text: str, host: str) -> DataFrame:
    return df.withColumn("__lines", F.transform(F.split(F.col(text), "\n", -1), lambda x: F.struct(_line_hash(host, x).alias("h"), x.alias("raw"))))


def frequent_lines(df: DataFrame, text: str, host: str, max_docs: int) -> DataFrame:
    """(h): hashes of host and line that stand in more than max_docs documents."""
    lines = _hashed(df.select(text, host), text, host)
    lines = lines.select(F.array_sort(F.array_distinct(F.filter(F.transform("__lines", lambda x: x["h"]), lambda x: x.isNotNull()))).alias("__h"))
    lines = lines.select(F.xxhash64("__h").alias("doc"), F.explode("__h").alias("h"))
    return lines.groupBy("h").agg(F.count_distinct("doc").alias("n")).filter(F.col("n") > max_docs).select("h")


def line_rules(
    docs: DataFrame, max_docs: int = 100, max_lost: float = 0.5, min_words: int = 50, max_repeat: float = 0.5,
    host_col: str = "source", text_col: str = "text", max_listed: int = 50_000,
) -> DataFrame:
    """docs plus the base counts, base_failed, n_removed (words in removed lines), kept, and clean_text: the text without those lines."""
    taken = {*_COUNTS, "base_failed", "n_removed", "kept", "clean_text"}
    names = [c for c in docs.columns if c not in taken or c == text_col]
    own = docs.select(*[F.col(f"`{c}`") for c in names], F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__t"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("__host"))
    often = frequent_lines(own, "__t", "__host", max_docs)
    listed = [r.h for r in often.limit(max_listed + 1).collect()]
    if len(listed) <= max_listed:
        hashed = _hashed(own, "__t", "__host").withColumn("__gone", F.expr(f"transform(__lines, x -> coalesce(x.h IN ({', '.join(f'{h}L' for h in listed) or 'NULL'}), false))"))
    else:
        keyed = _hashed(own, "__t", "__host").withColumn("__key", F.sha2("__t", 256))
        seen = keyed.select("__key", "__host", F.explode("__lines.h").alias("h")).filter("h IS NOT NULL").join(often, "h", "left_semi")
        bad = seen.groupBy("__key", "__host").agg(F.collect_set("h").alias("__bad"))
        hashed = keyed.join(bad, ["__key", "__host"], "left").withColumn("__gone", F.expr("transform(__lines, x -> coalesce(array_contains(__bad, x.h), false))")).drop("__key", "__bad")
    hashed = hashed.withColumns({
        "n_removed": F.expr(f"aggregate(zip_with(__lines, __gone, (x, g) -> IF(g, size(array_remove(split(x.raw, '{SPACE}'), '')), 0)), 0L, (a, x) -> a + x)".replace("\\", "\\\\")),
        "clean_text": F.expr("IF(exists(__gone, g -> g), array_join(transform(filter(arrays_zip(__lines, __gone), z -> NOT z.__gone), z -> z.__lines.raw), '\n'), __t)"),
    }).drop("__lines", "__gone")
    out = base_counts(hashed, "__t").withColumn("base_failed", base_failed(min_words, max_repeat))
    kept = ~F.col("base_failed") & ~(F.col("n_removed") > max_lost * F.col("n_words"))
    return out.select(*[F.col(f"`{c}`") for c in names], *_COUNTS, "base_failed", "n_removed", kept.alias("kept"), "clean_text")
