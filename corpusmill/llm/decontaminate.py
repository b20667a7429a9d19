"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared as lower-cased words (`\\w+`). An item of m words matches a
document if a run of the document's words is within k = floor(error_rate * m)
word edits (replaced, added or left out) of it. The item is cut into k + 1
pieces: k edits touch at most k of them, so one piece stands in the document
unchanged. All pieces are looked for at once with one Aho-Corasick automaton;
around each hit Myers' bit-parallel distance decides, and a second run from the
right finds where the match starts.

Items go to the tasks in blocks of at most `block_bytes` (their total is measured
first), so any number of items works; with more than one block, the driver holds
one at a time and documents are read once per block. Documents are never
shuffled. `min_words` can leave out short items; by default none are.

Nulls: a null text matches nothing; null and wordless items are skipped. Rows
that repeat a document give a row each; of repeated item ids the best counts.
`decontaminate` judges rows, not ids, so null and repeated ids make no
difference; extra columns pass through. Empty tables give empty results.
"""

from __future__ import annotations

import math
import re
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.blocks import release
from corpusmill.session import materialize

_WORD = re.compile(r"\w+")


def normal_words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def pieces(n_words: int, budget: int) -> list[tuple[int, int]]:
    """budget + 1 ranges that cover n_words words, as even as can be."""
    n = min(budget + 1, n_words)
    return [(n_words * i // n, n_words * (i + 1) // n) for i in range(n)]


def _masks(pattern: list[str]) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, w in enumerate(pattern):
        masks[w] = masks.get(w, 0) | 1 << i
    return masks


def myers(masks: dict[str, int], m: int, text: list[str], anchored: bool = False) -> Iterator[int]:
    """For each end in text, the least edits between the pattern and a run that ends there (anchored: the run from 0)."""
    full, top, fixed = (1 << m) - 1, 1 << (m - 1), int(anchored)
    up, down, score = full, 0, m
    for w in text:
        same = masks.get(w, 0)
        vertical = same | down
        horizontal = (((same & up) + up) ^ up) | same
        plus = (down | ~(horizontal | up)) & full
        minus = up & horizontal
        score += bool(plus & top) - bool(minus & top)
        plus, minus = (plus << 1 | fixed) & full, minus << 1 & full
        up, down = (minus | ~(vertical | plus)) & full, plus & vertical
        yield score


class Matcher:
    """Finds items in word lists; holds the automaton over the pieces of all items."""

    def __init__(self, items: list[tuple[int, list[str]]], error_rate: float):
        self.items = [(i, w, math.floor(error_rate * len(w)), _masks(w), _masks(w[::-1])) for i, w in items]
        found: dict[str, list[tuple[int, int]]] = {}
        for at, (_, w, k, _, _) in enumerate(self.items):
            for a, b in pieces(len(w), k):
                found.setdefault(f" {' '.join(w[a:b])} ", []).append((at, a))
        self.automaton = ahocorasick.Automaton()
        for phrase, where in found.items():
            self.automaton.add_word(phrase, (len(phrase), where))
        self.automaton.make_automaton()

    def find(self, words: list[str]) -> list[tuple[int, int, int, int]]:
        """(item position, distance, first word, end word) of the best match of each item that matches."""
        starts: list[int] = []
        best: dict[int, tuple[int, int, int]] = {}
        done: set[tuple[int, int]] = set()
        for end, (size, where) in self.automaton.iter(f" {' '.join(words)} ") if self.items else ():
            starts = starts or list(accumulate((len(w) + 1 for w in words), initial=0))
            word = bisect_right(starts, end - size + 1) - 1
            for at, offset in where:
                if (at, word - offset) in done:
                    continue
                done.add((at, word - offset))
                _, pattern, k, masks, back = self.items[at]
                m = len(pattern)
                low = max(0, word - offset - k)
                near = words[low : word - offset + m + k]
                score, stop = min((s, e) for e, s in enumerate(myers(masks, m, near)))
                if score > k or (at in best and best[at][0] <= score):
                    continue
                left = near[: stop + 1][::-1]
                length = min((s, n) for n, s in enumerate(myers(back, m, left, True), 1))[1]
                best[at] = (score, low + stop + 1 - length, low + stop + 1)
        return [(at, *v) for at, v in best.items()]


_last: list = [None, None]  # a worker's matcher, and the broadcast it was made from


def _blocks(items: DataFrame, item_col: str, item_text: str, min_words: int, block_bytes: int) -> Iterator[tuple[int, list[tuple[int, list[str]]]]]:
    """(number of blocks, words of the items of a block), one block at a time."""
    own = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).filter("text IS NOT NULL AND item_id IS NOT NULL")
    total = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, math.ceil(total / block_bytes))
    for k in range(n):
        rows = own.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).toLocalIterator()
        yield n, [(r.item_id, w) for r in rows if len(w := normal_words(r.text)) >= max(1, min_words)]


def _matcher(held, error_rate: float) -> Matcher:
    """The matcher of a broadcast block; a worker makes it once."""
    if _last[0] != (held.value_id, error_rate):
        _last[:] = (held.value_id, error_rate), Matcher(held.block.value, error_rate)
    return _last[1]


class _Held:
    """A broadcast block with a name of its own."""

    def __init__(self, spark, block: list):
        self.block, self.value_id = spark.sparkContext.broadcast(block), uuid.uuid4().hex


def benchmark_matches(
    docs: DataFrame, items: DataFrame, error_rate: float = 0.15, min_words: int = 1,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = 32 << 20,
) -> DataFrame:
    """(doc_id, item_id, distance, n_item_words, start_word, end_word) for each document and item that match."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    names = ["doc_id", "item_id", "distance", "n_item_words", "start_word", "end_word"]

    def search(held: _Held) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(held, error_rate)
            for batch in batches:
                rows = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    best: dict[int, tuple] = {}
                    for at, d, a, b in matcher.find(normal_words(text)):
                        item, pattern = matcher.items[at][:2]
                        if item not in best or d < best[item][2]:
                            best[item] = (doc, item, d, len(pattern), a, b)
                    rows += best.values()
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 6, names)

        return texts.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))

    out: list[DataFrame] = []
    for n, block in _blocks(items, item_col, item_text, min_words, block_bytes):
        found = search(_Held(docs.sparkSession, block))
        out.append(found if n == 1 else materialize(found, "matches"))  # of several blocks, each is searched before the next is read
    return reduce(DataFrame.unionByName, out)


def decontaminate(docs: DataFrame, items: DataFrame, error_rate: float = 0.15, min_words: int = 1, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = 32 << 20) -> DataFrame:
    """docs without the rows in whose text an item matches."""
    names = docs.columns
    schema = docs.schema

    for n, block in _blocks(items, item_col, item_text, min_words, block_bytes):
        held = _Held(docs.sparkSession, block)

        def run(batches: Iterator[pa.RecordBatch], held: _Held = held) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(held, error_rate)
            for batch in batches:
                clean = [t is None or not matcher.find(normal_words(t)) for t in batch.column(len(names)).to_pylist()]
                yield pa.record_batch(batch.columns[:-1], batch.schema.names[:-1]).filter(pa.array(clean, pa.bool_()))
            release()

        docs = docs.withColumn("__cm_text", F.col(f"`{text_col}`").cast("string")).mapInArrow(run, schema)
        if n > 1:
            docs = materialize(docs, "clean")
    return docs
