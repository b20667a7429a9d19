"""SimHash near-dedup by a byte-position inverted index with count filtering.

Fingerprint: A-Z are lower-cased; the shingles are `width` consecutive words
(`[^\\x20\\x09-\\x0D]+`) joined by a space, repeats included; a text of fewer words
is one shingle, a text of none has fingerprint zero. A bit is 1 if it is set in
over half of the shingles' XXH64 (seed 42).

Links: fingerprints that differ in at most `max_bits` bits agree in at least
8 - max_bits bytes. The index has posting lists for byte values at three
positions together; the position sets are chosen so that any four positions
hold one of them, hence every link meets in a list. In a list the bytes that a
pair shares are tallied, pairs below the guaranteed number are left out, the
others are verified bit by bit. Distinct fingerprints are indexed once each, so
copies cost nothing. A list is walked breadth first: a fingerprint that has been
reached leaves the list, so a dense group of m near copies costs about m
comparisons, not m squared, and yields m - 1 links that keep it connected.

Nulls: a null text has no words; rows with a null doc_id are left out. Repeated
rows come out as often as they go in. Empty tables give empty results; of the
input only the id appears in the result, so no names clash (`keep_one` returns
rows as they are).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.graph import connected_components
from corpusmill.session import materialize

SEED = 42


def fingerprint(text: bytes, width: int = 4) -> int:
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) < width:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        starts = [0, *(gaps + 1).tolist()]
        ends = [*gaps.tolist(), len(line)]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts, ends[width - 1 :], strict=False)]
    count, n = np.zeros(64, np.int64), len(hashes)
    for i in range(0, n, 1 << 15):
        part = np.array(hashes[i : i + (1 << 15)], "<u8")
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view("<u8")[0])


def position_sets(max_bits: int) -> list[tuple[int, ...]]:
    """Sets of byte positions such that any 8 - max_bits of the 8 positions hold one of them."""
    shared = 8 - max_bits
    if shared < 1:
        raise ValueError("with 8 bits or more, fingerprints need not share a byte")
    if shared < 4:
        return list(combinations(range(8), shared))
    parts = ((0, 1, 2), (3, 4, 5), (6, 7))
    sets = [p for p in parts if len(p) == 3]
    for i, part in enumerate(parts):
        sets += [tuple(sorted((*two, one))) for two in combinations(part, 2) for one in parts[(i + 1) % 3]]
    return sets


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """How many of the 8 bytes are zero in each XOR."""
    return (x.reshape(-1, 1).view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)


def links(prints: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Index pairs that connect exactly the components of `prints` (distinct values) under max_bits."""
    out, rest = [], np.arange(len(prints))
    while len(rest):
        todo, rest = [int(rest[0])], rest[1:]
        while todo and len(rest):
            x = prints[rest] ^ prints[(i := todo.pop())]
            near = shared_bytes(x) >= 8 - max_bits
            near[near] = np.bitwise_count(x[near]) <= max_bits
            if near.any():
                found = rest[near].tolist()
                out += [(i, j) for j in found]
                todo += found
                rest = rest[~near]
    return out


def simhash(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long, one row for each row of docs with an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t or b"", width) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")).filter("doc_id IS NOT NULL").mapInArrow(run, "doc_id bigint, fp bigint")


def fingerprint_links(prints: DataFrame, max_bits: int = 4) -> DataFrame:
    """(src, dst) over distinct (fp, id): enough links to connect every component, each verified."""
    sets = position_sets(max_bits)

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            data = np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8).astype(np.int64)
            for k, places in enumerate(sets):
                key = np.full(len(fp), k, np.int64)
                for p in places:
                    key = key << 8 | data[:, p]
                yield pa.record_batch([pa.array(key), batch.column(0), batch.column(1)], ["key", "fp", "id"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int64)] * 3

        def done(key: np.ndarray, fp: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
            cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, int)
            size, u = np.diff(cut), fp.view(np.uint64)
            two = cut[:-1][size == 2]
            x = u[two] ^ u[two + 1]
            near = two[(shared_bytes(x) >= 8 - max_bits) & (np.bitwise_count(x) <= max_bits)]
            src, dst = [ids[near]], [ids[near + 1]]
            for a, n in zip(cut[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
                pairs = np.array(links(u[a : a + n], max_bits), np.int64).reshape(-1, 2) + a
                src.append(ids[pairs[:, 0]])
                dst.append(ids[pairs[:, 1]])
            return pa.record_batch([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], ["src", "dst"])

        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = [np.concatenate([a, b]) for a, b in zip(held, new, strict=True)]
            last = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last key may go on
            if last:
                yield done(*(c[:last] for c in held))
                held = [c[last:] for c in held]
        yield done(*held)

    return prints.select("fp", "id").mapInArrow(postings, "key bigint, fp bigint, id bigint").repartition("key").sortWithinPartitions("key").mapInArrow(walk, "src bigint, dst bigint")


def near_duplicates(docs: DataFrame, width: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id that links reach, itself included."""
    prints = materialize(simhash(docs, width, id_col, text_col), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("id"))
    joined = connected_components(fingerprint_links(classes, max_bits))
    label = classes.join(joined, "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return prints.join(label, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near duplicates: that of the smallest id (null ids last), of repeated rows any one.

    Rows are told apart by a number that is written with them, so null and repeated ids are no different from others.
    """
    rows = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    prints = materialize(simhash(rows, width, "__row", text_col).withColumnRenamed("doc_id", "__row"), "fingerprints")
    ids = rows.select("__row", F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("id"))
    classes = materialize(prints.join(ids, "__row").groupBy("fp").agg(F.min("__row").alias("class"), F.min(F.struct("id", "__row")).alias("first")), "classes")
    joined = connected_components(fingerprint_links(classes.select("fp", F.col("class").alias("id")), max_bits))
    group = F.coalesce("component", "class")
    stays = classes.join(joined, classes["class"] == joined["id"], "left").groupBy(group).agg(F.min("first").alias("first")).select("first.__row")
    return rows.join(stays, "__row", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
