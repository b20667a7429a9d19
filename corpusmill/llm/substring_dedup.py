"""Substring dedup by difference-cover anchors.

A window is `window` consecutive words of one document. A word goes if a window
that covers it has the same word sequence as a window that starts earlier
(smaller doc_id, or the same document and an earlier start). Windows are judged
on the input.

1. Anchors: short windows are hashed only at the positions whose remainder lies
   in a difference cover of the period. For any two positions there is a shift
   smaller than the period that puts both on the cover, so two equal windows
   always share an anchor at the same shift.
2. Anchors that occur once are dropped (32 bits of their hash and the bucket tell;
   a chance hit only adds a candidate); the others are extended to the full
   windows around them, which get a 96-bit hash of their 64-bit word hashes.
3. The earliest start of each hash stays, all others mark their words.

Each step combines equal hashes within a task before the shuffle, so a passage
that a third of the corpus shares sends one record per task, and no step
emits pairs. Two exchanges move hashes; one moves the texts and is used twice.

Memory: texts and hashes are dealt into buckets of about `bucket_bytes` of text
(the total is measured first), and a task holds one bucket at a time. Buckets of
texts go by id and text, so rows that share a null or repeated id spread out.

Nulls: a null text has no words, a null doc_id counts as the smallest. Rows that
repeat a doc_id and text are equal, so neither is earlier than the other; a
repeated doc_id with another text is one document, earlier by its start alone.
Empty tables give empty results. The result has a row for each input row; input
columns n_words, n_removed and kept_sha256 are replaced, all others pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.blocks import BLOCK_DDL, ROUTED_DDL, block_batch, release, routed, routed_table, unpack
from corpusmill.llm.words import rolling, slices, words
from corpusmill.session import text_buckets

#: (period, cover): every residue is a difference of two members.
COVERS = ((13, (0, 1, 3, 9)), (7, (0, 1, 3)), (3, (0, 1)), (1, (0,)))
_FLUSH = 500_000
_KEY = ["<i8", "<u4", "<u4"]  # doc_id, hash of the text, document bucket
_ID, _TEXT, _BUCKET = "__cm_id", "__cm_text", "__cm_bucket"


def cover_for(window: int) -> tuple[int, tuple[int, ...], int]:
    """(period, cover, anchor width) for a window: the longest period that leaves anchors of at least a third of it."""
    for period, cover in COVERS:
        if window - period + 1 >= max(1, window // 3):
            return period, cover, window - period + 1
    raise ValueError("a window has at least one word")


def _earliest(h: list[np.ndarray], doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the earliest record of each hash, and of the records that start later than that."""
    order = np.lexsort((start, doc, *reversed(h)))
    first = np.ones(len(order), bool)
    first[1:] = np.logical_or.reduce([x[order[1:]] != x[order[:-1]] for x in h]) if len(order) else False
    lead = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
    later = (doc[order] != doc[lead]) | (start[order] != start[lead])
    return np.sort(order[first]), np.sort(order[later])


def _columns(table, *names: str) -> list:
    return [table.column(n) for n in names]


def _ids(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def substring_dedup(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None, bucket_bytes: int = 8 << 20) -> DataFrame:
    """docs with `text` reduced to what is kept, plus n_words, n_removed (long) and kept_sha256.

    kept_sha256 is the SHA-256 of the kept words joined by one space. A text that
    loses nothing stays as it is; else the kept runs are joined by a line feed.
    """
    period, cover, width = cover_for(window)
    n_buckets = buckets or text_buckets(docs, text_col, bucket_bytes)
    own = docs.withColumns({
        _ID: F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))),
        _TEXT: F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"),
    }).withColumn(_BUCKET, F.pmod(F.xxhash64(_ID, _TEXT), F.lit(n_buckets)))
    on_cover = np.zeros(period, bool)
    on_cover[list(cover)] = True

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            h, doc, key, to, pos = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            _, at, inverse, counts = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            at = np.sort(at)  # by document, so that ids and positions shrink
            yield block_batch(0, routed(((h[at] >> np.uint64(33)) % np.uint64(n_buckets)).astype(np.int64), [h[at].astype(np.uint32), doc[at], key[at], to[at], pos[at]]))
            often = np.flatnonzero(counts[inverse] > 1)
            yield block_batch(1, routed(to[often].astype(np.int64), [doc[often], key[often], pos[often]]))

        for batch in batches:
            ids, to, texts = _ids(batch.column(0)), _ids(batch.column(1)), batch.column(2).to_pylist()
            for a, b in slices(texts):
                w = words(texts[a:b])
                h, of = rolling(w.hash, width), w.text_of()
                pos = np.arange(len(of)) - w.first[of]
                at = np.flatnonzero((of[: len(h)] == of[width - 1 :]) & on_cover[pos[: len(h)] % period]) if len(h) else np.zeros(0, int)
                key = np.array([xxhash.xxh32_intdigest(t) for t in texts[a:b]], np.uint32)
                held.append([h[at], ids[a:b][of[at]], key[of[at]], to[a:b][of[at]].astype(np.uint32), pos[at].astype(np.uint32)])
                if sum(len(x[0]) for x in held) > _FLUSH:
                    yield from flush()
        yield from flush()
        release()

    def repeated(table: pa.Table) -> pa.Table:
        kind, payload = table.column("kind").to_pylist(), table.column("payload").to_pylist()
        h, doc, key, to, pos = unpack([p for k, p in zip(kind, payload, strict=True) if not k], ["<u4", *_KEY, "<u4"])
        _, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
        at = np.flatnonzero(counts[inverse] > 1)
        passed = [(b, p) for k, b, p in zip(kind, table.column("bucket").to_pylist(), payload, strict=True) if k]
        return routed_table([*passed, *routed(to[at].astype(np.int64), [doc[at], key[at], pos[at]])])

    def windows(left: pa.Table, right: pa.Table) -> pa.Table:
        doc, key, pos = unpack(right.column("payload").to_pylist(), ["<i8", "<u4", "<u4"])
        out = []
        if len(doc) and left.num_rows:
            order = np.lexsort((pos, key, doc))
            doc, key, pos = doc[order], key[order], pos[order]
            cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]), [True]]))
            at = {(int(doc[a]), int(key[a])): (a, b) for a, b in zip(cut[:-1], cut[1:], strict=True)}
            ids, to = _ids(left.column(_ID)), int(left.column(_BUCKET)[0].as_py())
            texts, held = left.column(_TEXT).to_pylist(), []
            keys = np.array([xxhash.xxh32_intdigest(t) for t in texts], np.uint32)
            own = [i for i in range(len(texts)) if (int(ids[i]), int(keys[i])) in at]
            for a, b in slices([texts[i] for i in own]):
                part = np.array(own[a:b])
                w = words([texts[i] for i in part])
                n, edge = len(w.hash), np.zeros(len(w.hash) + 1, np.int32)
                for j, i in enumerate(part):
                    q = pos[slice(*at[int(ids[i]), int(keys[i])])].astype(np.int64)
                    np.add.at(edge, w.first[j] + np.maximum(q - (period - 1), 0), 1)
                    np.add.at(edge, w.first[j] + q + 1, -1)
                of = w.text_of()
                i = np.flatnonzero((np.cumsum(edge)[: max(0, n - window + 1)] > 0) & (of[: max(0, n - window + 1)] == of[window - 1 :][: max(0, n - window + 1)]))
                held.append([rolling(w.hash, window, 2)[i], (rolling(w.hash, window, 5)[i] >> np.uint64(32)).astype(np.uint32), ids[part][of[i]], keys[part][of[i]], (i - w.first[of[i]]).astype(np.uint32)])
            h1, h2, d, k, s = (np.concatenate(c) for c in zip(*held, strict=True))
            first, later = _earliest([h1, h2], d, s)
            here = np.full(len(d), to, np.uint32)
            out = [block_batch(0, routed(((h1[first] >> np.uint64(33)) % np.uint64(n_buckets)).astype(np.int64), [h1[first], h2[first], d[first], k[first], here[first], s[first]])), block_batch(1, routed(here[later].astype(np.int64), [d[later], k[later], s[later]]))]
        return pa.Table.from_batches(out or [block_batch(0, iter(()))])

    def later(table: pa.Table) -> pa.Table:
        kind, payload = table.column("kind").to_pylist(), table.column("payload").to_pylist()
        h1, h2, d, k, to, s = unpack([p for i, p in zip(kind, payload, strict=True) if not i], ["<u8", "<u4", *_KEY, "<u4"])
        _, at = _earliest([h1, h2], d, s)
        passed = [(b, p) for i, b, p in zip(kind, table.column("bucket").to_pylist(), payload, strict=True) if i]
        return routed_table([*passed, *routed(to[at].astype(np.int64), [d[at], k[at], s[at]])])

    names = [c for c in docs.columns if c != text_col]

    def removed(left: pa.Table, right: pa.Table) -> pa.Table:
        doc, key, start = unpack(right.column("payload").to_pylist(), ["<i8", "<u4", "<u4"])
        order = np.lexsort((start, key, doc))
        doc, key, start = doc[order], key[order], start[order]
        cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]), [True]])) if len(doc) else np.zeros(1, int)
        at = {(int(doc[a]), int(key[a])): (a, b) for a, b in zip(cut[:-1], cut[1:], strict=True)}
        ids, texts = _ids(left.column(_ID)), left.column(_TEXT).to_pylist()
        kept, n_words, n_removed, digest = [], [], [], []
        for i, text in zip(ids.tolist(), texts, strict=True):
            span = at.get((i, xxhash.xxh32_intdigest(text))) if at else None
            if span is None:
                own = text.split()
                kept.append(text)
                n_words.append(len(own))
                n_removed.append(0)
                digest.append(hashlib.sha256(b" ".join(own)).hexdigest())
                continue
            w = words([text])
            edge = np.zeros(len(w.start) + 1, np.int32)
            np.add.at(edge, start[slice(*span)].astype(np.int64), 1)
            np.add.at(edge, start[slice(*span)].astype(np.int64) + window, -1)
            stays = np.concatenate([[False], np.cumsum(edge)[:-1] == 0, [False]])
            turn = np.flatnonzero(stays[1:] != stays[:-1])
            runs = [text[w.start[a] : w.end[b - 1]] for a, b in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True)]
            out = b"\n".join(runs)
            kept.append(out)
            n_words.append(len(w.start))
            n_removed.append(len(w.start) - int(stays.sum()))
            digest.append(hashlib.sha256(b" ".join(out.split())).hexdigest())
        columns = {n: left.column(n) for n in names}
        columns |= {"__cm_out": pa.array(kept, pa.binary()).cast(pa.string()), "__cm_words": pa.array(n_words, pa.int64()), "__cm_removed": pa.array(n_removed, pa.int64()), "__cm_sha": pa.array(digest, pa.string())}
        return pa.table(columns)

    slim = own.select(_ID, _BUCKET, _TEXT)
    flags = slim.mapInArrow(anchors, BLOCK_DDL).groupBy("bucket").applyInArrow(repeated, ROUTED_DDL)
    whole = own.select(*names, _ID, _BUCKET, _TEXT).groupBy(_BUCKET)
    marks = whole.cogroup(flags.groupBy("bucket")).applyInArrow(windows, BLOCK_DDL).groupBy("bucket").applyInArrow(later, ROUTED_DDL)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text_col)
    done = whole.cogroup(marks.groupBy("bucket")).applyInArrow(removed, f"{schema + ', ' if schema else ''}__cm_out string, __cm_words bigint, __cm_removed bigint, __cm_sha string")
    taken = {"n_words", "n_removed", "kept_sha256"}
    return done.select(*[F.col("__cm_out").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c not in taken], F.col("__cm_words").alias("n_words"), F.col("__cm_removed").alias("n_removed"), F.col("__cm_sha").alias("kept_sha256"))
