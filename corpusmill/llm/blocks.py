"""Small binary blocks: many fixed-size records that travel as one row, so that a shuffle moves few rows."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

#: Rows between the two sides of a block shuffle: kind 0 is to be compared within
#: its bucket, kind 1 is decided already and only passes through.
BLOCK = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("payload", pa.binary())])
BLOCK_DDL = "kind int, bucket bigint, payload binary"
ROUTED = pa.schema([("bucket", pa.int64()), ("payload", pa.binary())])
ROUTED_DDL = "bucket bigint, payload binary"


def release() -> None:
    """Gives a Python worker's free memory back to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def pack(columns: list[np.ndarray]) -> bytes:
    """Differences to the record before, byte by byte of all records, compressed: sorted ids and positions shrink to little."""
    out = []
    for c in columns:
        d = c.copy()
        d[1:] -= c[:-1]
        out.append(np.ascontiguousarray(d).view(np.uint8).reshape(len(c), -1).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(payloads: list[bytes], dtypes: list) -> list[np.ndarray]:
    """The columns of all payloads, one after the other."""
    width = sum(np.dtype(d).itemsize for d in dtypes)
    reader, parts = zstandard.ZstdDecompressor(), [[] for _ in dtypes]
    for p in payloads:
        raw = reader.decompress(p)
        n, at = len(raw) // width, 0
        for out, d in zip(parts, dtypes, strict=True):
            size = np.dtype(d).itemsize
            planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
            out.append(np.cumsum(np.ascontiguousarray(planes.T).view(d).reshape(n), dtype=d))
            at += n * size
    return [np.concatenate(p) if p else np.zeros(0, d) for p, d in zip(parts, dtypes, strict=True)]


def routed(bucket: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """(bucket, payload) for each bucket that has records; their order stays."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        yield int(bucket[a]), pack([c[a:b] for c in columns])


def block_batch(kind: int, rows: Iterator[tuple[int, bytes]]) -> pa.RecordBatch:
    rows = list(rows)
    return pa.record_batch([pa.array([kind] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], schema=BLOCK)


def routed_table(rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], schema=ROUTED)
