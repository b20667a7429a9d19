"""Logistic regression on weighed terms. Rows lie in blocks of numbers; a round is one pass over them, which sends back a gradient for each task."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.terms import Runs, Vocabulary, _weighted
from corpusmill.session import new_folder, size_in_bytes

#: Steps that the search direction is made of, bytes of blocks that a task reads in a pass, and terms whose products are held at once.
STEPS, EACH, MERGED = 20, 256 << 20, 1 << 19


@dataclass
class Linear:
    weights: np.ndarray
    bias: float
    rounds: int
    slope: float


def term_blocks(df: DataFrame, keep: list[str], label: str, fit: Column, runs: Runs, v: Vocabulary) -> DataFrame:
    """(fit, rows, y, ends, at, w), written to the shared folder: rows of `keep` with their labels, and the numbers and weights (as float32) of their terms.

    `fit` marks the rows that a model is fitted on; they have blocks of their own.
    """
    often = np.empty(len(v), np.int32)
    often[np.argsort(v.idf, kind="stable")] = np.arange(len(v))  # terms of many rows get numbers next to each other, which keeps their weights in the cache
    held, widths = df.sparkSession.sparkContext.broadcast(Vocabulary(v.hashes, often, v.idf)), runs.widths
    d = df.withColumns({"__row": F.struct(*keep), "__y": F.coalesce(F.col(label).cast("double"), F.lit(0.0)), "__fit": F.coalesce(fit, F.lit(False))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, y, use = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            for a, b, row, at, w in _weighted(batch.column(3), widths, held.value):
                for side in (True, False):
                    own = np.flatnonzero(use[a:b] == side)
                    if len(own):
                        some = use[row] == side
                        sizes = np.bincount(row[some] - a, minlength=b - a)[own]
                        parts = [y[a:b][own], np.cumsum(sizes), at[some].astype(np.int32), w[some].astype(np.float32)]
                        taken = rows.take(pa.array(a + own))
                        lists = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), taken)
                        yield pa.record_batch([pa.array([side]), lists, *[pa.array([p.tobytes()], pa.binary()) for p in parts]], ["fit", "rows", "y", "ends", "at", "w"])

    kind = d.schema["__row"].dataType.simpleString()
    blocks = runs.columns(d, F.col("__row"), F.col("__y"), F.col("__fit")).mapInArrow(run, f"fit boolean, rows array<{kind}>, y binary, ends binary, at binary, w binary")
    path = new_folder(df.sparkSession, "blocks")
    blocks.write.option("parquet.block.row.count.limit", "4").option("parquet.enable.dictionary", "false").parquet(path)  # a reader holds a row group
    return df.sparkSession.read.schema(blocks.schema).parquet(path)


def _read(y: bytes, ends: bytes, at: bytes, w: bytes) -> tuple[np.ndarray, ...]:
    return np.frombuffer(y), np.frombuffer(ends, np.int64), np.frombuffer(at, np.int32), np.frombuffer(w, np.float32)


def _joined(blocks: Iterator[tuple[bytes, ...]]) -> Iterator[tuple[bytes, ...]]:
    """Blocks of about MERGED terms each."""
    parts, n = [], 0
    for y, ends, at, w in blocks:
        parts.append((y, (np.frombuffer(ends, np.int64) + n).tobytes(), at, w))
        n += len(at) // 4
        if n >= MERGED:
            yield tuple(b"".join(x) for x in zip(*parts, strict=True))
            parts, n = [], 0
    if parts:
        yield tuple(b"".join(x) for x in zip(*parts, strict=True))


def _margins(ends: np.ndarray, at: np.ndarray, w: np.ndarray, weights: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
    """(w * x + bias of each row, number of its terms)."""
    sizes = np.diff(ends, prepend=0)
    z, some = np.full(len(ends), bias), np.flatnonzero(sizes)
    if len(some):
        x = np.take(weights, at, mode="clip")  # without a check of each number, which [] makes
        z[some] += np.add.reduceat(np.multiply(x, w, out=x), (ends - sizes)[some])
    return z, sizes


def _share(z: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(z))
    return np.where(z >= 0, 1.0, e) / (1.0 + e)


def fit_blocks(blocks: DataFrame, size: int, c: float = 4.0, rounds: int = 1000, slope: float = 1e-4) -> Linear:
    """The minimum of |weights|² / 2 + c * (sum of log losses) over the blocks to fit on, the bias free; `size` is the number of terms.

    L-BFGS over weights scaled by the curvature of each. The objective's curvature is 1 at least, so a gradient of length `slope`
    leaves weights that lie no farther than that from the minimum for the same bias; the bias, which is free, has no such bound.
    """
    sc = blocks.sparkSession.sparkContext
    fit = blocks.filter("fit").select("y", "ends", "at", "w")
    tasks = max(sc.defaultParallelism, math.ceil(size_in_bytes(blocks) / EACH))
    held = fit.rdd.coalesce(tasks).mapPartitions(_joined).persist(StorageLevel.MEMORY_AND_DISK)

    def over(x: np.ndarray, curved: bool = False) -> list[np.ndarray]:
        """Loss, gradient (and curvature at zero) of all rows."""
        given = sc.broadcast(x)

        def run(parts: Iterator[tuple[bytes, ...]]) -> Iterator[list[np.ndarray]]:
            weights, bias = given.value[:-1], given.value[-1]
            out = [np.zeros(1), np.zeros(size + 1), *([np.zeros(size + 1)] if curved else [])]
            for part in parts:
                y, ends, at, w = _read(*part)
                at = at.astype(np.int64)  # once, not in each step
                z, sizes = _margins(ends, at, w, weights, bias)
                off = _share(z) - y
                out[0] += (np.logaddexp(0.0, z) - y * z).sum()
                each = np.repeat(off, sizes)
                out[1][:-1] += np.bincount(at, np.multiply(each, w, out=each), size)
                out[1][-1] += off.sum()
                if curved:
                    out[2][:-1] += np.bincount(at, np.square(w, dtype=float) / 4, size)
                    out[2][-1] += len(y) / 4
            yield out

        got = [np.sum(x, axis=0) for x in zip(*held.mapPartitions(run).collect(), strict=True)]
        given.destroy()
        return got or [np.zeros(1), *[np.zeros(size + 1)] * (1 + curved)]

    kept = np.append(np.ones(size), 0.0)  # the bias is free

    def value(x: np.ndarray, got: list[np.ndarray]) -> tuple[float, np.ndarray]:
        return float(kept @ (x * x) / 2 + c * got[0][0]), kept * x + c * got[1]

    try:
        x = np.zeros(size + 1)
        first = over(x, curved=True)
        scale = 1 / np.sqrt(np.maximum(kept + c * first[2], 1e-12))
        x, n = _descend(x, value(x, first), lambda x: value(x, over(x)), scale, rounds, slope)
        return Linear(x[0][:-1], float(x[0][-1]), n, float(np.linalg.norm(x[1])))
    finally:
        held.unpersist()


def _descend(x: np.ndarray, at: tuple[float, np.ndarray], value: Callable, scale: np.ndarray, rounds: int, slope: float) -> tuple[tuple[np.ndarray, np.ndarray], int]:
    """((x, gradient), rounds taken) by L-BFGS in x / scale; a step is halved until the value falls."""
    f, g = at
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    n = 0
    while n < rounds and np.linalg.norm(g) > slope:
        q, used = scale * g, []
        for s, y, r in reversed(steps):
            used.append(r * (s @ q))
            q = q - used[-1] * y
        if steps:
            s, y, r = steps[-1]
            q = q / (r * (y @ y))
        for (s, y, r), a in zip(steps, reversed(used), strict=True):
            q = q + (a - r * (y @ q)) * s
        down, t = -scale * q, 1.0
        along = float(g @ down)
        while True:
            n += 1
            new = x + t * down
            nf, ng = value(new)
            flat = abs(nf - f) <= 1e-12 * abs(f)  # so near that only the gradient tells
            if (nf <= f + 1e-4 * t * along and not flat) or (flat and abs(ng @ down) <= abs(along)):
                break
            if n >= rounds or t < 1e-10:
                return (x, g), n
            guess = -along * t * t / (2 * (nf - f - along * t)) if nf > f + along * t else t / 2
            t = min(max(guess, t / 10), t / 2)
        s, y = (new - x) / scale, scale * (ng - g)
        if s @ y > 0:
            steps = [*steps[-STEPS + 1 :], (s, y, 1 / float(s @ y))]
        x, f, g = new, nf, ng
    return (x, g), n


def block_scores(model: Linear, blocks: DataFrame) -> DataFrame:
    """Rows of all blocks with `score`, the probability of label 1."""
    held = blocks.sparkSession.sparkContext.broadcast(model)
    row = blocks.schema["rows"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                _, ends, at, w = _read(*[batch.column(i)[k].as_py() for i in range(1, 5)])
                z, _ = _margins(ends, at, w, held.value.weights, held.value.bias)
                yield pa.record_batch([batch.column(0)[k].values, pa.array(_share(z))], ["row", "score"])

    return blocks.select("rows", "y", "ends", "at", "w").mapInArrow(run, f"row {row.simpleString()}, score double").select("row.*", "score")
