"""Toxicity by non-negative positive-unlabelled learning.

Two kinds of training rows: positives (confirmed toxic) and unlabelled (a sample of
all training rows, whatever their label). With class prior p and loss L the
risk is p * E_P[L(+)] + max(0, E_U[L(-)] - p * E_P[L(-)]); where a batch
makes the second term fall below -beta, its gradient is turned round, so the
classifier can't profit from overfitting it. The classifier is a logistic model
over hashed features in numpy: distinct lower-cased words and the first `PREFIX`
bytes of longer words. Text alone enters a score.

The score is calibrated on labelled training rows: of their distinct texts, toxic
and clean, a logistic curve over the fitted value gives the probability of label
1. Nothing fixes how many rows reach 0.7, and a text without a telling feature
stays below it. Rows labelled clean have no part in the weights.

The fit uses at most `max_positive` and `max_unlabelled` rows, the calibration
as many clean ones as `max_unlabelled`, those with the smallest hashes of their ids, which bounds what the driver gathers and holds;
the prior is counted over all labelled training rows. Scoring reads every text.

Nulls: null and empty texts have no features and get the score of the bias;
rows with a null doc_id count as training rows and are scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.words import SPACE, mix, powers, slices, words

BITS = 20
PREFIX = 5
#: ASCII punctuation counts as white space.
_PLAIN = bytes(c if c >= 128 or chr(c).isalnum() or SPACE[c] else 32 for c in range(256))


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) pairs, sorted and distinct."""
    w = words([t.lower().encode("utf-8", "replace").translate(_PLAIN) for t in texts])
    of = w.text_of()
    data = np.frombuffer(w.buffer + b"\0" * PREFIX, np.uint8)
    long = np.flatnonzero(w.end - w.start > PREFIX)
    up, _ = powers(PREFIX)
    head = np.zeros(len(long), np.uint64)
    for i in range(PREFIX):
        head += (data[w.start[long] + i].astype(np.uint64) + np.uint64(1)) * up[i + 1]
    top = np.uint64((1 << BITS) - 1)
    keys = np.concatenate([of.astype(np.uint64) << np.uint64(BITS) | (w.hash & top), of[long].astype(np.uint64) << np.uint64(BITS) | (mix(head, 3) & top)])
    keys = np.unique(keys)
    return (keys >> np.uint64(BITS)).astype(np.int64), (keys & top).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        of, f = features(texts)
        z = np.bincount(of, weights=self.weights[f], minlength=len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _rows(parts: list[np.ndarray], which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    chosen = [parts[i] for i in which]
    return np.repeat(np.arange(len(chosen)), [len(c) for c in chosen]), np.concatenate(chosen) if chosen else np.zeros(0, np.int64)


def select(positive: list[np.ndarray], unlabelled: list[np.ndarray], least_z: float = 4.0, least_rows: int = 4) -> np.ndarray:
    """Which features occur in clearly more positives than unlabelled rows would let expect; the others get no weight."""
    p, u = (np.bincount(np.concatenate(x), minlength=1 << BITS) for x in (positive, unlabelled))
    share = (p + u) / (len(positive) + len(unlabelled))
    spread = np.sqrt(share * (1 - share) * (1 / len(positive) + 1 / len(unlabelled)) + 1e-12)
    return (p >= least_rows) & ((p / len(positive) - u / len(unlabelled)) / spread > least_z)


def risk(zp: np.ndarray, zu: np.ndarray, prior: float, beta: float = 0.0) -> tuple[float, np.ndarray, np.ndarray]:
    """(risk, direction for zp, direction for zu) of the class-prior-corrected estimator under the logistic loss.

    The unlabelled rows' negative loss holds the positives' share of it, which is taken off. Where what is left falls below -beta
    the fit has begun to memorise: the risk counts it as zero, and the directions are those that lift it again.
    """
    sp, su = 1 / (1 + np.exp(-np.clip(zp, -50, 50))), 1 / (1 + np.exp(-np.clip(zu, -50, 50)))
    positive = prior * float(np.mean(np.logaddexp(0, -zp)))
    negative = float(np.mean(np.logaddexp(0, zu))) - prior * float(np.mean(np.logaddexp(0, zp)))
    if negative >= -beta:  # d L(+)/dz = s - 1, d L(-)/dz = s
        return positive + max(0.0, negative), (prior * (sp - 1) - prior * sp) / len(zp), su / len(zu)
    return positive, prior * sp / len(zp), -su / len(zu)


def calibrate(z: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and offset of the logistic curve of y over z, with smoothed targets; (1, 0) where z doesn't tell the labels apart."""
    n1, n0 = weight[y].sum(), weight[~y].sum()
    target = np.where(y, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([z, np.ones_like(z)], 1)

    def loss(t: np.ndarray) -> float:
        v = x @ t
        return float(np.sum(weight * (np.logaddexp(0, v) - target * v)))

    now = np.array([0.0, np.log((n1 + 1) / (n0 + 1))])
    for _ in range(rounds):
        s = 1 / (1 + np.exp(-np.clip(x @ now, -50, 50)))
        grad = x.T @ (weight * (s - target))
        step = np.linalg.solve((x * (weight * s * (1 - s))[:, None]).T @ x + 1e-9 * np.eye(2), grad)
        size = 1.0
        while size > 1e-6 and loss(now - size * step) > loss(now):
            size /= 2
        now = now - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return (float(now[0]), float(now[1])) if now[0] > 0 and np.isfinite(now).all() else (1.0, 0.0)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, clean: list[np.ndarray] | None = None, counts: tuple[int, int] | None = None, epochs: int = 12, batch: int = 512, rate: float = 0.02, decay: float = 1e-5, beta: float = 0.0, cut: float = 0.7, seed: int = 0) -> Model:
    """Each list entry holds the features of a text. Without positives or unlabelled rows every score is the prior, if that is below `cut`. clean: rows labelled so, for the calibration; counts: how many labelled rows positive and clean stand for."""
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    weights, bias = np.zeros(1 << BITS), float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return Model(weights, min(bias, float(np.log(cut / (1 - cut))) - 1e-6))
    stands = [n / max(1, len(x)) for n, x in zip(counts or (len(positive), len(clean or [])), (positive, clean or []), strict=True)]
    # copies of a text count once, so a group of them doesn't decide what is usual
    positive, unlabelled, clean = (list({f.tobytes(): f for f in x}.values()) for x in (positive, unlabelled, clean or []))
    telling = select(positive, unlabelled)
    positive, unlabelled, clean = ([f[telling[f]] for f in x] for x in (positive, unlabelled, clean))
    rng = np.random.default_rng(seed)
    m1, m2, b1, b2, step = np.zeros_like(weights), np.zeros_like(weights), 0.0, 0.0, 0
    for _ in range(epochs):
        u_order = rng.permutation(len(unlabelled))
        for at in range(0, len(u_order), batch):
            u = u_order[at : at + batch]
            p = rng.integers(0, len(positive), min(batch // 2, len(positive)))
            p_of, p_f = _rows(positive, p)
            u_of, u_f = _rows(unlabelled, u)
            zp = np.bincount(p_of, weights=weights[p_f], minlength=len(p)) + bias
            zu = np.bincount(u_of, weights=weights[u_f], minlength=len(u)) + bias
            _, gp, gu = risk(zp, zu, prior, beta)
            f = np.concatenate([p_f, u_f])
            g = np.concatenate([np.repeat(gp, np.bincount(p_of, minlength=len(p))), np.repeat(gu, np.bincount(u_of, minlength=len(u)))])
            touched, where = np.unique(f, return_inverse=True)
            grad = np.bincount(where, weights=g, minlength=len(touched)) + decay * weights[touched]
            step += 1
            m1[touched] = 0.9 * m1[touched] + 0.1 * grad
            m2[touched] = 0.999 * m2[touched] + 0.001 * grad**2
            weights[touched] -= rate * (m1[touched] / (1 - 0.9**step)) / (np.sqrt(m2[touched] / (1 - 0.999**step)) + 1e-8)
            gb = gp.sum() + gu.sum()
            b1, b2 = 0.9 * b1 + 0.1 * gb, 0.999 * b2 + 0.001 * gb**2
            bias -= rate * (b1 / (1 - 0.9**step)) / (np.sqrt(b2 / (1 - 0.999**step)) + 1e-8)
    if telling.any() and clean:
        of, f = _rows(positive + clean, np.arange(len(positive) + len(clean)))
        y = np.arange(len(positive) + len(clean)) < len(positive)
        slope, offset = calibrate(np.bincount(of, weights=weights[f], minlength=len(y)) + bias, y, np.where(y, *stands))
        weights, bias = slope * weights, slope * bias + offset
    # a text without a telling feature says nothing, so its score stays below the cut
    return Model(weights, min(bias, float(np.log(cut / (1 - cut))) - 1e-6))


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3, is 1; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sample(df: DataFrame, n: int) -> list[np.ndarray]:
    """Features of the n texts whose ids have the smallest hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for a, b in slices(texts):
                of, f = features(texts[a:b])
                cut = np.searchsorted(of, np.arange(1, b - a))
                yield pa.record_batch([pa.array([x.astype("<u4").tobytes() for x in np.split(f, cut)], pa.binary())], ["f"])

    chosen = df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).select("text")
    return [np.frombuffer(r.f, "<u4").astype(np.int64) for r in chosen.mapInArrow(run, "f binary").toLocalIterator()]


def train(docs: DataFrame, labels: DataFrame, max_positive: int = 4000, max_unlabelled: int = 12000, label_col: str = "toxic", **options) -> Model:
    """Fits on rows that aren't held out: positives carry label 1; the unlabelled are drawn from all; clean ones carry another label."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).alias("y")).filter("doc_id IS NOT NULL AND y IS NOT NULL").filter(~held_out())
    marks = marks.groupBy("doc_id").agg(F.max("y").alias("y"))
    n, toxic = marks.agg(F.count("*"), F.sum(F.when(F.col("y") == 1, 1).otherwise(0))).first()
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(~held_out())
    # the chosen positives and unlabelled rows are picked by id before any text moves
    ids = own.select("doc_id").distinct()
    positive = ids.join(marks.filter("y = 1"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_positive)
    unlabelled = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_unlabelled)
    clean = ids.join(marks.filter("y <> 1"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_unlabelled)
    found = [_sample(own.join(F.broadcast(x), "doc_id", "left_semi"), k) for x, k in ((positive, max_positive), (unlabelled, max_unlabelled), (clean, max_unlabelled))]
    return fit(found[0], found[1], (toxic or 0) / n if n else 0.0, found[2], (toxic or 0, n - (toxic or 0)), **options)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs."""
    at = np.flatnonzero(model.weights)
    held = docs.sparkSession.sparkContext.broadcast((at.astype(np.uint32), model.weights[at].astype(np.float32), model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, weights, bias = held.value
        own = Model(np.zeros(1 << BITS), bias)
        own.weights[where] = weights
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            found = np.concatenate([own.scores(texts[a:b]) for a, b in slices(texts)]) if texts else np.zeros(0)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found), pa.array((found >= 0.7).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    return score(docs, train(docs, labels, **options))
