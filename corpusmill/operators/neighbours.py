"""Exact nearest neighbours of a query set, in blocks of queries against all rows."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import materialize


#: Rows and queries whose products are held at once (8 bytes each, several times over).
TILE = (1024, 512)


def nearest_vectors(queries: DataFrame, base: DataFrame, id_col: str, vec_col: str, block: int = 4096) -> DataFrame:
    """(query_id, id, cosine): the base row nearest to each query, itself left out; the smallest id at a tie.

    Each block of queries (at most about `block` vectors) goes to all tasks, which
    send their best hit for each query. Null vectors are skipped.
    """
    q = queries.filter(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    b = base.filter(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    blocks = max(1, math.ceil(q.count() / block))

    def unit(m: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(n > 0, n, 1)

    def search(rows: list) -> DataFrame:
        held = base.sparkSession.sparkContext.broadcast((np.array([r.id for r in rows], np.int64), unit(np.array([r.v for r in rows], float).reshape(len(rows), -1))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, m = held.value
            best, where = np.full(len(ids), -2.0), np.zeros(len(ids), np.int64)
            for batch in batches:
                own = batch.column(0).to_numpy(zero_copy_only=False)
                if not len(own) or not len(ids):
                    continue
                values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
                for at in range(0, len(own), TILE[0]):
                    part = own[at : at + TILE[0]]
                    order = np.argsort(part, kind="stable")
                    part, other = part[order], unit(values[at : at + TILE[0]][order]).T
                    for q in range(0, len(ids), TILE[1]):
                        mine = slice(q, q + TILE[1])
                        sims = np.round(m[mine] @ other, 6)
                        sims[ids[mine, None] == part[None, :]] = -2.0
                        k = sims.argmax(axis=1)
                        top, who = sims[np.arange(len(k)), k], part[k]
                        better = (top > best[mine]) | ((top == best[mine]) & (who < where[mine]))
                        best[mine], where[mine] = np.where(better, top, best[mine]), np.where(better, who, where[mine])
            seen = best > -2.0
            yield pa.record_batch([pa.array(ids[seen]), pa.array(where[seen]), pa.array(best[seen])], ["query_id", "id", "cosine"])

        return b.mapInArrow(run, "query_id bigint, id bigint, cosine double")

    parts = []
    for k in range(blocks):  # of several blocks, the driver holds one at a time
        found = search(q.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).collect())
        parts.append(found if blocks == 1 else materialize(found, "neighbours"))
    hits = reduce(DataFrame.unionByName, parts).groupBy("query_id").agg(F.max(F.struct("cosine", (-F.col("id")).alias("neg"))).alias("x"))
    return hits.select("query_id", (-F.col("x.neg")).alias(id_col), F.col("x.cosine").alias("cosine"))
