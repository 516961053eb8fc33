"""Nearest neighbours among whole vectors by squared Euclidean distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Bytes of queries that are sent to all tasks at once; more queries mean more passes over the vectors.
QUERY_BYTES = 16 << 20
#: Doubles that a comparison holds at once.
ROOM = 1 << 21


def knn_l2(vectors: DataFrame, queries: DataFrame, k: int, size: int) -> DataFrame:
    """query, k, id, ed for vectors(id, v) and queries(id, v) of this size: the k nearest other ids, ties by id.

    Each batch keeps its own k best, so what is ranked in the end is k rows a batch and query.
    """
    good = queries.where(F.size("v") == size).select("id", F.col("v").cast("array<double>").alias("v"))
    most = max(1, QUERY_BYTES // (8 * size))
    count = good.count()
    parts = 1 if count <= most else 2 * -(-count // most)
    found = None
    for p in range(parts):
        own = good if parts == 1 else good.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == p)
        rows = sorted((r.id, r.v) for r in own.collect())
        if rows:
            part = _nearest(vectors, np.array([i for i, _ in rows]), np.array([v for _, v in rows]), k)
            found = part if found is None else found.unionByName(part)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query long, k long, id long, ed double")
    order = W.partitionBy("query").orderBy("ed", "id")
    return found.withColumn("k", F.row_number().over(order).cast("long")).where(F.col("k") <= k).select("query", "k", "id", "ed")


def _nearest(vectors: DataFrame, ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    squares = (q**2).sum(1)

    def best(own: np.ndarray, x: np.ndarray, lo: int, hi: int) -> pa.RecordBatch:
        """One product for all queries of the slice; what may be among the k best, by its rounding error, is worked out exactly."""
        each = (x**2).sum(1)
        rough = each[:, None] + squares[lo:hi] - 2 * (x @ q[lo:hi].T)
        rough[own[:, None] == ids[lo:hi]] = np.inf
        limit = np.partition(rough, k - 1, axis=0)[k - 1] if len(x) > k else np.full(hi - lo, np.inf)
        slack = 1e-12 * q.shape[1] * (each.max(initial=0) + squares[lo:hi])
        i, j = np.nonzero((rough <= limit + slack) & (rough < np.inf))
        ed = np.empty(len(i))
        for a in range(0, len(i), ROOM // q.shape[1] + 1):
            part = slice(a, a + ROOM // q.shape[1] + 1)
            ed[part] = ((x[i[part]] - q[lo:hi][j[part]]) ** 2).sum(1)
        order = np.lexsort((own[i], ed, j))
        i, j, ed = i[order], j[order], ed[order]
        first = np.searchsorted(j, np.arange(hi - lo))
        keep = np.arange(len(j)) - first[j] < k
        return pa.RecordBatch.from_pydict({"query": pa.array(ids[lo:hi][j[keep]], pa.int64()), "id": pa.array(own[i[keep]], pa.int64()), "ed": ed[keep]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("id").to_numpy()
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
            step = max(1, ROOM // max(1, len(own)))
            for lo in range(0, len(ids), step):
                yield best(own, x, lo, min(len(ids), lo + step))

    good = vectors.where(F.size("v") == q.shape[1]).select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    return good.mapInArrow(run, "query long, id long, ed double")
