"""Similarity search of a stated query set against all vectors, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: More query vectors than this are not sent to the executors.
MAX_QUERIES = 100_000
#: Vectors scored at once.
BLOCK = 4_096


def top1(vectors: DataFrame, key: str, vector: str, queries: DataFrame) -> DataFrame:
    """(query_id, match_id): for each query the other vector with the greatest dot product; ties take the least id.

    Each block of vectors is multiplied with all queries at once; a partition keeps one candidate per query, and the
    candidates of all partitions are combined map-side. Vectors of another length than the query's, or with nulls, and
    null ids are passed over.
    """
    rows = queries.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(key, vector).take(MAX_QUERIES + 1)
    if len(rows) > MAX_QUERIES:
        raise ValueError(f"more than {MAX_QUERIES} query vectors")
    by_size: dict[int, list] = {}
    for r in rows:
        if r[1] and None not in r[1]:
            by_size.setdefault(len(r[1]), []).append((r[0], r[1]))
    sets = {n: (np.array([q for q, _ in v], np.int64), np.array([x for _, x in v], np.float64)) for n, v in by_size.items()}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[float, int]] = {}
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                for n, (ids, q) in sets.items():
                    pairs = [(k, v) for k, v in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if v and len(v) == n and None not in v]
                    if not pairs:
                        continue
                    keys = np.array([k for k, _ in pairs], np.int64)
                    order = np.argsort(keys, kind="stable")
                    keys = keys[order]
                    found = np.array([v for _, v in pairs], np.float64)[order] @ q.T
                    found[keys[:, None] == ids[None, :]] = -np.inf
                    top = found.argmax(axis=0)
                    for i, k in enumerate(top):
                        s = float(found[k, i])
                        now = best.get(int(ids[i]))
                        if s > -np.inf and (now is None or (s, -keys[k]) > (now[0], -now[1])):
                            best[int(ids[i])] = (s, int(keys[k]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(best), pa.int64()), pa.array([m for _, m in best.values()], pa.int64()), pa.array([s for s, _ in best.values()], pa.float64())],
            names=["query_id", "match_id", "s"],
        )

    found = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long"), vector)
    return (
        found.mapInArrow(score, "query_id long, match_id long, s double")
        .groupBy("query_id")
        .agg(F.max_by("match_id", F.struct("s", -F.col("match_id"))).alias("match_id"))
    )
