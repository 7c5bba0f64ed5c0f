"""What exact and approximate dense search share: matrices of vectors, blocks of queries, the best of a matrix of scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quill.operators.lexical import TIE

#: Bytes of query vectors in one broadcast, at most.
BLOCK_BYTES = 16 << 20
#: Scores in memory at once, at most.
SCORES = 1 << 22
HITS = "query_id long, chunk_id long, score double"


def unit_rows(m: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, rows) of the lists of dim finite numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.zeros(len(column), dtype=np.int64)
    known = column.is_valid().to_numpy(zero_copy_only=False)
    sizes[known] = np.diff(column.offsets.to_numpy())[known]
    starts = np.cumsum(sizes) - sizes
    at = np.flatnonzero(sizes == dim)
    m = flat.reshape(-1, dim) if len(at) == len(column) else flat[starts[at][:, None] + np.arange(dim)]
    sound = np.isfinite(m).all(axis=1)
    return at[sound], m[sound]


def query_blocks(queries: DataFrame):
    """(ids, unit vectors), in blocks, one dimension each, one at a time. queries: query_id, vec."""
    sound = queries.where(F.col("query_id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0)).select("query_id", F.col("vec").cast("array<double>").alias("vec"), F.size("vec").alias("dim"))
    size = sound.agg(F.sum(F.col("dim").cast("long") * 8)).first()[0] or 0
    n = max(1, -(-2 * size // BLOCK_BYTES)) if size > BLOCK_BYTES else 1
    for b in range(n):
        rows = (sound.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b) if n > 1 else sound).toArrow().combine_chunks()
        for dim in sorted(set(rows.column("dim").to_pylist())):
            at, m = matrix(rows.column("vec").combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.float64())), dim)
            yield rows.column("query_id").to_numpy()[at], unit_rows(m)


def best_of(scores: np.ndarray, chunk: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query row, place) of the k best of each row, ties (to TIE decimal places) to the smaller chunk; minus infinity is none."""
    compared = np.round(scores, TIE)
    n = scores.shape[1]
    bar = np.partition(compared, n - k, axis=1)[:, n - k, None] if n > k else np.full((len(scores), 1), -np.inf)
    q, j = np.nonzero((compared >= bar) & np.isfinite(scores))
    order = np.lexsort((chunk[j], -compared[q, j], q))
    q, j = q[order], j[order]
    first = np.searchsorted(q, q)
    kept = np.arange(len(q)) - first < k
    return q[kept], j[kept]


def scored(rows: DataFrame, ids: np.ndarray, unit: np.ndarray, k: int) -> DataFrame:
    """HITS of each batch of rows (chunk_id, vec)."""
    shared = rows.sparkSession.sparkContext.broadcast((ids, unit))

    def score(batches):
        ids, unit = shared.value
        for batch in batches:
            at, m = matrix(batch.column("vec"), unit.shape[1])
            length = np.linalg.norm(m, axis=1)
            at, m = at[length > 0], m[length > 0] / length[length > 0, None]
            step = max(1, SCORES // max(1, len(unit)))
            for s in range(0, len(at), step):
                chunk = batch.column("chunk_id").to_numpy()[at[s : s + step]]
                scores = unit @ m[s : s + step].T
                q, j = best_of(scores, chunk, k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[q], pa.int64()), pa.array(chunk[j], pa.int64()), pa.array(scores[q, j])], names=["query_id", "chunk_id", "score"])

    return rows.mapInArrow(score, HITS)
