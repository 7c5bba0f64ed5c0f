"""Exact top-k inner products by norm-sorted vectors with rotated partial sums.

Vectors become integer vectors, so scores are exact integers. All vectors' second moments
are summed over the cluster (a matrix of the dimension's size); its singular vectors rotate
vectors so that few leading coordinates carry most of an inner product. Each task takes its
vectors by descending length against a block of queries: as soon as no query's k-th score
can be reached by the length alone (Cauchy-Schwarz) it stops; else the leading coordinates'
sum plus the product of the residual lengths bounds each score, and only vectors that can
still enter are scored exactly: by float64 products while every partial sum is under 2**53, by
64-bit integers while it is under 2**63, by Python's integers beyond. Tasks return k + 1 rows a query,
which a window merges, leaving out the query's own row.

Queries go in blocks of at most BLOCK_BYTES, one after the other: the driver holds one block,
and beyond the first each block's result is written before the next is broadcast.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quill.llm.runtime import checkpoint, map_arrow

#: Bytes of query vectors in one broadcast, at most.
BLOCK_BYTES = 16 << 20
HEAD, STEP = 16, 512


def _matrix(column: pa.Array) -> np.ndarray:
    """Equally long lists of longs as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, x (floor(scale * component) as longs), dim; without null vectors, and those with null or non-finite components, and null ids."""
    x = F.transform(F.col(vector_col).cast("array<double>"), lambda v: F.floor(v * scale))
    sound = F.forall(F.col(vector_col).cast("array<double>"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & F.coalesce(sound, F.lit(False)) & (F.size(vector_col) > 0))
    return rows.select(F.col(id_col).cast("long").alias("id"), x.alias("x"), F.size(vector_col).alias("dim"))


def rotations(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension, the right singular vectors of all its vectors (from their second moments), by descending weight."""

    def moments(batch):
        dims = batch.column("dim").to_numpy()
        for d in np.unique(dims):
            m = _matrix(batch.column("x").filter(pa.array(dims == d))).astype(np.float64)
            yield {"dim": [int(d)], "m": [(m.T @ m).ravel()]}

    parts = map_arrow(vectors.select("x", "dim"), moments, "dim int, m array<double>")
    sums = parts.select("dim", F.posexplode("m").alias("i", "v")).groupBy("dim", "i").agg(F.sum("v").alias("v"))
    out: dict[int, np.ndarray] = {}
    for r in sums.collect():  # dim * dim numbers, whatever the rows
        out.setdefault(r["dim"], np.zeros(r["dim"] ** 2))[r["i"]] = r["v"]
    return {d: np.linalg.svd(m.reshape(d, d))[0] for d, m in out.items()}


#: Less than any score; scores end at the other numbers of 64 bits.
NONE = np.iinfo(np.int64).min


def exact_scores(q: np.ndarray, x: np.ndarray, most: float) -> np.ndarray:
    """Inner products of rows of longs as longs; most bounds their size. What no long can hold becomes the nearest one but NONE."""
    if most < 2**53:
        return np.rint(q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    if most < 2**63:
        return q @ x.T
    products = q.astype(object) @ x.T.astype(object)
    return np.array([[max(NONE + 1, min(-NONE - 1, int(v))) for v in row] for row in products], dtype=np.int64).reshape(products.shape)


def search_block(x: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int, rotation: np.ndarray, head: int = HEAD, step: int = STEP):
    """(query row, id, score, whether the vector is the query's) of the k best of x for each of q; x and q are longs."""
    head = min(head, x.shape[1])
    f, fq = x.astype(np.float64), q.astype(np.float64)
    norm = np.sqrt((f * f).sum(axis=1))
    order = np.lexsort((ids, -norm))
    x, f, ids, norm = x[order], f[order], ids[order], norm[order]
    qn = np.sqrt((fq * fq).sum(axis=1))
    longest = norm[0] if len(norm) else 0.0
    slack = 1e-6 * (1 + qn * longest)  # for the rotation's rounding
    most = 1.001 * float(qn.max(initial=0.0)) * float(longest) + 1
    rq = fq @ rotation
    q_head, q_rest = np.ascontiguousarray(rq[:, :head]), np.sqrt((rq[:, head:] ** 2).sum(axis=1))
    score = np.full((len(q), k), NONE)
    best = np.full((len(q), k), -1)
    for a in range(0, len(x), step):
        live = np.flatnonzero((qn * norm[a] + slack >= score[:, -1]) | (score[:, -1] == NONE))
        if not len(live):
            break
        part, part_ids = x[a : a + step], ids[a : a + step]
        rx = f[a : a + step] @ rotation
        bound = q_head[live] @ rx[:, :head].T + np.outer(q_rest[live], np.sqrt((rx[:, head:] ** 2).sum(axis=1)))
        may = (bound + slack[live, None] >= score[live, -1:]) | (score[live, -1:] == NONE)
        rows = np.flatnonzero(may.any(axis=1))
        if not len(rows):
            continue
        live, may = live[rows], may[rows]
        cols = np.flatnonzero(may.any(axis=0))
        exact = np.where(may[:, cols], exact_scores(q[live], part[cols], most), NONE)
        all_scores = np.hstack([score[live], exact])
        all_rows = np.hstack([best[live], np.broadcast_to(a + cols, exact.shape)])
        # Rows go by descending length, so ties are ordered by id. The least long has no negative: ~ reverses all.
        top = np.lexsort((np.where(all_rows >= 0, ids[all_rows], 0), ~all_scores), axis=1)[:, :k]
        score[live] = np.take_along_axis(all_scores, top, axis=1)
        best[live] = np.take_along_axis(all_rows, top, axis=1)
    i, j = np.nonzero(score > NONE)
    at = best[i, j]
    return i, ids[at], score[i, j], (x[at] == q[i]).all(axis=1)


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, block_bytes: int = BLOCK_BYTES, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row for which is_query holds, the k other rows of largest integer inner product; ties to the smaller id.

    Rows without id, null vectors, empty ones, and those with null or non-finite components
    take no part. Vectors of unlike dimension don't meet. Every row but the query's own is a
    candidate, also one of the same id; rows that repeat are queries each, with a result each.
    Components that no long holds are the nearest long; so are scores. Other columns are not
    carried, whatever they are called.
    """
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, id_col, vector_col, scale)
    turn = rotations(rows)
    shared_turn = spark.sparkContext.broadcast(turn)
    queries = integer_vectors(vectors.where(is_query), id_col, vector_col, scale).groupBy("id", "x", "dim").agg(F.count(F.lit(1)).alias("times"))
    size = queries.agg(F.sum(F.col("dim").cast("long") * 8)).first()[0] or 0
    n_blocks = max(1, -(-2 * size // block_bytes)) if size > block_bytes else 1

    def searched(b: int):
        block = queries.where(F.pmod(F.xxhash64("id", "x"), F.lit(n_blocks)) == b) if n_blocks > 1 else queries
        held = block.toArrow()
        grouped: dict[int, tuple[np.ndarray, ...]] = {}
        dims = held.column("dim").to_numpy()
        for d in np.unique(dims).tolist():
            own = held.filter(pa.array(dims == d))
            x = _matrix(own.column("x").combine_chunks())
            order = np.lexsort((*x.T[::-1], own.column("id").to_numpy()))
            grouped[d] = own.column("id").to_numpy()[order], x[order], own.column("times").to_numpy()[order]
        shared = spark.sparkContext.broadcast(grouped)

        def run(batches):
            # A task's vectors are searched in runs of bounded size, each by descending length.
            held, count = [], 0

            def search():
                table = pa.Table.from_batches(held)
                dims = table.column("dim").to_numpy()
                for d, (q_ids, q, times) in shared.value.items():
                    mine = table.filter(pa.array(dims == d))
                    if mine.num_rows:
                        i, ids, score, same = search_block(_matrix(mine.column("x").combine_chunks()), mine.column("id").to_numpy(), q, k + 1, shared_turn.value[d])
                        yield pa.RecordBatch.from_pydict({"query_id": q_ids[i], "dim": np.full(len(i), d, np.int32), "q": i.astype(np.int64), "times": times[i], "vec_id": ids, "score": score, "own": same & (ids == q_ids[i])})

            for batch in batches:
                if batch.num_rows:
                    held.append(batch)
                    count += batch.num_rows
                    if count >= 1 << 15:
                        yield from search()
                        held, count = [], 0
            if held:
                yield from search()

        found = rows.mapInArrow(run, "query_id long, dim int, q long, times long, vec_id long, score long, own boolean")
        by_query = Window.partitionBy("query_id", "dim", "q")
        # The query's own row: one of those that are equal to it.
        others = found.withColumn("n", F.row_number().over(by_query.orderBy(F.desc("own")))).where(~F.col("own") | (F.col("n") > 1))
        ranked = others.withColumn("rank", F.row_number().over(by_query.orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
        each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))
        return ranked.select("query_id", "rank", "vec_id", "score", each.alias("copy")).drop("copy"), shared

    if n_blocks == 1:
        return searched(0)[0]
    parts = []
    for b in range(n_blocks):
        part, shared = searched(b)
        parts.append(checkpoint(part))
        shared.destroy()
    return reduce(DataFrame.unionByName, parts)
