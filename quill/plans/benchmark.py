"""What an index costs and finds: sizes, build time, latencies, and recall against the exact search."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quill.functions.text import pseudo_query
from quill.operators import cells, dense, ranking, store
from quill.sources.shared import checkpoint
from quill.sources.tables import folder_bytes

#: Queries sampled, run before any is timed, and the seed of the sample; shares of the cells that a sweep reads.
QUERIES, WARM_UP, SEED = 50, 5, "0.17"
SWEEP = (0.125, 0.25, 0.5, 1.0)


def sample_queries(chunks: DataFrame, n: int = QUERIES, seed: str = SEED) -> DataFrame:
    """(query_id, query): first sentences of the chunks of over 60 tokens that come first by a digest of seed and id."""
    long = chunks.where(F.col("token_count") > 60)
    return store.seeded_sample(long.select("chunk_id", "content"), "chunk_id", seed, n).select(F.col("chunk_id").alias("query_id"), pseudo_query(F.col("content")).alias("query"))


def percentile(values: list[float], fraction: float) -> float:
    """The value at place round(fraction * (n - 1)), halves to even; 0.0 of none."""
    return sorted(values)[min(len(values) - 1, round(fraction * (len(values) - 1)))] if values else 0.0


def _timed(search, queries: DataFrame, ids: list[int]) -> tuple[float, float]:
    """p50 and p95 milliseconds of searching one query at a time; queries are encoded already."""
    took = []
    for i in ids:
        began = time.perf_counter()
        search(queries.where(F.col("query_id") == i)).collect()  # k rows
        took.append((time.perf_counter() - began) * 1000)
    return percentile(took, 0.5), percentile(took, 0.95)


def benchmark_index(spark: SparkSession, queries: DataFrame, vectors: DataFrame, path: str, n_cells: int | None = None, sweep: tuple[float, ...] = SWEEP, rebuild: bool = False, latencies: bool = True) -> DataFrame:
    """A row for the exact search (n_probe null) and for each breadth: n_probe, recall_at_10, recall_at_50, read_share (of the codes), p50_ms, p95_ms, and rows, index_bytes, table_bytes, build_seconds.

    queries: query_id, vec, a bounded sample. The index at path is built if rebuild is set or none is there.
    """
    queries = checkpoint(queries.select("query_id", "vec"))
    ids = [r[0] for r in queries.select("query_id").orderBy("query_id").collect()]
    if not ids:
        raise RuntimeError("no queries to measure with")
    built = None
    if rebuild or not folder_bytes(spark, f"{path}/vectors"):
        began = time.perf_counter()
        dense.write_index(vectors, path, n_cells)
        built = time.perf_counter() - began
    index = dense.read_index(spark, path)
    rows, size = index.vectors.count(), folder_bytes(spark, path)
    table = sum(folder_bytes(spark, f) for f in vectors.inputFiles())
    truth = checkpoint(dense.search(queries, vectors, 50))
    if latencies:
        _timed(lambda q: dense.search(q, vectors, 50), queries, ids[:WARM_UP])
    timed = lambda f: _timed(f, queries, ids) if latencies else (None, None)
    out = [(None, 1.0, 1.0, 1.0, *timed(lambda q: dense.search(q, vectors, 50)))]
    sizes = {r[0]: r[1] for r in index.codes.groupBy("cell").count().collect()}  # a row a cell
    for share in sweep:
        n = max(1, round(share * len(index.centres)))
        found = checkpoint(index.probed(queries, 50, n))
        recall = [ranking.recall_at_k(truth, found, k).first().recall for k in (10, 50)]
        read = _read_share(index, queries, n, sizes)
        out.append((n, *recall, read, *timed(lambda q, n=n: index.probed(q, 50, n))))
    rows_ = [(*r, rows, size, table, built) for r in out]
    return spark.createDataFrame(rows_, "n_probe int, recall_at_10 double, recall_at_50 double, read_share double, p50_ms double, p95_ms double, rows long, index_bytes long, table_bytes long, build_seconds double")


def _read_share(index: dense.CellIndex, queries: DataFrame, n_probe: int, sizes: dict[int, int]) -> float:
    """The mean share of all codes that a query reads; sizes: codes in each cell."""
    return cells.read_share(index, queries, n_probe, sizes)


def lines(report: DataFrame) -> list[str]:
    """The report for people."""
    rows = sorted(report.collect(), key=lambda r: r.n_probe or 0)  # a row a breadth
    one = rows[0]
    head = [f"  rows indexed           {one.rows}", f"  index size             {one.index_bytes / 2**20:.1f} MiB", f"  table size             {one.table_bytes / 2**20:.1f} MiB"]
    head += [f"  index build time       {one.build_seconds:.2f} s"] if one.build_seconds is not None else []
    ms = lambda v: f"{v:9.1f}" if v is not None else "        -"
    return head + ["  n_probe  recall@10  recall@50     read   p50 ms    p95 ms", *(f"  {'exact' if r.n_probe is None else r.n_probe:>7}  {r.recall_at_10:9.3f}  {r.recall_at_50:9.3f}  {r.read_share:7.3f}{ms(r.p50_ms)} {ms(r.p95_ms)}" for r in rows)]
