"""Dense retrieval: exact cosine top-k in blocks of queries. The approximate mode over a stored index is in cells.py.

Scores are computed for a batch of chunks against a block of queries as one matrix product;
each batch gives back its k best for each query, which a window merges. Only the narrow
vector table is scored; metadata joins the k rows that are left.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from quill.operators.cells import CellIndex, read_index, write_index
from quill.operators.lexical import broadcast_if_small, top
from quill.operators.vectors import HITS, query_blocks, scored
from quill.sources.shared import checkpoint

__all__ = ["CellIndex", "read_index", "write_index"]


def search(queries: DataFrame, vectors: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k vectors of largest cosine for each query, ties to the smaller chunk_id.

    vectors: chunk_id, vec, filtered to one model and chunking before. Null vectors, zero
    vectors and those of another dimension than the query's are no candidates. Beyond one block
    of queries each block's hits are written before the next is read.
    """
    rows, found, kept = vectors.select("chunk_id", "vec"), [], None
    for ids, unit in query_blocks(queries):
        if kept is not None:
            found.append(checkpoint(kept))
        kept = scored(rows, ids, unit, k)
    if kept is None:
        return vectors.sparkSession.createDataFrame([], HITS + ", rank long")
    return top(reduce(DataFrame.unionByName, [*found, kept]), k, digits)


def with_metadata(hits: DataFrame, chunks: DataFrame, papers: DataFrame) -> DataFrame:
    """Candidates: hits joined with the chunks and papers they name; only the chunks that are hit reach the join. The search runs once: its hits, k a query, are cut off from it."""
    hits = checkpoint(hits)
    wanted = broadcast_if_small(hits.select("chunk_id").distinct())
    return hits.join(chunks.join(wanted, "chunk_id", "left_semi"), "chunk_id").join(papers, "paper_id")
