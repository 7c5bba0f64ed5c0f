"""retrieve(): the one door to search. One lazy plan answers all queries of a table."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quill.config import RetrievalConfig
from quill.functions.text import count_words
from quill.operators import dense, impacts, lexical, ranking
from quill.sources.shared import checkpoint
from quill.telemetry import StageTimer

HITS = "query_id long, chunk_id long, score double, rank long"


def _arms(queries: DataFrame, chunks: DataFrame, vectors: DataFrame | None, config: RetrievalConfig, stemmed: bool = True, index: DataFrame | impacts.PostingsIndex | None = None, cells: dense.CellIndex | None = None, chunking: str | None = None) -> dict[str, DataFrame]:
    """The arms that the configuration wants; others are never planned."""
    arms = {}
    if config.wants_dense and cells is not None:
        arms["dense"] = cells.widened(queries.select("query_id", "vec"), config.dense_top_k, config.n_probe(len(cells.centres)))
    elif config.wants_dense and vectors is not None:
        arms["dense"] = dense.search(queries.select("query_id", "vec"), vectors, config.dense_top_k)
    if config.wants_lexical and isinstance(index, impacts.PostingsIndex):
        arms["lexical"] = index.search(queries, config.lexical_top_k, chunking)
    elif config.wants_lexical:
        arms["lexical"] = lexical.search(queries, chunks, config.lexical_top_k, stemmed, index)
    return arms


def one_chunking(df: DataFrame, chunking: str | None) -> DataFrame:
    """Filtered before any ranking, so that no other chunking takes places; prunes partitions where the table is partitioned by the key."""
    return df if chunking is None else df.where(F.col("chunk_config_sha256") == chunking)


def _joined(queries: DataFrame, arms: dict[str, DataFrame], config: RetrievalConfig) -> DataFrame:
    if not arms:
        return queries.sparkSession.createDataFrame([], HITS)
    return ranking.reciprocal_rank_fusion(list(arms.values()), config.rrf_k) if config.fusion == "rrf" else next(iter(arms.values()))


def fused(queries: DataFrame, chunks: DataFrame, vectors: DataFrame | None, config: RetrievalConfig, stemmed: bool = True, index: DataFrame | impacts.PostingsIndex | None = None, cells: dense.CellIndex | None = None, chunking: str | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank) before reranking."""
    return _joined(queries, _arms(queries, chunks, vectors, config, stemmed, index, cells, chunking), config)


def retrieve(
    queries: DataFrame,
    chunks: DataFrame,
    vectors: DataFrame | None = None,
    config: RetrievalConfig = RetrievalConfig(),
    scorer=None,
    stemmed: bool = True,
    index: DataFrame | impacts.PostingsIndex | None = None,
    chunking: str | None = None,
    model: str | None = None,
    cells: dense.CellIndex | None = None,
) -> DataFrame:
    """(query_id, chunk_id, score, fused_rank, rerank_score, rank, reason) of the final_top_k chunks of each query.

    queries: query_id, query, and vec if there is a dense arm. chunks: chunk_id, content.
    vectors: chunk_id, vec. With chunking (and model) both tables are filtered by their key
    first, and so is index, stored postings (plain or in blocks) that take the place of chunks in the lexical arm; cells,
    a stored index of one chunking's vectors, takes the place of vectors. Queries without
    candidates give no row; refused ones (best rerank_score under the floor) have a reason.
    """
    chunks = one_chunking(chunks, chunking)
    index = index if index is None or isinstance(index, impacts.PostingsIndex) else one_chunking(index, chunking)
    if vectors is not None:
        vectors = one_chunking(vectors, chunking)
        vectors = vectors if model is None else vectors.where(F.col("model") == model)
    hits = fused(queries, chunks, vectors, config, stemmed, index, cells, chunking)
    return _finished(hits, queries, chunks, config, scorer)


def _finished(hits: DataFrame, queries: DataFrame, chunks: DataFrame, config: RetrievalConfig, scorer) -> DataFrame:
    best = ranking.rerank(hits, queries, chunks, scorer or ranking.word_overlap_scorer(), config.rerank_top_n, config.final_top_k, config.rerank_enabled)
    return ranking.apply_floor(best, config.score_floor).select("query_id", "chunk_id", "score", "fused_rank", "rerank_score", "rank", "reason")


#: What a result shows of a chunk and its paper.
SHOWN = ("paper_id", "section_path", "content", "page_start", "page_end", "char_start", "char_end")


def candidates(results: DataFrame, chunks: DataFrame, papers: DataFrame | None = None) -> DataFrame:
    """results with what chunks has of SHOWN, and paper_title of papers (id, title). Only the chunks that are named reach the join."""
    shown = [c for c in SHOWN if c in chunks.columns]
    results = checkpoint(results)  # the search behind it runs once
    wanted = lexical.broadcast_if_small(results.select("chunk_id").distinct())
    out = results.join(chunks.select("chunk_id", *shown).join(wanted, "chunk_id", "left_semi"), "chunk_id", "left")
    if papers is not None:
        out = out.join(papers.select(F.col("id").alias("paper_id"), F.col("title").alias("paper_title")), "paper_id", "left")
    return out


@dataclass
class Result:
    """What run() found: candidates, a summary row a query, what reranking did, and milliseconds by stage."""

    candidates: DataFrame
    summary: DataFrame
    stats: DataFrame
    timings_ms: dict[str, float]


def run(queries: DataFrame, chunks: DataFrame, vectors: DataFrame | None = None, papers: DataFrame | None = None, config: RetrievalConfig = RetrievalConfig(), scorer=None, stemmed: bool = True, index: DataFrame | None = None, cells: dense.CellIndex | None = None, timer: StageTimer | None = None) -> Result:
    """retrieve(), stage by stage: each stage is written before the next, so that it can be timed and counted. Stages that the configuration leaves out are not timed."""
    timer = timer or StageTimer()
    arms = {}
    for name, arm in _arms(queries, chunks, vectors, config, stemmed, index, cells).items():
        with timer.stage(f"{name}_ms"):
            arms[name] = checkpoint(arm)
    with timer.stage("fusion_ms"):
        hits = checkpoint(_joined(queries, arms, config))
    with timer.stage("rerank_ms"):
        best = checkpoint(_finished(hits, queries, chunks, config, scorer))
    scored = hits.where(F.col("rank") <= config.rerank_top_n) if config.rerank_enabled else hits.limit(0)
    pairs = scored.join(chunks.select("chunk_id", "content"), "chunk_id").join(lexical.broadcast_if_small(queries.select("query_id", "query")), "query_id")
    tokens = count_words(F.col("query")) + count_words(F.col("content"))
    sizes = arms | {"fused": hits}
    return Result(candidates(best.where(F.col("reason").isNull()), chunks, papers), summary(queries, best, sizes), ranking.stats(queries, best, pairs, tokens), timer.snapshot())


def summary(queries: DataFrame, results: DataFrame, arms: dict[str, DataFrame] | None = None) -> DataFrame:
    """One row a query: chunk_ids in rank order (empty if refused), n, refused, reason, and the size of each arm given."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"])  # final_top_k a query
    own = results.groupBy("query_id").agg(ordered.alias("_ids"), F.max("reason").alias("reason"))
    out = queries.select("query_id").join(own, "query_id", "left")
    for name, arm in (arms or {}).items():
        out = out.join(arm.groupBy("query_id").agg(F.count(F.lit(1)).alias(f"{name}_count")), "query_id", "left").withColumn(f"{name}_count", F.coalesce(f"{name}_count", F.lit(0)))
    refused = F.col("reason").isNotNull()
    ids = F.when(refused | F.col("_ids").isNull(), F.array().cast("array<long>")).otherwise(F.col("_ids"))
    return out.withColumns({"chunk_ids": ids, "refused": refused}).withColumn("n", F.size("chunk_ids")).drop("_ids")


def compare_modes(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, config: RetrievalConfig = RetrievalConfig(), scorer=None, stemmed: bool = True, index: DataFrame | None = None) -> DataFrame:
    """(arm, query_id, chunk_id, rank, was): lexical_only, dense_only, rrf, and rrf with reranking side by side. Each arm is searched and written once."""
    both = replace(config, fusion="rrf", dense_enabled=True, lexical_enabled=True)
    arms = {name: checkpoint(arm) for name, arm in _arms(queries, chunks, vectors, both, stemmed, index).items()}
    hits = checkpoint(_joined(queries, arms, both))
    best = _finished(hits, queries, chunks, replace(both, rerank_enabled=True, score_floor=-1e9), scorer)
    first = lambda df: df.where(F.col("rank") <= config.final_top_k).withColumn("fused_rank", F.col("rank"))
    modes = {"lexical_only": first(arms["lexical"]), "dense_only": first(arms["dense"]), "rrf": first(hits), "rrf_rerank": best}
    parts = [df.select(F.lit(mode).alias("arm"), "query_id", "chunk_id", "rank", F.col("fused_rank").alias("was")) for mode, df in modes.items()]
    return reduce(DataFrame.unionByName, parts)
