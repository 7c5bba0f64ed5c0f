"""Fusion of ranked arms, reranking, the refusal floor, and what is measured of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quill.functions.text import overlap_terms, word_overlap
from quill.operators.lexical import TIE, broadcast_if_small


def reciprocal_rank_fusion(arms: list[DataFrame], k: int = 60, limit: int | None = None, digits: int | None = 9) -> DataFrame | None:
    """(query_id, chunk_id, score, rank): summed 1 / (k + rank) over arms of (query_id, chunk_id, rank, …); None of no arms.

    Other columns that all arms have are taken from the arm where the chunk ranks best, the
    earlier arm if they rank alike. Ties (to TIE decimal places) go to the smaller chunk_id;
    scores are returned to digits.
    """
    if not arms:
        return None
    more = [c for c in arms[0].columns if c not in ("query_id", "chunk_id", "rank", "score", "rerank_score") and all(c in a.columns for a in arms)]
    parts = [a.select("query_id", "chunk_id", "rank", F.lit(i).alias("arm"), *more) for i, a in enumerate(arms)]
    total = F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank")))
    best = [F.min_by(c, F.struct("rank", "arm")).alias(c) for c in more]
    fused = reduce(DataFrame.unionByName, parts).groupBy("query_id", "chunk_id").agg(total.alias("score"), *best)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", TIE)), "chunk_id")
    fused = fused.withColumn("rank", F.row_number().over(order).cast("long"))
    fused = fused.withColumn("score", F.round("score", digits)) if digits else fused
    return fused.where(F.col("rank") <= limit) if limit is not None else fused


def word_overlap_scorer(offset: float = 0.0):
    """A reranker of DataFrame functions: occurrences of the query's words. Adds rerank_score to rows with query and content."""
    return lambda pairs: pairs.withColumn("rerank_score", word_overlap(F.col("content"), overlap_terms(F.col("query"))) + F.lit(offset))


def constant_scorer(value: float):
    return lambda pairs: pairs.withColumn("rerank_score", F.lit(float(value)))


def arrow_scorer(score, batch: int = 16):
    """A reranker from score(queries, passages) -> numbers, called for batches of pairs; load models inside it, once a worker."""

    def run(pairs: DataFrame) -> DataFrame:
        def scored(frames):
            for frame in frames:
                out = []
                for at in range(0, len(frame), batch):
                    part = frame.iloc[at : at + batch]
                    out.extend(score(part["query"].tolist(), part["content"].tolist()))
                yield frame.assign(rerank_score=[float(x) for x in out])

        return pairs.mapInPandas(scored, pairs.withColumn("rerank_score", F.lit(0.0)).schema)

    return run


def rerank(fused: DataFrame, queries: DataFrame, chunks: DataFrame, scorer, top_n: int, final_k: int, enabled: bool = True) -> DataFrame:
    """fused with rerank_score and fused_rank, the final_k best of each query by rerank_score (ties to the smaller chunk_id).

    Only the first top_n of a query are scored; their content joins after that cut. Not
    enabled: the first final_k as they are, rerank_score null.
    """
    base = fused.withColumn("fused_rank", F.col("rank"))
    if not enabled:
        return base.withColumn("rerank_score", F.lit(None).cast("double")).where(F.col("rank") <= final_k)
    # Few small rows, each of them much work: dealt out before their texts join, and not put together again.
    tasks = int(fused.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = base.where(F.col("rank") <= top_n).repartition(tasks, "query_id", "chunk_id")
    texts = chunks.select("chunk_id", "content")
    pairs = cut.join(texts, "chunk_id").join(broadcast_if_small(queries.select("query_id", "query")), "query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "chunk_id")
    scored = scorer(pairs).drop("content", "query")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= final_k)


def apply_floor(reranked: DataFrame, floor: float) -> DataFrame:
    """Adds reason: not null for all rows of a query whose best rerank_score is under the floor. Rows without rerank_score are never refused."""
    best = F.max("rerank_score").over(Window.partitionBy("query_id"))
    return reranked.withColumn("reason", F.when(best < F.lit(float(floor)), F.lit("below_score_floor")))


def rank_movement(reranked: DataFrame) -> DataFrame:
    """(query_id, survivors, mean_movement, max_movement) over the rows that survive; see stats() for queries without any."""
    move = F.abs(F.col("fused_rank") - F.col("rank"))
    return reranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("survivors"), F.avg(move).alias("mean_movement"), F.max(move).alias("max_movement"))


def stats(queries: DataFrame, reranked: DataFrame, pairs: DataFrame | None = None, tokens=None) -> DataFrame:
    """(query_id, survivors, mean_movement, max_movement, and scored, truncated_pairs, truncation_rate if pairs are given): a row for every query, zeros where it has none."""
    out = queries.select("query_id").join(rank_movement(reranked), "query_id", "left")
    if pairs is not None:
        out = out.join(truncation_rate(pairs, tokens), "query_id", "left")
    return out.na.fill(0)


def truncation_rate(pairs: DataFrame, tokens, limit: int = 512) -> DataFrame:
    """(query_id, scored, truncated_pairs, truncation_rate): pairs with more tokens than the reranker reads."""
    cut = F.count_if(tokens > limit)
    n = F.count(F.lit(1))
    return pairs.groupBy("query_id").agg(n.alias("scored"), cut.alias("truncated_pairs"), F.when(n > 0, cut / n).otherwise(0.0).alias("truncation_rate"))


def recall_at_k(exact: DataFrame, approximate: DataFrame, k: int) -> DataFrame:
    """One row, recall: the mean over queries of the share of the exact first k that the approximate first k have. Queries without exact hits are left out; 0.0 without any."""
    ids = lambda df, name: df.where(F.col("rank") <= k).groupBy("query_id").agg(F.collect_set("chunk_id").alias(name))  # noqa: E731  k ids a query
    both = ids(exact, "truth").join(ids(approximate, "found"), "query_id", "left")
    share = F.size(F.array_intersect("truth", F.coalesce("found", F.array().cast("array<long>")))) / F.size("truth")
    return both.agg(F.coalesce(F.avg(share), F.lit(0.0)).alias("recall"))
