"""Writes that can be repeated, skips, caches, statistics and samples over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quill.sources.shared import checkpoint

CHUNK_KEY = ("paper_id", "ordinal", "content_sha256", "chunk_config_sha256")
VECTOR_KEY = ("chunk_id", "model")
SHORT_CHUNK = 50


def one_of_each(df: DataFrame, key: tuple[str, ...], order: tuple) -> DataFrame:
    """The first row of each key in the order, which must be total for a stable choice."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def insert_ignore(existing: DataFrame, new: DataFrame, key: tuple[str, ...], order: tuple = ()) -> DataFrame:
    """Rows of new whose key is not there yet, one a key: what an insert that ignores conflicts adds."""
    return one_of_each(new, key, order or key).join(existing.select(*key), list(key), "left_anti")


def upsert(existing: DataFrame, new: DataFrame, key: str, update: tuple[str, ...]) -> DataFrame:
    """existing with the update columns of rows that new has too, and new's other rows; columns not in update stay as they were (null for new rows)."""
    a, b = existing.alias("a"), new.alias("b")
    took = F.col(f"b.{key}").isNotNull()
    columns = [F.coalesce(f"a.{key}", f"b.{key}").alias(key)]
    for c in existing.columns:
        if c != key:
            columns.append((F.when(took, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")) if c in update else F.col(f"a.{c}")).alias(c))
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(*columns)


def numbered(df: DataFrame, order: tuple[str, ...], name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """df with its place from 1 in the order, within the columns by (the first of the order), and no task that holds more than a part of the rows.

    Rows are dealt by ranges of the order and written; what comes before a range is known from
    the ranges' counts. Rows alike in all of order may change places.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = checkpoint(ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    parts = rows.groupBy("_part", *by).agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part, and key of it
    parts = parts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    parts = parts.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], "_before", "_first")
    on = F.col("_part") == F.col("_p")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    out = rows.join(parts, on).withColumn(name, (F.col("_before") + F.col("_at") - F.col("_first") + 1).cast("long"))
    return out.select(*df.columns, name)


def with_chunk_ids(chunks: DataFrame, start: int = 0) -> DataFrame:
    """Adds chunk_id: dense from start + 1 in the order of chunking, paper and ordinal."""
    out = numbered(chunks, ("chunk_config_sha256", "paper_id", "ordinal", "content_sha256"), "chunk_id")
    return out.withColumn("chunk_id", F.col("chunk_id") + F.lit(start).cast("long"))


def nearest_rank_by(df: DataFrame, key: str, value: str, fraction: float, name: str) -> DataFrame:
    """(key, name): of each key the value at place round(fraction * (n - 1)), halves to even; nulls are no values. A hot key's values are in many tasks."""
    known = df.where(F.col(value).isNotNull()).select(key, value)
    sizes = known.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    at = F.bround(F.lit(float(fraction)) * (F.col("_n") - 1)).cast("long")
    wanted = sizes.select(F.col(key).alias("_key"), (F.least(F.greatest(at, F.lit(0).cast("long")), F.col("_n") - 1) + 1).alias("_place"))
    placed = numbered(known, (key, value), "_rank", (key,))
    return placed.join(wanted, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_rank") == F.col("_place"))).select(key, F.col(value).alias(name))


def unchanged(papers: DataFrame, existing: DataFrame, chunks: DataFrame, chunking: str) -> DataFrame:
    """papers (id, pdf_sha256, …) that need no work: the same digest is stored and chunks of this chunking are there."""
    same = existing.select("id", "pdf_sha256")
    there = chunks.where(F.col("chunk_config_sha256") == chunking).select(F.col("paper_id").alias("id"))
    return papers.join(same, ["id", "pdf_sha256"], "left_semi").join(there, "id", "left_semi")


def pending_chunks(chunks: DataFrame, vectors: DataFrame, model: str, chunking: str | None = None) -> DataFrame:
    """Chunks without a vector of the model."""
    rows = chunks if chunking is None else chunks.where(F.col("chunk_config_sha256") == chunking)
    return rows.join(vectors.where(F.col("model") == model).select("chunk_id"), "chunk_id", "left_anti")


def cached_vectors(vectors: DataFrame, chunks: DataFrame, digests: DataFrame, model: str) -> DataFrame:
    """(digest, vec): of each of the digests (column digest), the stored vector of the least chunk_id. Null digests have none."""
    own = chunks.where(F.col("embed_input_sha256").isNotNull()).select("chunk_id", F.col("embed_input_sha256").alias("digest")).join(digests.select("digest").distinct(), "digest", "left_semi")
    met = vectors.where(F.col("model") == model).select("chunk_id", "vec").join(own, "chunk_id")
    return met.groupBy("digest").agg(F.min_by("vec", "chunk_id").alias("vec"), F.min("chunk_id").alias("chunk_id"))


def embed_plan(chunks: DataFrame, vectors: DataFrame, model: str, chunking: str | None = None) -> DataFrame:
    """(chunk_id, digest, status) of each chunk: already, cached (its digest has a vector), encoded (first of a new digest) or duplicate (of one). Null digests are always encoded."""
    rows = (chunks if chunking is None else chunks.where(F.col("chunk_config_sha256") == chunking)).select("chunk_id", F.col("embed_input_sha256").alias("digest"))
    own = vectors.where(F.col("model") == model).select("chunk_id", F.lit(True).alias("_has"))
    known = cached_vectors(vectors, chunks, rows, model).select("digest", F.lit(True).alias("_known"))
    rows = rows.join(own, "chunk_id", "left").join(known, "digest", "left")
    first = F.row_number().over(Window.partitionBy("digest", F.col("_has").isNull()).orderBy("chunk_id")) == 1
    status = F.when(F.col("_has"), "already").when(F.col("digest").isNull(), "encoded").when(F.col("_known"), "cached").when(first, "encoded").otherwise("duplicate")
    return rows.select("chunk_id", "digest", status.alias("status"))


def embed_report(plan: DataFrame) -> DataFrame:
    """One row: already_embedded, cache_hits, encoded, duplicates, hit_rate."""
    n = lambda s: F.count_if(F.col("status") == s)
    hits, new = n("cached"), n("encoded")
    return plan.agg(n("already").alias("already_embedded"), hits.alias("cache_hits"), new.alias("encoded"), n("duplicate").alias("duplicates"), F.when(hits + new > 0, hits / (hits + new)).otherwise(0.0).alias("hit_rate"))


def corpus_stats(papers: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row of counts over all chunkings; means are over papers that have chunks."""
    c = chunks.agg(
        F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("token_count") < SHORT_CHUNK).alias("short_chunks"), F.countDistinct("chunk_config_sha256").alias("chunkings"),
        F.countDistinct("section_path").alias("distinct_sections"), F.countDistinct("paper_id").alias("papers_with_chunks"), F.coalesce(F.sum(F.col("page_end") - F.col("page_start") + 1), F.lit(0)).alias("pages"),
    )
    both = papers.agg(F.count(F.lit(1)).alias("papers")).crossJoin(c)  # one row each
    return both.withColumn("mean_chunks_per_paper", F.when(F.col("papers_with_chunks") > 0, F.col("chunks") / F.col("papers_with_chunks")).otherwise(0.0))


def fallback_papers(chunks: DataFrame) -> DataFrame:
    """One row: how many papers have all their chunks in the section Body."""
    return chunks.groupBy("paper_id").agg(F.bool_and(F.col("section_path") == "Body").alias("all_body")).where("all_body").agg(F.count(F.lit(1)).alias("fallback_papers"))


def token_percentiles(chunks: DataFrame) -> DataFrame:
    """One row: min, p5, p25, p50, p75, p95, max of token_count, exact; all null of no chunks."""
    p = lambda f: F.percentile("token_count", F.lit(f))
    return chunks.agg(F.min("token_count").alias("min"), p(0.05).alias("p5"), p(0.25).alias("p25"), p(0.5).alias("p50"), p(0.75).alias("p75"), p(0.95).alias("p95"), F.max("token_count").alias("max"))


def seeded_sample(df: DataFrame, id_col: str, seed: str, n: int) -> DataFrame:
    """The n rows that come first by the digest of seed and id: the feature is the limit."""
    return df.withColumn("_key", F.sha2(F.concat(F.lit(seed), F.col(id_col).cast("string")), 256)).orderBy("_key", id_col).limit(n).drop("_key")


#: Ids in one request, at most.
REQUEST = 100


def fetch_by_ids(ids: DataFrame, metadata: DataFrame) -> DataFrame:
    """metadata rows for ids (position, id) in the requested order, each row once; an id without version finds the row of the latest version, by its number."""
    version = F.regexp_extract("id", r"v(\d+)$", 1).cast("long")
    exact = metadata.select(F.col("id").alias("_exact"), F.col("id").alias("_id1"))
    bare = metadata.groupBy(F.regexp_replace("id", r"v\d+$", "").alias("_bare")).agg(F.max_by("id", F.struct(F.coalesce(version, F.lit(-1)), "id")).alias("_id2"))
    found = ids.join(exact, ids["id"] == exact["_exact"], "left").join(bare, ids["id"] == bare["_bare"], "left").select("position", F.coalesce("_id1", "_id2").alias("_found"))
    first = found.where("_found is not null").groupBy("_found").agg(F.min("position").alias("position"))
    return metadata.join(first, metadata["id"] == first["_found"]).drop("_found")


def missing_ids(ids: DataFrame, metadata: DataFrame) -> DataFrame:
    """ids that find no row."""
    known = metadata.select(F.col("id").alias("_k")).union(metadata.select(F.regexp_replace("id", r"v\d+$", ""))).distinct()
    return ids.join(known, ids["id"] == known["_k"], "left_anti")


def backfill_chunking_key(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """vectors with the chunking key of their chunks; those without a chunk keep theirs."""
    own = chunks.select("chunk_id", F.col("chunk_config_sha256").alias("_key"))
    return vectors.join(own, "chunk_id", "left").withColumn("chunk_config_sha256", F.coalesce("_key", "chunk_config_sha256")).drop("_key")
