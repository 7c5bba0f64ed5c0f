"""Embedding of pending chunks through a content-addressed cache."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quill.operators import store
from quill.sources.shared import checkpoint
from quill.sources.vector_cache import VectorCache

#: Fixed value: what a query is prefixed with for the encoder's family; documents are not.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "


@dataclass(frozen=True)
class DigestEncoder:
    """A stand-in without weights: a unit vector from the text's SHA-256. Equal texts have cosine 1."""

    dimension: int = 384

    def encode_documents(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            raw = (np.frombuffer(hashlib.sha256(t.encode()).digest(), np.uint8).astype(float) - 128) / 128
            v = np.resize(raw, self.dimension)
            out.append((v / np.linalg.norm(v)).tolist())
        return out

    def encode_query(self, text: str) -> list[float]:
        return self.encode_documents([text])[0]


def encode(df: DataFrame, encoder: Callable, text_col: str = "embed_input", batch: int = 32) -> DataFrame:
    """Adds vec. encoder makes an encoder, once a worker."""

    def run(frames):
        own = encoder()
        for frame in frames:
            texts, out = frame[text_col].tolist(), []
            for at in range(0, len(texts), batch):
                out.extend(own.encode_documents(texts[at : at + batch]))
            yield frame.assign(vec=out)

    return df.mapInPandas(run, df.withColumn("vec", F.array().cast("array<float>")).schema)


def encode_queries(queries: DataFrame, encoder: Callable, prefix: str = QUERY_PREFIX) -> DataFrame:
    """Adds vec of the prefixed query."""
    rows = queries.withColumn("_input", F.concat(F.lit(prefix), F.col("query")))
    return encode(rows, encoder, "_input").drop("_input")


def embed(chunks: DataFrame, vectors: DataFrame, model: str, encoder: Callable, chunking: str | None = None, cache: VectorCache | None = None) -> DataFrame:
    """New rows (chunk_id, model, dim, vec, chunk_config_sha256) for chunks without a vector: from the cache where the digest is known, else encoded once a digest.

    Known are the digests of stored chunks that have vectors, or with cache those that it holds; what is encoded is
    put into it at once.
    """
    todo = store.pending_chunks(chunks, vectors, model, chunking)
    wanted = todo.select(F.col("embed_input_sha256").alias("digest"))
    known = (store.cached_vectors(vectors, chunks, wanted, model) if cache is None else cache.lookup(wanted, model)).select("digest", F.col("vec").cast("array<float>").alias("vec"))
    keyed = todo.withColumn("digest", F.coalesce("embed_input_sha256", F.concat(F.lit("chunk:"), F.col("chunk_id").cast("string"))))
    hits = keyed.join(known, "digest")
    misses = keyed.join(known.select("digest"), "digest", "left_anti")
    fresh = encode(misses.groupBy("digest").agg(F.min_by("embed_input", "chunk_id").alias("embed_input")), encoder).select("digest", "vec")
    if cache is not None:
        hits, misses, fresh = checkpoint(hits), checkpoint(misses), checkpoint(fresh)
        cache.put(fresh.where(~F.col("digest").startswith("chunk:")), model)
    made = misses.join(fresh, "digest")
    both = hits.select("chunk_id", "vec", "chunk_config_sha256").unionByName(made.select("chunk_id", "vec", "chunk_config_sha256"))
    return both.select("chunk_id", F.lit(model).alias("model"), F.size("vec").alias("dim"), "vec", "chunk_config_sha256")
