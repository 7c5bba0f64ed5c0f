"""A training corpus from documents: toxicity, line dedup, near-dedup, decontamination, packing."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quill.llm import decontaminate, line_dedup, packing, simhash, toxicity
from quill.llm.queries import tokenizer_path
from quill.llm.runtime import TABLES, fresh, remainder, remove_folder, remove_tables, shared_folder

#: FTRL and SimHash can't be said in DuckDB's SQL.
ORACLE_SQL = None
#: Jaccard similarity of sets of five-word shingles that makes near copies, beside near fingerprints.
SIMILARITY = 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the model learns from labelled rows of the corpus. Null and empty texts stay unless the intercept alone rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, F.coalesce(remainder("doc_id", 4) != 2, F.lit(False)))
    name = fresh(docs, "score")
    scored = toxicity.score(docs, model, keep=docs.columns, score_col=name)
    return scored.where(F.col(name) < toxicity.THRESHOLD).drop(name)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its text without the repeated chunks and runs of lines; n_chars follows the text where lines went."""
    name = fresh(docs, "n_lines_removed")
    out = line_dedup.line_dedup(docs, removed_col=name, with_runs=True)
    return out.withColumn("n_chars", F.when(F.col(name) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop(name)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each class of near copies. Rows without an id, or with one that other texts share, are judged by their own text."""
    return simhash.representatives(docs, similarity=SIMILARITY)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs; a row's own text decides, whoever shares its id."""
    return decontaminate.without_hits(docs, decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near-dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again.

    A stage's folder goes as soon as the next one's is whole, and what the stage itself wrote in
    between as soon as its own is; the last folder, which the result reads, goes with the session.
    """
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before = len(TABLES)
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        remove_tables(spark, before)
        docs = spark.read.parquet(f"{base}/{k}")
        if k:
            remove_folder(spark, f"{base}/{k - 1}")
    atexit.register(remove_folder, spark, base)
    return docs
