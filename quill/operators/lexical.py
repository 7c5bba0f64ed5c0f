"""Lexical retrieval: postings, matching, and occurrence-count ranking of OR queries.

The score of a chunk is n / (n + 10), n being how often the query's lexemes occur in it:
what cover density ranking comes to for a pure OR query. It is no BM25: neither rarity nor
length counts. Lexemes are stems on both sides, unless both sides say otherwise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quill.functions.stem import stem
from quill.functions.text import lexeme_set, lexemes
from quill.sources.shared import BROADCAST_BYTES, checkpoint, row_bytes, tune

#: Parts of a stored index that a lexeme's hash picks.
BUCKETS = 64
#: Bytes of texts whose postings one task sorts and writes, about: some ten times as many in memory.
TASK_BYTES = 16 << 20
#: Postings times queries of one task of a search in a stored index, at most; chunks hold some hundreds of postings.
PAIRS, MOST_TASKS = 400_000_000, 10_000
#: Decimal places to which scores are compared: sums of floats that should be equal are ties.
TIE = 12


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """The side with a broadcast hint if its bytes sum to BROADCAST_BYTES at most."""
    return F.broadcast(df) if (df.agg(F.sum(row_bytes(df))).first()[0] or 0) <= BROADCAST_BYTES else df


def query_lexemes(queries: DataFrame, stemmed: bool = True, id_col: str = "query_id", text_col: str = "query") -> DataFrame:
    """(query_id, lexeme): the distinct lexemes of each query. Queries without lexemes give no row, and so match nothing."""
    return queries.select(F.col(id_col).alias("query_id"), F.explode(lexeme_set(F.col(text_col), stemmed)).alias("lexeme"))


def postings(chunks: DataFrame, stemmed: bool = True, id_col: str = "chunk_id", text_col: str = "content", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep…, lexeme, chunk_id, tf): the inverted index. A chunk is a row, so it is counted where it is read, without a shuffle."""
    tune(chunks.sparkSession)
    words = chunks.select(*keep, F.col(id_col).alias("chunk_id"), lexemes(F.col(text_col), stemmed=False).alias("words"))
    kinds = dict(words.dtypes)

    def run(batches):
        for batch in batches:
            own = batch.column("words")
            flat = own.flatten().dictionary_encode()
            names = flat.dictionary.to_pylist()
            stems = pa.array([stem(w) for w in names] if stemmed else names, pa.string()).dictionary_encode()
            code = stems.indices.to_numpy()[flat.indices.to_numpy()].astype(np.int64) if len(flat) else np.zeros(0, np.int64)
            row = np.repeat(np.arange(len(own), dtype=np.int64), np.diff(own.offsets.to_numpy()))
            key, tf = np.unique(row << 32 | code, return_counts=True)
            at = pa.array(key >> 32)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(at) for c in keep), stems.dictionary.take(pa.array(key & 0xFFFFFFFF)), batch.column("chunk_id").take(at), pa.array(tf.astype(np.int64))], names=[*keep, "lexeme", "chunk_id", "tf"]
            )

    return words.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in keep) + (", " if keep else "") + f"lexeme string, chunk_id {kinds['chunk_id']}, tf long")


def bucket(lexeme: str = "lexeme"):
    return F.pmod(F.xxhash64(lexeme), F.lit(BUCKETS)).cast("int")


def write_index(chunks: DataFrame, path: str, stemmed: bool = True, key: str = "chunk_config_sha256", task_bytes: int = TASK_BYTES) -> None:
    """Store the postings of chunks, by chunking and bucket, ordered by lexeme: a query reads its lexemes' buckets, and in them the row groups that have them.

    There is a task for each task_bytes of the chunks' texts. A bucket is dealt over some of them by chunk, so that a lexeme of
    every chunk fills no single one, and whatever the table's size a task sorts about as much.
    """
    tasks = max(chunks.sparkSession.sparkContext.defaultParallelism, 1 + (chunks.agg(F.sum(F.octet_length("content"))).first()[0] or 0) // task_bytes)
    rows = postings(chunks, stemmed, keep=(key,)).withColumn("bucket", bucket())
    dealt = rows.repartition(tasks, F.col(key), F.col("bucket"), F.pmod(F.xxhash64("chunk_id"), F.lit(1 + tasks // 32)))
    dealt.sortWithinPartitions(key, "bucket", "lexeme", "chunk_id").write.mode("overwrite").partitionBy(key, "bucket").parquet(path)


def score(n):
    return n / (n + F.lit(10.0))


def matches(queries: DataFrame, chunks: DataFrame, stemmed: bool = True) -> DataFrame:
    """(query_id, chunk_id, n): chunks that hold a lexeme of a query, and how many occurrences."""
    return matches_by_postings(queries, postings(chunks, stemmed), stemmed)


def matches_by_postings(queries: DataFrame, index: DataFrame, stemmed: bool = True) -> DataFrame:
    """The same from postings; of a stored index only the wanted buckets are read, and its postings meet by chunk before queries multiply them."""
    wanted = query_lexemes(queries, stemmed)
    if "bucket" in index.columns:
        wanted = checkpoint(wanted.withColumn("bucket", bucket()))
        asked = wanted.agg(F.countDistinct("query_id")).first()[0]
        tasks = min(MOST_TASKS, 1 + index.count() * asked // PAIRS)  # the rows are counted in files' footers
        kinds = broadcast_if_small(wanted.select("bucket", "lexeme").distinct())
        index = index.join(kinds, ["bucket", "lexeme"], "left_semi").select("lexeme", "chunk_id", "tf").repartition(max(tasks, index.sparkSession.sparkContext.defaultParallelism), "chunk_id")
        wanted = wanted.select("query_id", "lexeme")
    return index.join(broadcast_if_small(wanted), "lexeme").groupBy("query_id", "chunk_id").agg(F.sum("tf").alias("n"))


def top(scored: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """The k best chunks of each query by score, ties to the smaller chunk_id, with their rank from 1. Scores are ranked to TIE places and returned to digits."""
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", TIE)), "chunk_id")
    rows = scored.select("query_id", "chunk_id", "score").withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)
    return rows.select("query_id", "chunk_id", F.round("score", digits).alias("score"), "rank")


def search(queries: DataFrame, chunks: DataFrame, k: int, stemmed: bool = True, index: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank) of the lexical arm. chunks, or the index, are filtered to one chunking before."""
    found = matches(queries, chunks, stemmed) if index is None else matches_by_postings(queries, index, stemmed)
    return top(found.select("query_id", "chunk_id", score(F.col("n")).alias("score")), k)
