"""Stored postings in blocks with bounds, so that a top-k search reads few of them; batches are segments.

A block is about BLOCK chunks of one chunking that are about equally long, and a row holds what one lexeme
has in one block: the largest number of occurrences in any of its chunks, and the chunks with theirs. A
chunk's score grows with the occurrences of all of the query's lexemes, so the sum of a block's largest numbers bounds
it, and as long chunks meet in blocks of their own, few blocks have large bounds.

A search reads the bounds alone first. Each query's most promising blocks are scored, which gives a score that k
chunks reach; then the blocks whose bound reaches it. The others, most by far, are never opened. Rows lie by band of
length, so that bands without a block that is wanted are not read at all.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quill.operators.lexical import TIE, broadcast_if_small, postings, query_lexemes, score, top
from quill.sources import commits
from quill.sources.segments import SEGMENTS, Segmented
from quill.sources.shared import checkpoint

#: Chunks of a block, about; classes of length for each doubling, and classes of a band.
BLOCK, STEPS, BAND = 16, 8, 16
#: Blocks that are scored first for each query, besides those that k chunks need.
FIRST = 4
#: Bytes of postings that one task writes, about, and postings that it puts together at once, at least.
TASK_BYTES, AT_ONCE = 32 << 20, 1 << 16
IDS = "chunk_id long"
BLOCKS = "chunking string, lexeme string, block long, most long, entries array<struct<chunk_id:long,tf:long>>, band int"


def length_class(text: Column) -> Column:
    return F.floor(F.log2(F.octet_length(text) + F.lit(1)) * STEPS).cast("int")


@dataclass(frozen=True)
class PostingsIndex(Segmented):
    """A version of stored postings. stemmed: whether its lexemes are stems."""

    @property
    def stemmed(self) -> bool:
        return self.state.properties.get("stemmed", "true") == "true"

    @property
    def segments(self) -> list[int]:
        return self.segments_of("blocks")

    @cached_property
    def blocks(self) -> DataFrame:
        """Every row, with the version since which it counts."""
        return self.rows_since("blocks", BLOCKS)

    @cached_property
    def postings(self) -> DataFrame:
        """(chunking, lexeme, chunk_id, tf, class) of the live chunks."""
        rows = self.blocks.select("chunking", "lexeme", _class_of("block").alias("class"), "since", F.explode("entries").alias("e"))
        return self.live(rows.select("e.chunk_id", "since", "chunking", "lexeme", "e.tf", "class"))

    @cached_property
    def ids(self) -> DataFrame:
        """(chunk_id) of the live chunks, of those without lexemes too."""
        return self.live(self.rows_since("ids", IDS))

    def search(self, queries: DataFrame, k: int, chunking: str | None = None) -> DataFrame:
        """(query_id, chunk_id, score, rank): the k best chunks of each query; as lexical.search() over the same chunks."""
        return self.searched(queries, k, chunking)[0]

    def searched(self, queries: DataFrame, k: int, chunking: str | None = None) -> tuple[DataFrame, DataFrame]:
        """search(), and its work: (query_id, blocks, blocks_read, postings, postings_read) of each query that matches anything."""
        rows = self.blocks if chunking is None else self.blocks.where(F.col("chunking") == chunking)
        wanted = broadcast_if_small(checkpoint(query_lexemes(queries, self.stemmed)))
        own = rows.join(wanted, "lexeme").groupBy("query_id", "block", "band")
        bounds = checkpoint(own.agg(F.sum("most").alias("bound"), F.sum(F.size("entries")).alias("size"), F.max(F.size("entries")).alias("chunks")))
        # Of the k best blocks, each of which holds a chunk at least, those that it takes to hold k.
        order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
        best = bounds.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max(FIRST, k))
        before = F.coalesce(F.sum("chunks").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        chosen = checkpoint(best.withColumn("before", before).where((F.col("place") <= FIRST) | (F.col("before") < k)).select("query_id", "block", "band", "size"))
        first = checkpoint(self._counted(rows, wanted, chosen))
        reached = top(first.select("query_id", "chunk_id", score(F.col("n")).alias("score")), k, TIE).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        rest = bounds.join(broadcast_if_small(chosen.select("query_id", "block")), ["query_id", "block"], "left_anti").join(broadcast_if_small(checkpoint(reached)), "query_id", "left")
        rest = checkpoint(rest.where(F.col("floor").isNull() | (F.round(score(F.col("bound")), TIE) >= F.col("floor"))).select("query_id", "block", "band", "size"))
        found = first.unionByName(self._counted(rows, wanted, rest))
        read = chosen.select("query_id", "size").unionByName(rest.select("query_id", "size"))
        done = read.groupBy("query_id").agg(F.count(F.lit(1)).alias("blocks_read"), F.sum("size").alias("postings_read"))
        work = bounds.groupBy("query_id").agg(F.count(F.lit(1)).alias("blocks"), F.sum("size").alias("postings")).join(done, "query_id")
        return top(found.select("query_id", "chunk_id", score(F.col("n")).alias("score")), k), work.select("query_id", "blocks", "blocks_read", "postings", "postings_read")

    def _counted(self, rows: DataFrame, wanted: DataFrame, pairs: DataFrame) -> DataFrame:
        """(query_id, chunk_id, n) of the chunks of pairs (query_id, block, band); no other band is read."""
        bands = [r[0] for r in pairs.select("band").distinct().collect()]  # some dozens
        opened = rows.where(F.col("band").isin(bands)).join(wanted, "lexeme").join(broadcast_if_small(pairs.select("query_id", "block")), ["query_id", "block"])
        entries = opened.select("query_id", "since", F.explode("entries").alias("e")).select("e.chunk_id", "since", "query_id", "e.tf")
        return self.live(entries).groupBy("query_id", "chunk_id").agg(F.sum("tf").alias("n"))

    # Maintenance. Each gives the index as it is afterwards.

    def append(self, chunks: DataFrame, key: str = "chunk_config_sha256", replace: bool = False) -> PostingsIndex:
        """Add a batch of chunks (chunk_id, content, key). replace: chunks of the same ids before them die."""
        staged = _stage(self.log, _posted(chunks, key, self.stemmed), chunks)
        if replace:
            staged = self.stage_dead(chunks, staged)
        return PostingsIndex(self.log, self.log.commit(self.state, staged, rebase=True))

    def delete(self, ids: DataFrame) -> PostingsIndex:
        """Take chunk_ids out."""
        return PostingsIndex(self.log, self.log.commit(self.state, self.stage_dead(ids), rebase=True))

    def merge(self, all_segments: bool = False) -> PostingsIndex:
        """Write the live postings of segments anew as one, in whole blocks (see Segmented.to_merge)."""
        chosen, whole = self.to_merge("blocks", all_segments)
        old = self.files_of(chosen, "blocks", "ids")
        own = PostingsIndex(self.log, self.only(old))
        return PostingsIndex(self.log, self.commit_merge(_stage(self.log, own.postings, own.ids), old, whole))

    def updated(self, chunks: DataFrame, key: str = "chunk_config_sha256") -> PostingsIndex:
        """The index of just these chunks: new ones are added as a segment, those that are no longer there die, then maintained(). Chunks never change under their id."""
        index = self
        new = checkpoint(chunks.select("chunk_id", "content", key).join(self.ids, "chunk_id", "left_anti"))
        gone = checkpoint(self.ids.join(chunks.select("chunk_id"), "chunk_id", "left_anti"))
        if not gone.isEmpty():
            index = index.delete(gone)
        if not new.isEmpty():
            index = index.append(new, key)
        return index.maintained()

    def maintained(self) -> PostingsIndex:
        """The index, merged if it has more than SEGMENTS segments."""
        return self.merge() if len(self.segments) > SEGMENTS else self


def _class_of(block: str) -> Column:
    return F.shiftright(block, 24).bitwiseAND(F.lit(0xFF)).cast("int")


def _posted(chunks: DataFrame, key: str, stemmed: bool) -> DataFrame:
    """(chunking, lexeme, chunk_id, tf, class) of chunks."""
    rows = chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), "content", F.col(key).alias("chunking"), F.coalesce(length_class(F.col("content")), F.lit(0)).alias("class"))
    return postings(rows, stemmed, keep=("chunking", "class")).select("chunking", "lexeme", "chunk_id", "tf", "class")


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block and lexeme of postings (band, chunking, lexeme, block, chunk_id, tf) in order; none is cut by a batch's end."""
    held: list[pa.RecordBatch] = []

    def starts(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, dtype=bool)
        new[:1] = True
        for c in ("band", "chunking", "lexeme", "block"):
            code = table.column(c).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
            new[1:] |= code[1:] != code[:-1]
        return np.flatnonzero(new)

    def made(table: pa.Table, start: np.ndarray) -> pa.RecordBatch:
        ids, tf = (table.column(c).combine_chunks() for c in ("chunk_id", "tf"))
        entries = pa.ListArray.from_arrays(pa.array(np.append(start, table.num_rows).astype(np.int32)), pa.StructArray.from_arrays([ids, tf], names=["chunk_id", "tf"]))
        first = {c: table.column(c).combine_chunks().take(pa.array(start)) for c in ("chunking", "lexeme", "block", "band")}
        columns = first | {"most": pa.array(np.maximum.reduceat(tf.to_numpy(), start)), "entries": entries}
        names = ["chunking", "lexeme", "block", "most", "entries", "band"]
        return pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= AT_ONCE:
            table = pa.Table.from_batches(held).combine_chunks()
            start = starts(table)
            if len(start) > 1:
                yield made(table.slice(0, start[-1]), start[:-1])
            held = table.slice(start[-1]).to_batches()
    if sum(b.num_rows for b in held):
        table = pa.Table.from_batches(held).combine_chunks()
        yield made(table, starts(table))


def _stage(log: commits.Log, rows: DataFrame, ids: DataFrame) -> str:
    """Deal chunks to blocks, and write a row for each block and lexeme, and all chunks' ids."""
    rows = checkpoint(rows)
    counts = rows.groupBy("chunking", "class").agg(F.countDistinct("chunk_id").alias("n"), F.sum(F.octet_length("lexeme") + 16).alias("bytes"))
    counts = checkpoint(counts.withColumn("slots", F.ceil(F.col("n") / BLOCK)))  # some hundreds for each chunking
    tasks = 1 + (counts.agg(F.sum("bytes")).first()[0] or 0) // TASK_BYTES
    segment = uuid.uuid4().int >> 98  # 30 bits: blocks of unlike segments rarely share a number, and bounds hold even then
    dealt = rows.join(broadcast_if_small(counts.select("chunking", "class", "slots")), [rows["chunking"].eqNullSafe(counts["chunking"]), rows["class"] == counts["class"]]).drop(counts["chunking"]).drop(counts["class"])
    slot = F.pmod(F.xxhash64("chunk_id"), F.col("slots"))
    block = F.lit(segment << 33).bitwiseOR(F.col("class").cast("long") * (1 << 24)).bitwiseOR(F.pmod(slot, F.lit(1 << 24)))
    dealt = dealt.withColumns({"block": block, "band": F.floor(F.col("class") / BAND).cast("int"), "part": F.pmod(F.xxhash64("lexeme", slot), F.lit(tasks))})
    order = ["band", "chunking", "lexeme", "block"]
    tasks = max(tasks, log.spark.sparkContext.defaultParallelism)
    own = dealt.repartition(tasks, "chunking", "band", "part").select(*order, "chunk_id", "tf").sortWithinPartitions(*order, "chunk_id", "tf")
    out = own.mapInArrow(_together, BLOCKS).sortWithinPartitions(*order)  # in order already; the writer asks for it
    staged = log.stage(out, "blocks", ["band"])
    return log.stage(ids.select(F.col("chunk_id").cast("long").alias("chunk_id")), "ids", staged=staged)


def write_index(chunks: DataFrame, path: str, stemmed: bool = True, key: str = "chunk_config_sha256") -> None:
    """Store the postings of chunks (chunk_id, content, key), in the place of an index that is there."""
    log = commits.Log(chunks.sparkSession, path)
    state = log.adopt()
    log.commit(state, _stage(log, _posted(chunks, key, stemmed), chunks), list(state.files), {"stemmed": str(stemmed).lower()})


def read_index(spark: SparkSession, path: str, version: int | None = None) -> PostingsIndex:
    log = commits.Log(spark, path)
    log.settle()
    return PostingsIndex(log, log.state(version))
