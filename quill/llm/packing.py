"""Packing token sequences: first-fit decreasing over a tournament tree of bin capacities.

Documents become pieces of at most `capacity` tokens: whole sequences first, then a rest.
Pieces are written, counted, dealt out evenly to partitions (round robin, whatever their keys
are), ordered there at random by a hash, and taken in groups of `group` pieces; each group packs itself. A full piece fills a
sequence alone; the rests of a group go, longest first, each into the first bin that still
has room. A tournament tree over the bins' free room finds that bin in log(bins) steps.
Groups have a fixed size, so memory is bounded however many pieces there are, and the loss
is one group's: a share that falls with the root of the group's size.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quill.llm.bpe import merger
from quill.llm.runtime import checkpoint, columns_of, map_arrow, pieces, tune

#: Pieces that are packed together.
GROUP = 8192


class Tournament:
    """Bins of one capacity; finds the first that has room for a piece."""

    def __init__(self, capacity: int, leaves: int):
        self.size = 1 << max(0, (leaves - 1).bit_length())
        self.free = [capacity] * (2 * self.size)

    def place(self, length: int) -> tuple[int, int]:
        """The first bin with room for length, and the room it had."""
        node, free = 1, self.free
        while node < self.size:
            node *= 2
            if free[node] < length:
                node += 1
        room = free[node]
        free[node] = room - length
        bin_ = node - self.size
        node >>= 1
        while node:
            a, b = free[2 * node], free[2 * node + 1]
            best = a if a >= b else b
            if free[node] == best:
                break
            free[node] = best
            node >>= 1
        return bin_, room


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length; ties in length go by position."""
    order = np.argsort(-lengths, kind="stable")
    bins = np.empty(len(lengths), dtype=np.int64)
    offsets = np.empty(len(lengths), dtype=np.int64)
    full = int((lengths == capacity).sum())  # these come first, a bin each
    bins[order[:full]], offsets[order[:full]] = np.arange(full), 0
    rest = order[full:]
    if len(rest):
        tree = Tournament(capacity, len(rest))
        for i, length in zip(rest.tolist(), lengths[rest].tolist(), strict=True):
            bin_, room = tree.place(length)
            bins[i], offsets[i] = full + bin_, capacity - room
    return bins, offsets


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of each document: id, start, length, ids_crc32, doc_tokens.

    Null text has its end token 0 alone. Null ids and ids that repeat are kept as they are, each
    row cut by itself. A text of any length is encoded whole. Other columns are not carried.
    """

    def cut(batch):
        texts = batch.column("text").to_pylist()
        ids = batch.column("id")
        merge = merger(tokenizer)
        for a, b in pieces([t or "" for t in texts], 4 << 20):
            row, start, length, crc, total = [], [], [], [], []
            for i, raw in enumerate(merge.encode(texts[a:b]), a):
                raw += b"\0\0\0\0"
                n = len(raw) // 4
                for s in range(0, n, capacity):
                    row.append(i)
                    start.append(s)
                    length.append(min(capacity, n - s))
                    crc.append(zlib.crc32(raw[4 * s : 4 * (s + capacity)]))
                    total.append(n)
            yield {"id": ids.take(pa.array(row, pa.int64())), "start": start, "length": length, "ids_crc32": crc, "doc_tokens": total}

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = map_arrow(rows, cut, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long")
    return out.withColumnRenamed("id", id_col)


def pack(items: DataFrame, n_rows: int, capacity: int = 1024, group: int = GROUP, seed: int = 17, length_col: str = "length") -> DataFrame:
    """Adds sequence_id and offset to rows that have a length of 1 to capacity.

    n_rows (an estimate will do) fixes how many partitions there are: about group rows each,
    at least. Rows that repeat are packed each; any other column is carried as it is, but
    columns that are called sequence_id or offset are replaced. Sequence ids are unique over
    all groups; offsets within a sequence are gapless from 0.
    """
    tune(items.sparkSession)
    names = [c for c in items.columns if c.lower() not in ("sequence_id", "offset")]
    own = [c for c, name in zip(columns_of(items), items.columns, strict=True) if name in names]
    items = items.select(*[c.alias("n" if name == length_col else f"c{i}") for i, (c, name) in enumerate(zip(own, names, strict=True))])
    order = [F.xxhash64(F.lit(seed), *items.columns), *items.columns]
    # Round robin deals evenly whatever keys repeat; Spark sorts the rows before it, so a rerun deals alike.
    dealt = items.repartition(max(1, -(-n_rows // group))).sortWithinPartitions(*order)
    schema = dealt.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).schema

    def run(batches):
        from pyspark import TaskContext

        part, groups, held, count = TaskContext.get().partitionId(), 0, [], 0

        def packed(table):
            lengths = table.column("n").to_numpy()
            bins, offsets = first_fit_decreasing(lengths, capacity)
            base = (part << 40) + (groups << 20)
            out = table.append_column("sequence_id", pa.array(bins + base)).append_column("offset", pa.array(offsets))
            return out.combine_chunks().to_batches()

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            while count >= group:
                table = pa.Table.from_batches(held)
                if count < 2 * group:  # the last rows may join: no small group at the end
                    break
                yield from packed(table.slice(0, group))
                groups += 1
                held = table.slice(group).to_batches()
                count -= group
        if count:
            yield from packed(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, schema).toDF(*names, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents as pieces (see token_pieces) in sequences of at most capacity tokens. An empty table gives no rows."""
    cut = checkpoint(token_pieces(docs, tokenizer, capacity, id_col, text_col))
    return pack(cut, cut.count(), capacity)
