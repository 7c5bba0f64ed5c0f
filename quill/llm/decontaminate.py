"""Benchmark decontamination by winnowing.

Of every SPAN - GRAM + 1 consecutive hashes of GRAM words the least is kept as a
fingerprint, in documents and in benchmark items alike, so two texts that share SPAN words
in a row share a fingerprint inside them. Documents' fingerprints are joined with the
items'; around each hit the windows of SPAN words that hold it are extended to and compared
byte for byte. Items of fewer words than SPAN are one window of their own length, which
winnowing can't promise to find; those lengths (at most SPAN - 1 of them) are looked up at
every word.

The benchmark is a stated query set: it is taken in blocks of at most BLOCK_BYTES of text,
each broadcast by itself, one after the other, and documents pass by in a map without any
shuffle (beyond one block, the rows with hits join the others by their key). So a hot source or
passage burdens no single task, and the driver holds one block at a time.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quill.llm.runtime import checkpoint, map_arrow, pieces, side, texts_of
from quill.llm.words import Words, run_hashes

SPAN, GRAM = 10, 5
#: Text of the benchmark in one broadcast, at most (or one longer item); its index is about five times that.
BLOCK_BYTES = 16 << 20


def fingerprints(words: Words, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the k-grams that winnowing keeps."""
    hashes = run_hashes(words.hashes, gram)
    width = span - gram + 1
    inside = np.flatnonzero(words.same_text(span))
    if not len(inside):
        return inside, np.zeros(0, dtype=np.uint64)
    least = np.lib.stride_tricks.sliding_window_view(hashes, width).argmin(axis=1)
    kept = np.zeros(len(hashes), dtype=bool)
    kept[inside + least[inside]] = True
    at = np.flatnonzero(kept)
    return at, hashes[at]


class Index:
    """Fingerprints and windows of one block of the benchmark.

    A window is a row of four arrays sorted by its hash (about 24 bytes), and its bytes are a
    slice of the items' words, joined by spaces; items are taken in pieces, so that what
    hashing needs for the moment stays small too.
    """

    #: Windows whose items a worker remembers, at most.
    KEPT = 1 << 14

    def __init__(self, items: list[tuple[str, str]], span: int = SPAN, gram: int = GRAM):
        self.span, self.gram = span, gram
        self.items: list[str] = [i for i, _ in items]
        texts = [t.encode() for _, t in items]
        prints: list[np.ndarray] = []
        joined: list[bytes] = []
        rows: dict[int, list[tuple[np.ndarray, ...]]] = {}
        base = 0
        for first, last in pieces(texts):
            words = Words(texts[first:last])
            prints.append(np.unique(fingerprints(words, span, gram)[1]))
            joined.append(words.joined(0, len(words)) + b" ")
            stop = base + np.cumsum(words.ends - words.starts + 1) - 1
            begin = stop - (words.ends - words.starts)
            base += len(joined[-1])
            # Items of span words or more have windows of span words; the others are one window each.
            sizes = np.minimum(words.counts, span)
            of_word = sizes[words.text]
            for size in np.unique(sizes[sizes > 0]).tolist():
                at = np.flatnonzero(words.same_text(size) & (of_word[: len(words) - size + 1] == size))
                rows.setdefault(size, []).append((run_hashes(words.hashes, size, at), begin[at], (stop[at + size - 1] - begin[at]).astype(np.int32), (words.text[at] + first).astype(np.int32)))
        self.joined = b"".join(joined)
        self.fingerprints = np.unique(np.concatenate(prints)) if prints else np.zeros(0, dtype=np.uint64)
        self.windows: dict[int, tuple[np.ndarray, ...]] = {}
        for size, parts in rows.items():
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
            order = np.argsort(columns[0], kind="stable")
            self.windows[size] = tuple(c[order] for c in columns)
        self.known: dict[bytes, tuple[int, ...]] = {}

    def items_of(self, size: int, hash_: np.uint64, text: bytes) -> tuple[int, ...]:
        """Numbers of the items that have this window, compared byte for byte."""
        if (found := self.known.get(text)) is None:
            hashes, begin, length, item = self.windows[size]
            a, b = np.searchsorted(hashes, hash_, "left"), np.searchsorted(hashes, hash_, "right")
            same = {k for x, n, k in zip(begin[a:b].tolist(), length[a:b].tolist(), item[a:b].tolist(), strict=True) if self.joined[x : x + n] == text}
            found = tuple(sorted(same))
            if len(self.known) >= self.KEPT:
                self.known.clear()
            self.known[text] = found
        return found

    def hits(self, words: Words) -> tuple[np.ndarray, list[tuple[int, tuple[int, ...]]]]:
        """Which words lie in an occurrence of a window, and (text, items) of the windows found."""
        hit = np.zeros(len(words) + 1, dtype=np.int64)
        found: list[tuple[int, tuple[int, ...]]] = []
        for n, (table, *_) in self.windows.items():
            if n == self.span:
                at, prints = fingerprints(words, self.span, self.gram)
                at = at[_among(prints, self.fingerprints)]
                back = self.span - self.gram
                starts = np.unique((at[:, None] - np.arange(back + 1)).ravel())
                starts = starts[(starts >= 0) & (starts + n <= len(words))]
                starts = starts[words.text[starts] == words.text[starts + n - 1]]
            else:
                starts = np.flatnonzero(words.same_text(n))
            hashes = run_hashes(words.hashes, n, starts)
            among = _among(hashes, table)
            for s, v in zip(starts[among].tolist(), hashes[among], strict=True):
                items = self.items_of(n, v, words.joined(s, n))
                if items:
                    hit[s] += 1
                    hit[s + n] -= 1
                    found.append((int(words.text[s]), items))
        return np.cumsum(hit[:-1]) > 0, found


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table) or not len(values):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


def row_key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """What tells rows of one id, or of none, apart."""
    return F.xxhash64(docs[id_col], docs[text_col])


def blocks(benchmark: DataFrame, most: int, item_col: str, text_col: str) -> list[DataFrame]:
    """The benchmark in blocks of about most bytes; one block if all of it is smaller. The split is by item and text."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("item is not null and text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-2 * size // most)) if size > most else 1
    return [items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else items for k in range(n)]


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """One row per row of docs: the id, key (see row_key), n_words, hits (positions of words inside an occurring window), items (ids of items with occurring windows, as sorted strings).

    Null text has no words. Items without words, id or text take no part; equal items count
    as one. Rows that repeat, and rows without an id or with one that others have, are each
    judged, in however many blocks the benchmark comes. Extra columns are not carried.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), row_key(docs, id_col, text_col).alias("key"))
    parts = blocks(benchmark, block_bytes, item_col, item_text_col)

    def found_in(part: DataFrame):
        index = spark.sparkContext.broadcast(Index(sorted((r.item, r.text) for r in part.collect()), span, gram))

        def judge(batch):
            texts = texts_of(batch)
            for a, b in pieces(texts):
                words = Words(texts[a:b])
                hit, found = index.value.hits(words)
                items: list[set[int]] = [set() for _ in range(a, b)]
                for k, more in found:
                    items[k].update(more)
                bounds = words.bounds.tolist()
                yield {
                    "id": batch.column("id").slice(a, b - a), "key": batch.column("key").slice(a, b - a), "n_words": words.counts,
                    "hits": [np.flatnonzero(hit[x:y]).astype(np.int32) for x, y in zip(bounds[:-1], bounds[1:], strict=True)],
                    "items": [sorted(index.value.items[i] for i in s) for s in items],
                }

        return map_arrow(rows, judge, f"id {kind}, key long, n_words long, hits array<int>, items array<string>"), index

    out, index = found_in(parts[0])
    if len(parts) > 1:
        # One block is broadcast at a time; of each only the rows with hits are kept, once each, and join all rows at the end.
        out = checkpoint(out)
        index.destroy()
        held = [out.where(F.size("items") > 0)]
        for part in parts[1:]:
            more, index = found_in(part)
            held.append(checkpoint(more.where(F.size("items") > 0)))
            index.destroy()
        union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))  # noqa: E731  at most one list for each block
        both = reduce(DataFrame.unionByName, (x.withColumn("block", F.lit(i)) for i, x in enumerate(held))).dropDuplicates(["block", "id", "key"])
        both = side(both.groupBy(F.col("id").alias("_id"), F.col("key").alias("_key")).agg(union("hits").alias("_hits"), union("items").alias("_items")))
        out = out.join(both, (F.col("key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_id")), "left")
        out = out.select("id", "key", "n_words", F.coalesce("_hits", "hits").alias("hits"), F.coalesce("_items", "items").alias("items"))
    return out.select(F.col("id").alias(id_col), "key", "n_words", "hits", F.array_distinct("items").alias("items"))


def without_hits(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, in which decontaminate() found nothing.

    Rows are told apart by id and text, so that rows which share an id, or have none, are
    each judged by their own text.
    """
    bad = side(found.where(F.size("hits") > 0).select(F.col(id_col).alias("_id"), F.col("key").alias("_key")).distinct())
    return docs.join(bad, (row_key(docs, id_col, text_col) == bad["_key"]) & docs[id_col].eqNullSafe(bad["_id"]), "left_anti")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns of decontaminate()'s rows."""
    items = F.array_sort("items")
    return found.select(
        id_col, "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )

