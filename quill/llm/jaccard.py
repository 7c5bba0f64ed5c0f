"""Near copies by the Jaccard similarity of texts' sets of shingles: candidates by MinHash, each verified exactly.

A set's minima under BANDS x ROWS hash functions are cut into BANDS keys; sets that share a key
are candidates (a pair of similarity 0.8 shares none in 3 cases of a million). Equal sets of one
fingerprint are one; sets of one class are not paired.

A key's sets never become pairs in a DataFrame. They meet in a task, as a cell of at most about
CELL sets and CELL_BYTES bytes, which takes them one by one: those of its own class by now are
passed over, then those of another size, those that share an earlier key (that key's cell has
them), those whose minima agree in too few places (a pair of similarity 0.8 is lost in 2 cases of
a million), and the rest is compared exactly. A pair that passes joins two classes.

A hot key is cut into chunks. First each chunk is a cell, with the key's first set in all of them,
so that one family becomes one class in a single pass, however large it is. Only then, and
only if the key has several classes still, do chunks meet: those of one class alone never
among themselves. What this costs grows with the pairs that are of different classes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quill.llm.runtime import cells_of, checkpoint, map_arrow, row_hash, side, texts_of, tune, written

BANDS, ROWS = 32, 5
#: Sets and bytes of sets in a chunk of a key, at most (on average over a hot key's chunks).
CELL, CELL_BYTES = 512, 8 << 20
#: How far below the wanted similarity the share of equal minima may be.
SLACK = 0.15

_random = np.random.default_rng(7)
_FACTORS = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of a set of 64-bit hashes under each hash function; the set is not empty."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 1 << 10):
        least = np.minimum(least, (hashes[at : at + (1 << 10), None] * _FACTORS + _TERMS).min(axis=0))
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """The BANDS keys of a set's minima."""
    digest = xxhash.xxh64_intdigest
    return np.array([digest(least[i : i + ROWS].tobytes(), i) for i in range(0, BANDS * ROWS, ROWS)], dtype=np.uint64).view(np.int64)


def set_hash(hashes: np.ndarray, fp: int) -> int:
    """A hash, as a signed long, of a sorted set and its text's fingerprint."""
    return xxhash.xxh64_intdigest(hashes.tobytes(), fp) - (1 << 63)


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets of 64-bit hashes."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if both else 0.0


def cell_links(key: int, own: np.ndarray, sets: list[np.ndarray], keys: np.ndarray, marks: np.ndarray, least: float, apart: int | None = None) -> list[tuple[int, int]]:
    """Links between classes (own) that join all sets of a cell that are least similar; with apart, only sets before and from it meet.

    keys: the sets' band keys, of which the cell's key is one; marks: a byte of each minimum.
    """
    root = np.unique(own, return_inverse=True)[1]
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    codes = np.split(codes, ends[:-1])
    present = np.zeros(max(int(c.max()) for c in codes) + 1, dtype=np.int64)
    band = int(np.argmax(keys[0] == key))
    need = (least - SLACK) * marks.shape[1]
    out = []
    for i in range(len(sets) if apart is None else apart):
        start = i + 1 if apart is None else apart
        j = start + np.flatnonzero(root[start:] != root[i])
        j = j[np.minimum(sizes[j], sizes[i]) >= least * np.maximum(sizes[j], sizes[i])]
        if len(j):
            j = j[(marks[j] == marks[i]).sum(axis=1) >= need]
            j = j[(keys[j] == keys[i]).argmax(axis=1) == band]
        if not len(j):
            continue
        present[codes[i]] = 1
        both = np.add.reduceat(present[np.concatenate([codes[x] for x in j.tolist()])], np.cumsum(sizes[j]) - sizes[j])
        present[codes[i]] = 0
        for x in j[both >= least * (sizes[i] + sizes[j] - both)].tolist():
            if root[x] != root[i]:
                out.append((int(own[i]), int(own[x])))
                root[root == root[x]] = root[i]
    return out


def _solve(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over rows sorted by cell (k, a, b) and side: the links of each cell."""

    def run(batches):
        for table, bounds in cells_of(batches, ("k", "a", "b")):
            k, a, b, side_, own = (table.column(c).to_numpy() for c in ("k", "a", "b", "side", "own"))
            sets, keys, marks = (table.column(c) for c in ("set", "keys", "marks"))
            u, v = [], []
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                apart = int(np.searchsorted(side_[s:e], 1)) if a[s] != b[s] else None
                if e - s < 2 or (own[s:e] == own[s]).all() or apart in (0, e - s):
                    continue
                own_keys = np.array(keys.slice(s, e - s).to_pylist(), dtype=np.int64)
                own_marks = np.frombuffer(b"".join(marks.slice(s, e - s).to_pylist()), dtype=np.uint8).reshape(e - s, -1)
                found = cell_links(int(k[s]), own[s:e], [np.frombuffer(x, dtype=np.uint64) for x in sets.slice(s, e - s).to_pylist()], own_keys, own_marks, least, apart)
                u += [min(x) for x in found]
                v += [max(x) for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def _links(cells: DataFrame, held: DataFrame, least: float) -> DataFrame:
    """Links u < v between classes from the rows (k, m, own, a, b, side) of cells."""
    tune(cells.sparkSession)
    # The sets join last, by a key that no set has more than BANDS times a cell, and travel once a cell.
    dealt = cells.join(held, "m").select("k", "a", "b", "side", "m", "own", "keys", "marks", "set").repartition("k", "a", "b").sortWithinPartitions("k", "a", "b", "side", "m")
    return dealt.mapInArrow(_solve(least), "u long, v long").distinct()


def _chunks(rows: Column, words: Column, cell: int, cell_bytes: int) -> Column:
    return F.ceil(F.greatest(rows / cell, words * 8 / cell_bytes)).cast("long")


def _first_cells(rows: DataFrame, cell: int, cell_bytes: int) -> DataFrame:
    """rows (k, m, n, own, …) of keys that several classes have, by chunks; a hot key's first set is in each of its chunks. Adds chunks."""
    per = rows.groupBy("k").agg(F.min("own").alias("lo"), F.max("own").alias("hi"), F.min("m").alias("hub"), F.count(F.lit(1)).alias("rows"), F.sum("n").alias("words"))
    per = per.where("lo < hi").select("k", "hub", _chunks(F.col("rows"), F.col("words"), cell, cell_bytes).alias("chunks"))
    met = rows.join(side(per), "k")
    own = F.pmod(F.xxhash64("m"), F.col("chunks"))
    every = F.when((F.col("chunks") > 1) & (F.col("m") == F.col("hub")), F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).otherwise(F.array(own))
    return met.select(*rows.columns, "chunks", F.explode(every).alias("a")).withColumns({"b": F.col("a"), "side": F.lit(0)})


def _crossed_cells(rows: DataFrame, cell: int, cell_bytes: int) -> DataFrame:
    """rows (k, m, n, own) by pairs of chunks; a class with more than a chunk under a key has chunks of its own, which don't meet."""
    by_class = checkpoint(rows.groupBy("k", "own").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("words")).withColumn("own_chunks", _chunks(F.col("rows"), F.col("words"), cell, cell_bytes)))
    large = F.col("own_chunks") > 1
    # A key's directory: a chunk has hundreds of rows or megabytes, so it is that much shorter than the key's rows.
    per = by_class.groupBy("k").agg(
        F.count(F.lit(1)).alias("classes"), F.collect_list(F.when(large, F.struct("own", "own_chunks"))).alias("large"),
        F.greatest(F.lit(1).cast("long"), _chunks(F.coalesce(F.sum(F.when(~large, F.col("rows"))), F.lit(0)), F.coalesce(F.sum(F.when(~large, F.col("words"))), F.lit(0)), cell, cell_bytes)).alias("mixed"),
    )
    per = per.where("classes > 1").drop("classes")
    rows = rows.join(side(per), "k").join(side(by_class.where(large).select("k", "own", "own_chunks")), ["k", "own"], "left")
    pure = F.col("own_chunks").isNotNull()
    name = lambda kind, own, c: F.xxhash64(F.lit(kind), own, c)
    numbers = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    zero = F.lit(0).cast("long")
    mine = F.when(pure, name("pure", F.col("own"), F.pmod(F.xxhash64("m"), F.col("own_chunks")))).otherwise(name("mixed", zero, F.pmod(F.xxhash64("m"), F.col("mixed"))))
    others = F.flatten(F.transform(F.filter("large", lambda x: x["own"] != F.col("own")), lambda x: F.transform(numbers(x["own_chunks"]), lambda c: name("pure", x["own"], c))))
    met = F.concat(F.transform(numbers(F.col("mixed")), lambda c: name("mixed", zero, c)), others)
    out = rows.select("k", "m", "n", "own", mine.alias("mine"), met.alias("met")).select("k", "m", "n", "own", "mine", F.explode("met").alias("other"))
    return out.select("k", "m", "own", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), (F.col("mine") > F.col("other")).cast("int").alias("side"))


def merged_classes(docs: DataFrame, prints: DataFrame, named: DataFrame, least: float, set_of, classes, text_col: str, cell: int = CELL, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """named (fp, class) with classes merged wherever two texts' sets are at least that similar.

    prints has, for each row of docs, its row_hash as row, fp, and of its set the hash m, the size n and the keys;
    set_of(text) gives (fp, set), classes(links) the class of every node of links.
    """
    nodes = checkpoint(prints.where("n > 0").select("m", "fp", "n", "row", "keys").dropDuplicates(["m"]))
    rows = nodes.join(side(named), "fp").select("m", "n", "row", F.col("class").alias("own"), F.explode("keys").alias("k"))
    first = checkpoint(_first_cells(rows, cell, cell_bytes))
    wanted = first.select("row", "m").distinct()

    def sets(batch):
        out = {"m": [], "set": [], "keys": [], "marks": []}
        for t, m in zip(texts_of(batch), batch.column("m").to_pylist(), strict=True):
            fp, own = set_of(t)
            if set_hash(own, fp) == m:
                least = minima(own)
                out["m"].append(m)
                out["set"].append(own.tobytes())
                out["keys"].append(band_keys(least))
                out["marks"].append(least.astype(np.uint8).tobytes())
        yield out

    texts = docs.select(row_hash(docs).alias("row"), F.col(text_col).alias("text")).join(side(wanted), "row").select("m", "text")
    held = checkpoint(map_arrow(texts, sets, "m long, set binary, keys array<long>, marks binary").dropDuplicates(["m"]))
    relabel = lambda known, column, labels: known.join(labels, F.col(column) == F.col("node"), "left").withColumn(column, F.coalesce("least", column)).drop("node", "least")
    labels = side(classes(_links(first.select("k", "m", "own", "a", "b", "side"), held, least)), written)
    named = relabel(named, "class", labels)
    hot = first.where("chunks > 1").select("k", "m", "n", "own").distinct()
    if hot.isEmpty():
        return named
    crossed = _crossed_cells(checkpoint(relabel(hot, "own", labels)), cell, cell_bytes)
    return relabel(named, "class", side(classes(_links(crossed, held, least)), written))
