"""SimHash near-duplicates over pivot distance tables.

Fingerprints. Words, shingles of three, XXH64; a bit is set if it is set in over half of
the shingles' hashes.

Pairs. The pivots are the zero fingerprint, the 64 fingerprints of one bit, and sums of
these over blocks of bits. A fingerprint's distance to a one-bit pivot is one less or one
more than its distance to zero, as the bit is set or not; so these coordinates, taken
relative to zero's, are its bits, and a key can be read off them. Two fingerprints at most
RADIUS bits apart agree in all such coordinates of at least blocks - RADIUS blocks; each
choice of that many blocks is a table of keys, and an equi-join on keys loses no pair. Rows
that meet under a key are ordered by their distance to zero, pairs whose distances to any of
the block pivots differ by over RADIUS are discarded (the triangle inequality), and
survivors are verified by the exact distance.

A key's rows never become pairs in a DataFrame: a task joins them in memory with union-find
and gives back one link a row at most. Keys with more than CELL rows are cut into chunks of
about CELL rows, and each pair of chunks is a task's work of its own, so no task gathers an
unbounded group.

Classes. Links are contracted to stars by alternating large-star and small-star steps,
checkpointed each round.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quill.llm import jaccard
from quill.llm.runtime import cells_of, checkpoint, fresh, map_arrow, row_hash, side, texts_of, written

SHINGLE, RADIUS = 3, 3
#: Fingerprints under one key that one task compares, at most.
CELL = 4096


def fingerprint(hashes: np.ndarray) -> int:
    """The fingerprint of the 64-bit hashes of a text's shingles; no shingle: zero."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((2 * ones > len(hashes)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def shingle_hashes(text: bytes | None, size: int = SHINGLE, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of size words, space-joined; of a shorter text as a whole; none of a text without words."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    whole = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(whole, seed)], dtype=np.uint64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    return np.array([digest(whole[s:e], seed) for s, e in zip(starts[: 1 - size].tolist(), ends[size - 1 :].tolist(), strict=True)], dtype=np.uint64)


def fingerprints(docs: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, set_size: int | None = None) -> DataFrame:
    """id and fp (the fingerprint's bits as a signed long) of every row, and row (of row_col, a long) if that is given; null and empty texts have 0.

    With set_size also, of the set of shingles of that many words, its hash m, its size n and its keys (see jaccard); n is 0 without words.
    """
    more = [F.col(f"`{row_col}`").alias("row")] if row_col else []
    rows = docs.select(F.col(id_col).alias("id"), *more, F.col(text_col).alias("text"))
    names = rows.columns[:-1]

    def run(batch):
        texts = texts_of(batch)
        out = np.array([fingerprint(shingle_hashes(t, size)) for t in texts], dtype=np.uint64)
        more = {}
        if set_size:
            sets = [np.unique(shingle_hashes(t, set_size)) for t in texts]
            more = {"m": [jaccard.set_hash(s, f) for s, f in zip(sets, out.tolist(), strict=True)], "n": [len(s) for s in sets], "keys": [jaccard.band_keys(jaccard.minima(s)) if len(s) else [] for s in sets]}
        yield {c: batch.column(c) for c in names} | {"fp": out.view(np.int64)} | more

    return map_arrow(rows, run, "".join(f"{c} {k}, " for c, k in rows.dtypes[:-1]) + "fp long" + (", m long, n long, keys array<long>" if set_size else ""))


def block_masks(blocks: int) -> list[int]:
    """Masks of 64 bits cut into blocks of nearly equal width."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def pivots(blocks: int) -> np.ndarray:
    """The pivots by which pairs are discarded: zero, each block, and in each block the bits whose place has a given binary digit."""
    out = [0]
    for mask in block_masks(blocks):
        bits = [i for i in range(64) if mask >> i & 1]
        out.append(mask)
        for digit in range(max(1, (len(bits) - 1).bit_length())):
            out.append(sum(1 << b for k, b in enumerate(bits) if k >> digit & 1))
    return np.array(out, dtype=np.uint64)


def distances(fps: np.ndarray, references: np.ndarray) -> np.ndarray:
    """The pivot table: Hamming distance of each fingerprint to each reference."""
    return np.bitwise_count(fps[:, None] ^ references[None, :]).astype(np.int16)


def links(fps: np.ndarray, radius: int, references: np.ndarray, apart: int | None = None) -> list[tuple[int, int]]:
    """Links (to, from) that connect all fingerprints at most radius apart; with apart, only between those before and from it."""
    n = len(fps)
    order = np.argsort(np.bitwise_count(fps), kind="stable")
    table = distances(fps, references)[order]
    own, weight = fps[order], table[:, 0].astype(np.int64)
    side = (order >= apart) if apart is not None else None
    root = np.arange(n)
    stop = np.searchsorted(weight, weight + radius, side="right")
    step = 256
    out = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a in range(0, n, step):
        b = min(n, a + step)
        for c in range(a, int(stop[b - 1]), 4 * step):
            d = min(int(stop[b - 1]), c + 4 * step)
            near = np.ones((b - a, d - c), dtype=bool)
            for k in range(1, table.shape[1]):  # discard by the largest difference of coordinates
                near &= np.abs(table[a:b, k, None] - table[None, c:d, k]) <= radius
            if side is not None:
                near &= side[a:b, None] != side[None, c:d]
            i, j = np.nonzero(near)
            i, j = i + a, j + c
            keep = (i < j) & (np.bitwise_count(own[i] ^ own[j]) <= radius)
            i, j = i[keep], j[keep]
            while len(i):
                x, y = find(int(i[0])), find(int(j[0]))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    out.append((int(order[i[0]]), int(order[j[0]])))
                # drop what is joined by now
                r = root
                while not np.array_equal(r, r[r]):
                    r = r[r]
                root = r
                keep = root[i] != root[j]
                i, j = i[keep], j[keep]
    return out


def _links_of_cells(radius: int, references: np.ndarray):
    """Over rows sorted by cell: the links within each cell."""

    def run(batches):
        for table, bounds in cells_of(batches, ("k", "a", "b")):
            a, b, side_ = (table.column(c).to_numpy() for c in ("a", "b", "side"))
            fps = table.column("fp").to_numpy().view(np.uint64)
            # Most cells have two rows: these are discarded and verified by columns, all at once.
            two = bounds[:-1][np.diff(bounds) == 2]
            two = two[(a[two] == b[two]) | (side_[two] != side_[two + 1])]
            two = two[np.abs(distances(fps[two], references) - distances(fps[two + 1], references)).max(axis=1, initial=0) <= radius]
            two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= radius]
            x, y = [fps[two]], [fps[two + 1]]
            for i in np.flatnonzero(np.diff(bounds) > 2).tolist():
                s, e = int(bounds[i]), int(bounds[i + 1])
                found = links(fps[s:e], radius, references, int(np.searchsorted(side_[s:e], 1)) if a[s] != b[s] else None)
                if found:
                    p, q = np.array(found).T + s
                    x.append(fps[p])
                    y.append(fps[q])
            x, y = np.concatenate(x).view(np.int64), np.concatenate(y).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["u", "v"])

    return run


def near_links(distinct: DataFrame, n: int, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """Links u < v between distinct fingerprints (column fp) that connect all at most radius apart. n: how many there are, roughly.

    More blocks make longer keys, so that keys shared by chance stay few at any n.
    """
    blocks = radius + 2
    while blocks < 12 and n * n / 2 ** (64 * (blocks - radius) / blocks) > n:
        blocks += 1
    masks = block_masks(blocks)
    tables = [sum(masks[i] for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    # The bits of a block are its coordinates at the one-bit pivots, relative to zero's.
    keys = F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(signed(m)))) for t, m in enumerate(tables)])
    rows = distinct.select("fp", F.explode(keys).alias("k"))
    # Keys of one row meet nobody; hot keys are cut into chunks.
    counts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = rows.join(side(counts), "k")
    chunks = F.ceil(F.col("n") / cell).cast("long")
    chunk = F.pmod(F.xxhash64(F.lit(5), "fp"), F.col("chunks"))
    rows = rows.withColumn("chunks", chunks).withColumn("c", chunk)
    met = F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda o: F.struct(F.least(o, F.col("c")).alias("a"), F.greatest(o, F.col("c")).alias("b"), (F.col("c") > o).cast("int").alias("side")))
    cells = rows.select("k", "fp", F.explode(met).alias("m")).select("k", "m.a", "m.b", "m.side", "fp")
    dealt = cells.repartition("k", "a", "b").sortWithinPartitions("k", "a", "b", "side", "fp")
    return dealt.mapInArrow(_links_of_cells(radius, pivots(blocks)), "u long, v long").distinct()


def classes(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Node and least node of its class, for every node of links (u < v; loops are ignored): large-star and small-star steps until stars remain."""
    edges = written(links.select("u", "v").where("u <> v"))
    before = None
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        # Large star: larger neighbours go to the least of the neighbourhood.
        edges = both.where("v > u").join(side(least, written), "u").select(F.col("m").alias("u"), "v").distinct()
        # Small star: smaller neighbours go to the least.
        least = edges.groupBy("v").agg(F.min("u").alias("m"))
        edges = edges.join(side(least, written), "v").select(F.explode(F.array(F.struct(F.col("m").alias("u"), F.col("v").alias("v")), F.struct(F.col("m").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = written(edges)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError("classes did not settle")
    nodes = edges.select(F.col("v").alias("node"), F.col("u").alias("least"))
    return nodes.union(edges.select(F.col("u").alias("node"), F.col("u").alias("least")).distinct())


def fingerprint_classes(prints: DataFrame, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """fp, least_id (of the rows that have it) and class (the least fingerprint of its class) for every distinct fp of rows (id, fp)."""
    distinct = checkpoint(prints.groupBy("fp").agg(F.min("id").alias("least_id")))
    labels = classes(near_links(distinct.select("fp"), distinct.count(), radius, cell))
    return distinct.join(labels, distinct["fp"] == labels["node"], "left").select("fp", "least_id", F.coalesce("least", "fp").alias("class"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, cell: int = CELL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits), component_id (the least id reachable by links).

    Rows with null ids are fingerprinted and linked, and have the least known id of their
    class, or null. Rows that repeat are each returned. An empty table gives no rows.
    """
    prints = checkpoint(fingerprints(docs, shingle, id_col, text_col))
    labelled = fingerprint_classes(prints, radius, cell)
    roots = labelled.groupBy("class").agg(F.min("least_id").alias("component_id"))
    named = labelled.join(side(roots), "class").select("fp", "component_id")
    return prints.join(side(named), "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, cell: int = CELL, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None, set_size: int = 5, set_cell: int = jaccard.CELL) -> DataFrame:
    """One row of docs, with all its columns, for each class of near-duplicates: that of the least id.

    With similarity, texts whose sets of shingles of set_size words have that Jaccard similarity
    or more are near-duplicates too, however far apart their fingerprints are.

    Null ids come after all others; rows of one id go by a hash of the whole row, and of rows
    that are equal throughout one stays. So rows without an id, or with one that other texts
    share, stay unless they are near-duplicates of what stays.
    """
    key = fresh(docs, "_row")
    prints = checkpoint(fingerprints(docs.withColumn(key, row_hash(docs)), shingle, id_col, text_col, key, set_size if similarity else None))
    named = fingerprint_classes(prints, radius, cell).select("fp", "class")
    if similarity:
        set_of = lambda t: (fingerprint(shingle_hashes(t, shingle)), np.unique(shingle_hashes(t, set_size)))
        named = jaccard.merged_classes(docs, prints, checkpoint(named), similarity, set_of, classes, text_col, set_cell)
    # A row's key is its hash with its id, so that one hash shared by two rows of different ids loses neither. As one
    # struct it takes null ids as equal, and the join and what follows need one shuffle by it.
    least = F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "row")).alias("least")
    heads = prints.join(side(named), "fp").groupBy("class").agg(least).select(F.struct("least.row", "least.id").alias("_head"))
    # Cast to the heads' type, nullable throughout: else the join casts it, and its partitioning serves nobody after it.
    keyed = docs.withColumn(key, F.struct(row_hash(docs).alias("row"), docs[id_col].alias("id")).cast(heads.schema["_head"].dataType))
    return keyed.join(heads, keyed[key] == heads["_head"], "left_semi").dropDuplicates([key]).drop(key)
