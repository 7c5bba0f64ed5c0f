"""Approximate dense search: a stored index of cells that is maintained by commits.

* Every vector lies in its SPILL nearest cells (centres by spherical k-means over a bounded sample), since the one
  nearest cell often isn't among those that a query reads. A query reads the codes of the n_probe cells nearest to it.
* A code is the product-quantised rest of the vector beside its cell's centre: a byte for each PART_DIMS
  components, by codebooks learned from the same sample. The score of a code is the centre's score and a sum of
  table lookups, one table a query.
* The best SHORTLIST x k by code are scored exactly; of the vectors only cells that hold one of those are read. A search of
  all cells takes no codes, which might leave a hit out of the shortlist, but scores every vector exactly.
* An insert is a segment of its own, coded by the same centres, and a delete is a list of ids; both are
  commits. A row counts unless a list of a later version names it. merge() writes live rows of small segments anew, as one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quill.functions.vector import cosine
from quill.operators.lexical import broadcast_if_small, top
from quill.operators.vectors import HITS, SCORES, matrix, query_blocks, scored, unit_rows
from quill.sources import commits
from quill.sources.segments import SEGMENTS, Segmented
from quill.sources.shared import checkpoint

#: Vectors scored exactly for each one that is wanted.
SHORTLIST = 6
#: Vectors from which centres and codebooks are learned, at most; cells, at most.
SAMPLE, MAX_CELLS = 50_000, 4096
#: Cells in which a vector lies, components that share a byte of a code, and entries of a codebook.
SPILL, PART_DIMS, ENTRIES = 2, 2, 256
#: Folders over which cells are dealt.
SHELVES = 16
CODES, VECTORS = "chunk_id long, cell int, home int, code binary, shelf int", "chunk_id long, home int, vec array<double>, shelf int"


def cells_for(rows: int) -> int:
    """A usual number of cells: some times the square root of the rows."""
    return int(min(MAX_CELLS, max(1, round(6 * rows**0.5))))


def _nearest(m: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """The n rows of c of largest product with each row of m, best first."""
    out = np.empty((len(m), min(n, len(c))), dtype=np.int64)
    step = max(1, SCORES // max(1, len(c)))
    for s in range(0, len(m), step):
        out[s : s + step] = np.argsort(-(m[s : s + step] @ c.T), axis=1, kind="stable")[:, :n]
    return out


def sample_of(vectors: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Unit vectors that come first by a hash of the chunk, of the most common dimension."""
    known = vectors.where("vec is not null and size(vec) > 0").select("chunk_id", F.col("vec").cast("array<double>").alias("vec"))
    first = known.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample).toArrow()
    if not first.num_rows:
        return np.zeros((0, 0))
    column = first.column("vec").combine_chunks()
    m = unit_rows(matrix(column, int(np.bincount(np.diff(column.offsets.to_numpy())).argmax()))[1])
    return m[(m != 0).any(axis=1)]


def centres_of(m: np.ndarray, cells: int, rounds: int = 12, seed: int = 42) -> np.ndarray:
    """Unit centres of spherical k-means."""
    if not len(m):
        return np.zeros((0, m.shape[1]))
    rng = np.random.default_rng(seed)
    # Spread starts: each is drawn by its distance to those before.
    at = [int(rng.integers(len(m)))]
    far = 1 - m @ m[at[0]]
    while len(at) < min(cells, len(m)):
        weight = np.maximum(far, 0)
        at.append(int(rng.choice(len(m), p=weight / weight.sum()) if weight.sum() > 0 else rng.integers(len(m))))
        far = np.minimum(far, 1 - m @ m[at[-1]])
    c = m[at].copy()
    for _ in range(rounds):
        sums = np.zeros_like(c)
        np.add.at(sums, _nearest(m, c, 1)[:, 0], m)
        empty = ~(sums != 0).any(axis=1)
        sums[empty] = c[empty]
        c = unit_rows(sums)
    return c


def codebooks_of(rest: np.ndarray, seed: int = 42, rounds: int = 10) -> np.ndarray:
    """(part, entry, PART_DIMS): k-means of each part of the rests; the last part is filled up with zeros."""
    parts = _parts(rest)
    rng = np.random.default_rng(seed)
    out = np.zeros((parts.shape[1], ENTRIES, PART_DIMS))
    for p in range(parts.shape[1]):
        x = parts[:, p]
        c = x[rng.permutation(len(x))[:ENTRIES]]
        for _ in range(rounds):
            own = _closest(x, c)
            count = np.bincount(own, minlength=len(c))
            sums = np.stack([np.bincount(own, x[:, d], len(c)) for d in range(PART_DIMS)], axis=1)
            c = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], c)
        out[p, : len(c)] = c
        out[p, len(c) :] = c[:1] if len(c) else 0
    return out


def _parts(m: np.ndarray) -> np.ndarray:
    width = -(-m.shape[1] // PART_DIMS) * PART_DIMS
    return np.pad(m, ((0, 0), (0, width - m.shape[1]))).reshape(len(m), width // PART_DIMS, PART_DIMS)


def _closest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), dtype=np.int64)
    step = max(1, SCORES // max(1, len(c)))
    for s in range(0, len(x), step):
        out[s : s + step] = ((c * c).sum(axis=1) - 2 * x[s : s + step] @ c.T).argmin(axis=1)
    return out


@dataclass(frozen=True)
class CellIndex(Segmented):
    """A version of a stored index, with its centres and codebooks."""

    centres: np.ndarray
    books: np.ndarray

    @property
    def segments(self) -> list[int]:
        return self.segments_of("codes")

    @cached_property
    def codes(self) -> DataFrame:
        return self.live(self.rows_since("codes", CODES))

    @cached_property
    def vectors(self) -> DataFrame:
        return self.live(self.rows_since("vectors", VECTORS))

    # Search.

    def nearest(self, unit: np.ndarray, n_probe: int) -> np.ndarray:
        """Which cells (columns) are the n_probe nearest to each query (rows)."""
        probes = np.zeros((len(unit), len(self.centres)), dtype=bool)
        if probes.size:
            np.put_along_axis(probes, _nearest(unit, self.centres, n_probe), True, axis=1)
        return probes

    def probed(self, queries: DataFrame, k: int, n_probe: int, digits: int = 6) -> DataFrame:
        """(query_id, chunk_id, score, rank): the k best of the n_probe cells nearest to each query; other cells are not read. Of all cells it is the exact search."""
        found, kept, whole = [], None, n_probe >= len(self.centres)
        for ids, unit in query_blocks(queries):
            if unit.shape[1] != self.centres.shape[1] or not len(self.centres):
                continue
            if kept is not None:
                found.append(checkpoint(kept))
            kept = scored(self.vectors.select("chunk_id", "vec"), ids, unit, k) if whole else self._shortlisted(ids, unit, n_probe, SHORTLIST * k)
        if kept is None:
            return self.spark.createDataFrame([], HITS + ", rank long")
        if whole:
            return top(reduce(DataFrame.unionByName, [*found, kept]), k, digits)
        short = checkpoint(reduce(DataFrame.unionByName, [*found, kept]).groupBy("query_id", "chunk_id", "home").agg(F.max("score").alias("score")))
        short = checkpoint(top(short, SHORTLIST * k).join(short.select("query_id", "chunk_id", "home"), ["query_id", "chunk_id"]).select("query_id", "chunk_id", "home"))
        homes = [r[0] for r in short.select("home").distinct().collect()]  # cells
        exact = _of_cells(self.vectors, "home", homes).select("chunk_id", "vec").join(broadcast_if_small(short.select("query_id", "chunk_id")), "chunk_id").join(broadcast_if_small(queries.select("query_id", F.col("vec").alias("q"))), "query_id")
        return top(exact.select("query_id", "chunk_id", cosine(F.col("q"), F.col("vec")).alias("score")), k, digits)

    def _shortlisted(self, ids: np.ndarray, unit: np.ndarray, n_probe: int, want: int) -> DataFrame:
        """(query_id, chunk_id, home, score by code): the best of each batch of codes."""
        probes = self.nearest(unit, n_probe)
        tables = np.einsum("qpd,ped->qpe", _parts(unit), self.books).reshape(len(unit), -1).astype(np.float32)
        shared = self.spark.sparkContext.broadcast((ids, probes, unit @ self.centres.T, tables))
        parts = len(self.books)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, probes, near, tables = shared.value
            for batch in batches:
                cell, chunk, home = (batch.column(c).to_numpy() for c in ("cell", "chunk_id", "home"))
                places = np.frombuffer(b"".join(batch.column("code").to_pylist()), dtype=np.uint8).reshape(-1, parts) + ENTRIES * np.arange(parts)
                got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for c in np.unique(cell):
                    q, own = np.flatnonzero(probes[:, c]), np.flatnonzero(cell == c)
                    for s in range(0, len(own), max(1, SCORES // max(1, len(q) * parts))):
                        at = own[s : s + max(1, SCORES // max(1, len(q) * parts))]
                        if len(q):
                            scores = near[q, c, None] + tables[q][:, places[at]].sum(axis=2)
                            got.append((np.repeat(q, len(at)), np.tile(at, len(q)), scores.ravel()))
                if not got:
                    continue
                q, at, scores = (np.concatenate(x) for x in zip(*got, strict=True))
                order = np.lexsort((chunk[at], -scores, q))
                q, at, scores = q[order], at[order], scores[order]
                kept = np.arange(len(q)) - np.searchsorted(q, q) < SPILL * want  # a chunk may be there twice
                q, at = q[kept], at[kept]
                yield pa.RecordBatch.from_arrays([pa.array(ids[q], pa.int64()), pa.array(chunk[at]), pa.array(home[at]), pa.array(scores[kept].astype(float))], names=["query_id", "chunk_id", "home", "score"])

        rows = _of_cells(self.codes, "cell", np.flatnonzero(probes.any(axis=0)).tolist())
        return rows.select("chunk_id", "cell", "home", "code").mapInArrow(score, "query_id long, chunk_id long, home int, score double")

    def widened(self, queries: DataFrame, k: int, n_probe: int, digits: int = 6) -> DataFrame:
        """probed(); twice as many cells for queries with fewer than k hits, and so on until all are read."""
        parts, left, width = [], queries.select("query_id", "vec"), n_probe
        while True:
            hits = checkpoint(self.probed(left, k, width, digits))
            if width >= len(self.centres):
                parts.append(hits)
                break
            full = broadcast_if_small(checkpoint(hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("query_id")))
            parts.append(hits.join(full, "query_id", "left_semi"))
            left = left.join(full, "query_id", "left_anti")
            if left.isEmpty():
                break
            width *= 2
        return reduce(DataFrame.unionByName, parts)

    # Maintenance. Each gives the index as it is afterwards.

    def upsert(self, vectors: DataFrame) -> CellIndex:
        """Put vectors (chunk_id, vec) in; those of the same ids before them die. Null vectors, zero vectors and such of another dimension only die."""
        rows = checkpoint(vectors.select("chunk_id", F.col("vec").cast("array<double>").alias("vec")))
        staged = _stage(self.log, rows, self.centres, self.books)
        return self._at(self.log.commit(self.state, self.stage_dead(rows, staged), rebase=True))

    def delete(self, ids: DataFrame) -> CellIndex:
        """Take chunk_ids out."""
        return self._at(self.log.commit(self.state, self.stage_dead(ids), rebase=True))

    def merge(self, all_segments: bool = False) -> CellIndex:
        """Write the live rows of segments anew as one (see Segmented.to_merge)."""
        chosen, whole = self.to_merge("codes", all_segments)
        old = self.files_of(chosen, "codes", "vectors")
        own = self._at(self.only(old))
        staged = self.log.stage(_laid(own.codes, "cell"), "codes", ["shelf"])
        staged = self.log.stage(_laid(own.vectors, "home"), "vectors", ["shelf"], staged)
        return self._at(self.commit_merge(staged, old, whole))

    def updated(self, vectors: DataFrame) -> CellIndex:
        """The index of just these vectors (chunk_id, vec): new ones are added as a segment, those that are no longer there die, then maintained(). Vectors never change under their id."""
        index, ids = self, self.vectors.select("chunk_id")
        new = checkpoint(vectors.select("chunk_id", "vec").where("vec is not null").join(ids, "chunk_id", "left_anti"))
        gone = checkpoint(ids.join(vectors.select("chunk_id"), "chunk_id", "left_anti"))
        if not gone.isEmpty():
            index = index.delete(gone)
        if not new.isEmpty():
            index = index.upsert(new)
        return index.maintained()

    def maintained(self) -> CellIndex:
        """The index, merged if it has more than SEGMENTS segments."""
        return self.merge() if len(self.segments) > SEGMENTS else self

    def _at(self, state: commits.State) -> CellIndex:
        return CellIndex(self.log, state, self.centres, self.books)


def _of_cells(rows: DataFrame, column: str, cells: list[int]) -> DataFrame:
    """Rows of the cells; of stored rows only these cells' folders and row groups are read."""
    return rows.where(F.col("shelf").isin(sorted({c % SHELVES for c in cells})) & F.col(column).isin(cells))


def _laid(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn("shelf", F.col(column) % SHELVES).repartition("shelf", F.pmod(F.xxhash64("chunk_id"), F.lit(4))).sortWithinPartitions("shelf", column)


def with_codes(vectors: DataFrame, centres: np.ndarray, books: np.ndarray) -> DataFrame:
    """(chunk_id, cell, home, code, vec) of the vectors (chunk_id, vec): a row for each of a vector's cells, the vector itself in the first, its home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, m = matrix(batch.column("vec"), centres.shape[1])
            sound = (m != 0).any(axis=1)
            at, m = at[sound], unit_rows(m[sound])
            cells = _nearest(m, centres, SPILL)
            for i in range(cells.shape[1]):
                parts = _parts(m - centres[cells[:, i]])
                code = np.stack([_closest(parts[:, p], books[p]) for p in range(len(books))], axis=1).astype(np.uint8)
                vec = batch.column("vec").take(pa.array(at)) if i == 0 else pa.nulls(len(at), batch.column("vec").type)
                yield pa.RecordBatch.from_arrays([batch.column("chunk_id").take(pa.array(at)), pa.array(cells[:, i].astype(np.int32)), pa.array(cells[:, 0].astype(np.int32)), pa.array([x.tobytes() for x in code], pa.binary()), vec], names=["chunk_id", "cell", "home", "code", "vec"])

    rows = vectors.select("chunk_id", F.col("vec").cast("array<double>").alias("vec"))
    return rows.mapInArrow(run, "chunk_id long, cell int, home int, code binary, vec array<double>")


def _stage(log: commits.Log, vectors: DataFrame, centres: np.ndarray, books: np.ndarray) -> str:
    coded = with_codes(vectors if len(centres) else vectors.limit(0), centres if len(centres) else np.zeros((1, 1)), books if len(centres) else np.zeros((1, ENTRIES, PART_DIMS)))
    coded = checkpoint(coded)
    staged = log.stage(_laid(coded.select("chunk_id", "cell", "home", "code"), "cell"), "codes", ["shelf"])
    return log.stage(_laid(coded.where(F.col("vec").isNotNull()).select("chunk_id", "home", "vec"), "home"), "vectors", ["shelf"], staged)


def write_index(vectors: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE, seed: int = 42, like: CellIndex | None = None) -> None:
    """Store an index of vectors (chunk_id, vec), filtered to one model and chunking, in the place of one that is there. cells: cells_for() the rows, unless given. like: take centres and codebooks from that index."""
    if like is None:
        m = sample_of(vectors, sample)
        centres = centres_of(m, min(MAX_CELLS, cells or cells_for(vectors.count())), seed=seed)
        books = codebooks_of(m - centres[_nearest(m, centres, 1)[:, 0]], seed) if len(m) else np.zeros((0, ENTRIES, PART_DIMS))
    else:
        centres, books = like.centres, like.books
    spark = vectors.sparkSession
    log = commits.Log(spark, path)
    state = log.adopt()
    staged = _stage(log, vectors, centres, books)
    rows = [("centre", i, c.tolist()) for i, c in enumerate(centres)] + [("book", i, b.ravel().tolist()) for i, b in enumerate(books)]
    staged = log.stage(spark.createDataFrame(rows, "kind string, i int, x array<double>").coalesce(1), "model", staged=staged)
    log.commit(state, staged, list(state.files))


def read_index(spark: SparkSession, path: str, version: int | None = None) -> CellIndex:
    log = commits.Log(spark, path)
    log.settle()
    state = log.state(version)
    rows = log.read(state, "kind string, i int, x array<double>", "model").orderBy("kind", "i").collect()  # MAX_CELLS and a codebook's parts, at most
    centres, books = ([r.x for r in rows if r.kind == kind] for kind in ("centre", "book"))
    return CellIndex(log, state, np.array(centres) if centres else np.zeros((0, 0)), np.array(books).reshape(len(books), ENTRIES, PART_DIMS))


def read_share(index: CellIndex, queries: DataFrame, n_probe: int, sizes: dict[int, int] | None = None) -> float:
    """The mean share of all stored codes that a query reads."""
    sizes = sizes or {r[0]: r[1] for r in index.codes.groupBy("cell").count().collect()}  # a row a cell
    count = np.array([sizes.get(c, 0) for c in range(len(index.centres))], dtype=float)
    shares: list[float] = []
    for _, unit in query_blocks(queries):
        if unit.shape[1] == index.centres.shape[1]:
            shares += (index.nearest(unit, n_probe) @ count / max(1.0, count.sum())).tolist()
    return float(np.mean(shares)) if shares else 0.0

