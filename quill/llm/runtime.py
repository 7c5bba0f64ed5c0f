"""What the corpus operators share: Arrow mapping, checkpoints, row identity."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quill.sources.shared import TABLES, checkpoint, columns_of, remove_folder, remove_tables, shared_folder, side, tune, written

__all__ = ["TABLES", "checkpoint", "columns_of", "remove_folder", "remove_tables", "shared_folder", "side", "tune", "written"]


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[dict] | None], schema: str) -> DataFrame:
    """mapInArrow with fn from a batch to dicts of columns (numpy arrays, lists or Arrow arrays)."""
    tune(df.sparkSession)
    fields = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for columns in fn(batch) or ():
                    yield pa.RecordBatch.from_arrays(
                        [c.cast(f.type) if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in arrow], schema=arrow
                    )

    return df.mapInArrow(run, fields)


def cells_of(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by the long columns names, some at a time, with the bounds of runs of equal ones; no run is cut by a batch's end."""
    held: list[pa.Table] = []

    def bounds(table: pa.Table) -> np.ndarray:
        key = np.stack([table.column(c).to_numpy() for c in names])
        return np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [table.num_rows]])

    for batch in batches:
        if batch.num_rows:
            held.append(pa.Table.from_batches([batch]))
            # A batch of the same run throughout only adds to what is held.
            if all(held[0].column(c)[0] == held[-1].column(c)[-1] for c in names):
                continue
            table = pa.concat_tables(held).combine_chunks()
            at = bounds(table)
            yield table.slice(0, at[-2]), at[:-1]
            held = [table.slice(at[-2])]
    if held:
        table = pa.concat_tables(held).combine_chunks()
        yield table, bounds(table)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def pieces(texts: list[bytes | None], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts whose bytes come to most, or of one longer text."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def row_hash(df: DataFrame) -> Column:
    """A hash of a whole row, which tells null from empty and from other columns' nulls; maps, which can't be hashed, are left out."""
    return F.xxhash64(*[x for c, (_, kind) in zip(columns_of(df), df.dtypes, strict=True) if "map<" not in kind for x in (c.isNull(), c)])


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores added until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def remainder(column: str, n: int):
    """crc32 of the column as text, modulo n: how rows are held out."""
    return F.crc32(F.col(column).cast("string")) % n
