"""Files to raw spans through a pluggable extractor."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

SPANS = "path string, page int, page_x0 double, page_y0 double, page_x1 double, page_y1 double, block int, x0 double, y0 double, x1 double, y1 double, line int, span int, text string, size double, font string, flags int, error string"
_KINDS = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
#: Spans in one batch that goes back.
BATCH = 10_000


def extract_spans(files: DataFrame, extractor: Callable[[bytes], Iterable[dict]]) -> DataFrame:
    """Spans of each file's content. A file that the extractor can't read gives one row with its error."""
    fields = [tuple(f.split(" ")) for f in SPANS.split(", ")]

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(name) for r in rows], _KINDS[kind]) for name, kind in fields], names=[name for name, _ in fields])

    def run(batches):
        for batch in batches:
            rows: list[dict] = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                try:
                    rows += [{"path": path, **r} for r in extractor(content.as_py() or b"")]
                except Exception as error:  # noqa: BLE001  one bad file must not end the job
                    rows.append({"path": path, "error": f"{type(error).__name__}: {error}"[:500]})
                while len(rows) >= BATCH:
                    yield batch_of(rows[:BATCH])
                    rows = rows[BATCH:]
            if rows:
                yield batch_of(rows)

    files.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    return files.select("path", "content").mapInArrow(run, SPANS)
