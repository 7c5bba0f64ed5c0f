"""Overlap join of intervals with spans, for the least and the largest value of the spans that an interval overlaps.

A key's positions are cut into bins of one width, a power of two chosen so that the busiest bin has about
BIN_ROWS rows. A span is a row in the bins of its two ends, an interval asks in the bins of its two ends, and only
there are single spans looked at, in one sweep over sorted ends. What lies between takes aggregates:

* spans that last through a whole bin, which every interval with an end in that bin overlaps: the bins between a
  span's ends are split into dyadic runs, at most two a level, and a bin reads the runs that contain it;
* spans with an end in a bin that lies between an interval's ends: bins are summed up to dyadic runs, and an
  interval reads the runs that its inner bins split into.

So rows grow with spans and intervals by a logarithm of their lengths, and pairs are never made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quill.sources.shared import checkpoint

#: Ends of spans and intervals of one key in one bin, at most, unless one position has more.
BIN_ROWS = 512
_LEVELS = range(0, 43, 3)


def _right(c: Column, n) -> Column:
    return F.call_function("shiftright", c, n if isinstance(n, Column) else F.lit(n))


def _runs(lo: Column, hi: Column, level: Column) -> Column:
    """The dyadic runs of a level that bins lo to hi - 1 are split into."""
    left = _right(lo + F.call_function("shiftleft", F.lit(1).cast("long"), level) - 1, level)
    right = _right(hi, level)
    return F.filter(F.array(F.when((left < right) & (left % 2 != 0), left), F.when((left < right) & (right % 2 != 0), right - 1)), lambda x: x.isNotNull())


def swept(a: np.ndarray, b: np.ndarray, start: np.ndarray, end: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and largest value of spans with start < b and end > a, for each interval; the least is above the largest if there is none.

    Spans enter by start as intervals come by b; a tree over the spans' ends keeps the least and largest value of each suffix.
    """
    ends = np.unique(end)
    n = len(ends)
    low, high = [np.inf] * (n + 1), [-np.inf] * (n + 1)
    at = (n - np.searchsorted(ends, end)).tolist()  # places count from the last end
    upto = (n - np.searchsorted(ends, a, side="right")).tolist()
    least, most = np.full(len(a), np.inf), np.full(len(a), -np.inf)
    spans, k = np.argsort(start, kind="stable").tolist(), 0
    start_, value_, b_ = start.tolist(), value.tolist(), b.tolist()
    for i in np.argsort(b, kind="stable").tolist():
        while k < len(spans) and start_[spans[k]] < b_[i]:
            p, v = at[spans[k]], value_[spans[k]]
            while p <= n:
                low[p], high[p] = min(low[p], v), max(high[p], v)
                p += p & -p
            k += 1
        p, x, y = upto[i], np.inf, -np.inf
        while p:
            x, y = min(x, low[p]), max(y, high[p])
            p &= p - 1
        least[i], most[i] = x, y
    return least, most


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by k and bin, asking ones without a value: the asking rows' answers."""
    held: list[pa.RecordBatch] = []

    def answers(table: pa.Table) -> Iterator[pa.RecordBatch]:
        cuts = [0, *(np.flatnonzero(np.logical_or(*(pc.not_equal(table.column(c).slice(1), table.column(c).slice(0, table.num_rows - 1)).to_numpy() for c in ("k", "bin")))) + 1).tolist(), table.num_rows]
        asks = table.column("v").is_null().to_numpy()
        s, e = table.column("s").to_numpy(), table.column("e").to_numpy()
        v = pc.fill_null(table.column("v"), 0).to_numpy()
        rows, least, most = [], [], []
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            own = asks[i:j]
            if own.any() and not own.all():
                x, y = swept(s[i:j][own], e[i:j][own], s[i:j][~own], e[i:j][~own], v[i:j][~own])
                hit = x <= y
                rows.append(i + np.flatnonzero(own)[hit])
                least.append(x[hit])
                most.append(y[hit])
        if rows:
            at = np.concatenate(rows)
            out = pa.table({"k": table.column("k").take(at), "s": s[at], "e": e[at], "low": np.concatenate(least).astype(np.int64), "high": np.concatenate(most).astype(np.int64)})
            yield from out.to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        last = (batch.column("k")[-1], batch.column("bin")[-1])
        if (held[0].column("k")[0], held[0].column("bin")[0]) == last:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        same = pc.and_(pc.equal(table.column("k"), last[0]), pc.equal(table.column("bin"), last[1])).to_numpy()
        cut = int(same.argmax())
        yield from answers(table.slice(0, cut).combine_chunks())
        held = table.slice(cut).to_batches()
    if held:
        yield from answers(pa.Table.from_batches(held).combine_chunks())


def overlap_range(intervals: DataFrame, spans: DataFrame, key: str, start: str, end: str, value: str, bin_rows: int = BIN_ROWS) -> DataFrame:
    """(key, start, end, low, high): for each different interval that overlaps a span of its key, the least and the largest value of those.

    A span and an interval overlap if each starts before the other ends. Values are whole numbers. Rows with nulls,
    and intervals that end before they start, overlap nothing.
    """
    pick = lambda df, v: df.select(F.col(key).alias("k"), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"), v.cast("long").alias("v"))
    sound = "k is not null and s is not null and e is not null and s <= e"
    own = checkpoint(pick(spans, F.col(value)).where(sound + " and v is not null").groupBy("k", "s", "e").agg(F.min("v").alias("v"), F.max("v").alias("w")))
    asks = checkpoint(pick(intervals, F.lit(None)).where(sound).select("k", "s", "e").distinct())

    # A few numbers reach the driver: the busiest bin at each width, and the longest of all.
    ends = own.select("k", "s", "e").union(asks).select("k", F.explode(F.array("s", F.greatest("s", F.col("e") - 1))).alias("p")).groupBy("k", "p").count()
    at = ends.select("k", "p", "count", F.explode(F.lit(list(_LEVELS))).alias("level")).groupBy("k", "level", _right(F.col("p"), F.col("level")).alias("bin"))
    busiest = {r[0]: r[1] for r in at.agg(F.sum("count").alias("n")).groupBy("level").agg(F.max("n")).collect()}
    width = max((j for j, n in busiest.items() if n <= bin_rows), default=0)
    longest = own.select("s", "e").union(asks.select("s", "e")).agg(F.max(F.col("e") - F.col("s"))).first()[0] or 0
    levels = F.lit(list(range(((longest >> width) + 2).bit_length())))

    def binned(df: DataFrame) -> DataFrame:
        return df.withColumns({"a": _right(F.col("s"), width), "z": _right(F.greatest("s", F.col("e") - 1), width)})

    own, asks = binned(own), binned(asks)
    both = F.when(F.col("a") == F.col("z"), F.array("a")).otherwise(F.array("a", "z"))
    pieces = own.select("k", F.explode(both).alias("bin"), "s", "e", "v", "w")
    asking = asks.select("k", F.explode(both).alias("bin"), "s", "e")
    null = F.lit(None).cast("long")
    values = F.explode(F.when(F.col("v") == F.col("w"), F.array("v")).otherwise(F.array("v", "w"))).alias("v")
    rows = pieces.select("k", "bin", "s", "e", values).union(asking.select("k", "bin", "s", "e", null))
    kind = own.schema["k"].dataType.simpleString()
    parts = rows.repartition("k", "bin").sortWithinPartitions("k", "bin").mapInArrow(_sweep, f"k {kind}, s long, e long, low long, high long")
    if longest > 1 << width:
        extreme = F.min("v").alias("low"), F.max("w").alias("high")
        inner = lambda df, *more: df.where(F.col("z") - F.col("a") > 1).select("k", "s", "e", (F.col("a") + 1).alias("lo"), F.col("z").alias("hi"), *more, F.explode(levels).alias("level"))
        node = F.explode(_runs(F.col("lo"), F.col("hi"), F.col("level"))).alias("node")
        cover = inner(own, "v", "w").select("k", "level", node, "v", "w").groupBy("k", "level", "node").agg(*extreme)
        above = asking.select("k", "s", "e", "bin", F.explode(levels).alias("level")).withColumn("node", _right(F.col("bin"), F.col("level")))
        summed = pieces.groupBy("k", "bin").agg(F.min("v").alias("v"), F.max("w").alias("w")).select("k", "bin", "v", "w", F.explode(levels).alias("level"))
        summed = summed.groupBy("k", "level", _right(F.col("bin"), F.col("level")).alias("node")).agg(*extreme)
        within = inner(asks).select("k", "s", "e", "level", node)
        for left, right in ((above, cover), (within, summed)):
            parts = parts.union(left.join(right, ["k", "level", "node"]).select("k", "s", "e", "low", "high"))
    return parts.groupBy("k", "s", "e").agg(F.min("low").alias("low"), F.max("high").alias("high")).select(F.col("k").alias(key), F.col("s").alias(start), F.col("e").alias(end), "low", "high")
