"""Point-in-time feature join by persistent ordered trees.

A version of a key may be used from its start (the later of event and arrival) until its expiry.
The versions of a key stand in an ordered tree by their rank; a start writes a leaf, an expiry
clears it, and either copies the path up to the root, so that every moment has a root of its own
and old roots stay. A question searches the roots' times for the last one not after its own and
reads that root's maximum.

No key is held in one piece. Time is cut into slices of one width, a power of two chosen so that
the busiest slice of any key has about SLICE_ROWS rows, and each slice has its own tree. A version
is a row in the slices of its start and of its end; of those that last through a slice only the
best can win there, and it is found by an aggregate: the slices in between are split into
dyadic runs (at most two a level), each run keeps its best version, and a slice reads the runs
that contain it. So a version makes a number of rows that is logarithmic in its length at most.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quill.llm.runtime import checkpoint, columns_of, fresh, tune

#: Moments (starts, ends and questions) of one key in one slice, at most, unless one second has more.
SLICE_ROWS = 512
_LEVELS = range(0, 43, 3)
_ALWAYS = np.iinfo(np.int64).min


class Forest:
    """Persistent trees of many groups at once, copied level by level.

    group and place say which leaf an edit writes, time when, value what (-1 clears it). Groups come
    in order and places count from 0 in each. Every edit makes one new node on each level: the copy of
    the node above its leaf, which points to the newest copies of its two children. tops of the
    last level are the roots' maxima.
    """

    def __init__(self, group: np.ndarray, place: np.ndarray, time: np.ndarray, value: np.ndarray):
        order = np.lexsort((time, group))
        self.group, self.time, place, tops = group[order], time[order], place[order], value[order]
        self.children: list[tuple[np.ndarray, np.ndarray]] = []
        n = len(order)
        for level in range(int(place.max(initial=0)).bit_length()):
            node, side = place >> (level + 1), (place >> level) & 1
            by = np.lexsort((node, self.group))  # stable: in each node by time
            first = np.ones(n, dtype=bool)
            first[1:] = (node[by][1:] != node[by][:-1]) | (self.group[by][1:] != self.group[by][:-1])
            start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
            newest = []
            for which in (0, 1):
                last = np.maximum.accumulate(np.where(side[by] == which, np.arange(n), -1))
                child = np.empty(n, dtype=np.int64)
                child[by] = np.where(last >= start, by[np.maximum(last, 0)], -1)
                newest.append(child)
            self.children.append((newest[0], newest[1]))
            left, right = (np.where(c >= 0, tops[np.maximum(c, 0)], -1) for c in newest)
            tops = np.maximum(left, right)
        self.tops = tops
        self.bounds = np.searchsorted(self.group, np.arange(int(group.max(initial=-1)) + 2))

    def best(self, group: int, times: np.ndarray) -> np.ndarray:
        """The maximum of the root that holds at each of the times, or -1."""
        if group + 1 >= len(self.bounds):
            return np.full(len(times), -1)
        a, b = self.bounds[group], self.bounds[group + 1]
        at = a + np.searchsorted(self.time[a:b], times, side="right") - 1
        return np.where(at >= a, self.tops[np.maximum(at, 0)], -1) if b > a else np.full(len(times), -1)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by k and slice, some at a time, with the bounds of their groups; none is cut by a batch's end."""
    held: list[pa.RecordBatch] = []

    def differ(a: pa.Table, b: pa.Table) -> np.ndarray:
        return np.logical_or(*(pc.not_equal(a.column(c), b.column(c)).to_numpy().astype(bool) for c in ("k", "slice")))

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        ends = pa.Table.from_batches([held[0].slice(0, 1)]), pa.Table.from_batches([batch.slice(batch.num_rows - 1)])
        if not differ(*ends)[0]:
            continue  # all of what is held is one group, which may go on
        table = pa.Table.from_batches(held).combine_chunks()
        cuts = np.flatnonzero(differ(table.slice(1), table.slice(0, table.num_rows - 1))) + 1
        yield table.slice(0, cuts[-1]), np.concatenate([[0], cuts])
        held = table.slice(cuts[-1]).to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, np.array([0, table.num_rows])


def _answers(table: pa.Table, bounds: np.ndarray) -> pa.Table:
    """The asking rows of whole groups, each with the best version at its time."""
    group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    asks = table.column("t").is_valid().to_numpy()
    rows = np.flatnonzero(~asks)  # by rank in each group
    place = rows - bounds[group[rows]]
    place -= np.concatenate([[0], np.cumsum(asks)])[rows] - np.concatenate([[0], np.cumsum(asks)])[bounds[group[rows]]]
    since = pc.fill_null(table.column("since"), _ALWAYS).to_numpy()[rows]
    ends = np.flatnonzero(table.column("until").is_valid().to_numpy()[rows])
    until = pc.fill_null(table.column("until"), 0).to_numpy()[rows][ends]
    forest = Forest(
        np.concatenate([group[rows], group[rows][ends]]), np.concatenate([place, place[ends]]), np.concatenate([since, until]), np.concatenate([rows, np.full(len(ends), -1)])
    )
    asking = np.flatnonzero(asks)
    times = pc.fill_null(table.column("t"), 0).to_numpy()[asking]
    won = np.full(len(asking), -1)
    starts = np.searchsorted(group[asking], np.arange(len(bounds)))
    for g in np.unique(group[asking]):
        a, b = starts[g], starts[g + 1]
        won[a:b] = forest.best(int(g), times[a:b])
    best = table.column("best").combine_chunks().take(pa.array(won, mask=won < 0))
    return pa.table({"k": table.column("k").take(asking), "t": times, "best": best})


def _runs(lo: Column, hi: Column, level: Column) -> Column:
    """The dyadic runs of a level, at most two, that slices lo to hi - 1 are split into; node i of level j is slices i * 2**j and on."""
    left = F.call_function("shiftright", lo + F.call_function("shiftleft", F.lit(1).cast("long"), level) - 1, level)
    right = F.call_function("shiftright", hi, level)
    return F.filter(F.array(F.when((left < right) & (left % 2 != 0), left), F.when((left < right) & (right % 2 != 0), right - 1)), lambda x: x.isNotNull())


def point_in_time(
    asks: DataFrame, versions: DataFrame, ask_key: str = "key", ask_time: str = "t", key: str = "key", event: str = "event", arrival: str = "arrival", expiry: str = "expiry",
    ties: Sequence[str] = (), payload: Sequence[str] = (), out: str = "version", slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Every row of asks with a struct column out: the winning version's event, arrival, ties and payload, or null.

    A version counts if its key equals the row's, event <= t and arrival <= t < expiry; the latest event wins, then the
    latest arrival, then the largest of ties, then of payload. Times are longs, ties and payload of types that can be
    ordered (no maps). Versions without key, event, arrival or expiry never count, nor do those that expire before
    they can be used; rows of asks without key or time have null. Rows of asks that repeat come back as often; equal
    versions count as one. Columns of asks stay, whatever they are called; if one is called as out, out gets underscores.
    """
    spark = asks.sparkSession
    col = lambda df, c: df[f"`{c.replace('`', '``')}`"]
    ranked = [col(versions, event).cast("long").alias("event"), col(versions, arrival).cast("long").alias("arrival"), *[col(versions, c).alias(c) for c in (*ties, *payload)]]
    v = versions.select(
        col(versions, key).alias("k"), F.greatest(col(versions, event), col(versions, arrival)).cast("long").alias("s"), col(versions, expiry).cast("long").alias("e"), F.struct(*ranked).alias("best")
    ).where(F.col("k").isNotNull() & F.col("best.event").isNotNull() & F.col("best.arrival").isNotNull() & (F.col("s") < F.col("e")))
    v = checkpoint(v.groupBy("k", "s", "e").agg(F.max("best").alias("best")))
    q = asks.select(col(asks, ask_key).alias("k"), col(asks, ask_time).cast("long").alias("t"))
    q = checkpoint(q.where(F.col("k").isNotNull() & F.col("t").isNotNull()).distinct())

    # A few numbers reach the driver: the busiest slice of any key at each width, and the longest version.
    moments = v.select("k", F.explode(F.array("s", F.col("e") - 1)).alias("t")).union(q).groupBy("k", "t").count()
    at = moments.select("k", "t", "count", F.explode(F.lit(list(_LEVELS))).alias("level")).groupBy("k", "level", F.call_function("shiftright", F.col("t"), F.col("level")).alias("slice"))
    busiest = {r[0]: r[1] for r in at.agg(F.sum("count").alias("n")).groupBy("level").agg(F.max("n")).collect()}
    width = max((j for j, n in busiest.items() if n <= slice_rows), default=0)
    longest = v.agg(F.max(F.col("e") - F.col("s"))).first()[0] or 0
    levels = ((longest >> width) + 1).bit_length()

    slice_of = lambda c: F.shiftright(c, width)
    cut = v.select("*", slice_of(F.col("s")).alias("a"), slice_of(F.col("e") - 1).alias("z"))
    null = F.lit(None).cast("long")
    first = F.struct(F.col("a").alias("slice"), F.col("s").alias("since"), F.when(F.col("a") == F.col("z"), F.col("e")).alias("until"))
    last = F.struct(F.col("z").alias("slice"), null.alias("since"), F.col("e").alias("until"))
    pieces = cut.select("k", F.explode(F.when(F.col("a") == F.col("z"), F.array(first)).otherwise(F.array(first, last))).alias("p"), "best")
    rows = pieces.select("k", "p.slice", "p.since", "p.until", null.alias("t"), "best")
    asking = q.select("k", slice_of(F.col("t")).alias("slice"), null.alias("since"), null.alias("until"), "t", F.lit(None).cast(v.schema["best"].dataType).alias("best"))
    union = rows.union(asking)
    if longest > (1 << width):
        through = cut.where(F.col("z") - F.col("a") > 1).select("k", (F.col("a") + 1).alias("lo"), F.col("z").alias("hi"), "best", F.explode(F.lit(list(range(levels)))).alias("level"))
        cover = through.select("k", "level", F.explode(_runs(F.col("lo"), F.col("hi"), F.col("level"))).alias("node"), "best").groupBy("k", "level", "node").agg(F.max("best").alias("best"))
        asked = q.select("k", slice_of(F.col("t")).alias("slice")).distinct().select("k", "slice", F.explode(F.lit(list(range(levels)))).alias("level"))
        found = asked.withColumn("node", F.call_function("shiftright", F.col("slice"), F.col("level"))).join(cover, ["k", "level", "node"])
        union = union.union(found.select("k", "slice", null, null, null, "best"))

    schema = union.select("k", "t", "best").schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in _groups(batches):
            yield from _answers(table, bounds).cast(arrow).to_batches()

    tune(spark)
    won = union.repartition("k", "slice").sortWithinPartitions("k", "slice", "best").mapInArrow(solve, schema)
    name = fresh(asks, out)
    won = won.select(F.col("k").alias("_won_k"), F.col("t").alias("_won_t"), F.col("best").alias("_won_best"))
    joined = asks.join(won, (col(asks, ask_key) == won["_won_k"]) & (col(asks, ask_time) == won["_won_t"]), "left")
    return joined.select(*columns_of(asks), won["_won_best"].alias(name))


def times(ident: Column) -> tuple[Column, Column, Column, Column]:
    """The first four groups of eight hex digits of the SHA-256 of a decimal id."""
    digest = F.sha2(ident.cast("string"), 256)
    return tuple(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4))


#: Age in seconds beyond which a winning version is stale.
FRESH = 20


def features(docs: DataFrame, labels: DataFrame, fresh_for: int = FRESH) -> DataFrame:
    """One row per row of labels: doc_id, t, version_id, age, status, n_chars, lang.

    Documents are versions of their source, and labels ask about their document's source; where
    several rows of documents share an id, that is the smallest of their sources. Labels without an id, without
    a document or whose document has no source have status `none`. Versions that tie in all
    give the largest n_chars, then lang; null is smallest.
    """
    a, b, c, _ = times(F.col("doc_id"))
    known = docs.select("doc_id", F.col("source").alias("key"), "n_chars", "lang")
    versions = known.withColumn("event", a % 200_000)
    versions = versions.withColumns({"arrival": F.col("event") - 60 + b % 1200, "expiry": F.col("event") + c % 900})
    ids = labels.select("doc_id").where(F.col("doc_id").isNotNull()).distinct()
    owners = known.groupBy("doc_id").agg(F.min("key").alias("key"))
    asks = ids.join(owners, "doc_id", "left").withColumn("t", times(F.col("doc_id"))[3] % 200_000)
    won = point_in_time(asks, versions, ties=("doc_id",), payload=("n_chars", "lang"))
    found = won.select(F.col("doc_id").alias("_id"), "t", F.col("version.doc_id").alias("version_id"), (F.col("t") - F.col("version.event")).alias("age"), F.col("version.n_chars").alias("n"), F.col("version.lang").alias("l"))
    out = labels.select("doc_id").join(found, F.col("doc_id") == F.col("_id"), "left")
    status = F.when(F.col("version_id").isNull(), "none").when(F.col("age") > fresh_for, "stale").otherwise("fresh")
    is_fresh = F.col("status") == "fresh"
    return out.withColumn("status", status).select("doc_id", "t", "version_id", "age", "status", F.when(is_fresh, F.col("n")).alias("n_chars"), F.when(is_fresh, F.col("l")).alias("lang"))
