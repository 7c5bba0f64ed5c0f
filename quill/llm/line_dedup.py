"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of two neighbouring lines chooses where a chunk ends, so that
lines inserted or taken away elsewhere don't move boundaries. A long line (LONG words or
more) is a chunk by itself. Chunks of several lines, or of one long line, that stand in more
than one place are found by their hash; the bytes of each are compared with those of the
first place (by id, text, line), and equal ones are removed everywhere but there.

With runs, every least run of whole lines that comes to LONG words is taken as well, from each
line on and back from each line. What stands in such a run depends on its own lines only, so a
repeated passage of LONG words or more goes whole, wherever it begins and however short its
lines are. Runs overlap: a line goes if an equal line at an earlier place stands for it, so the
first copy of each line stays. Runs are compared by SHA-256 of their lines' SHA-256.

Only hashes and places are shuffled; chunks' texts travel only for hashes that repeat. Lists
of places by document join the documents by a broadcast while they are measured to be under
BROADCAST_BYTES, by a shuffle beyond it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quill.llm.runtime import checkpoint, map_arrow, side, tune

#: Words of a line that is a chunk by itself; least words of a chunk of several lines; one in how many lines ends a chunk.
LONG, LEAST, DIVISOR = 25, 8, 2
BROADCAST_BYTES = 32 << 20


def chunks(text: str | None, long: int = LONG, least: int = LEAST, divisor: int = DIVISOR) -> list[tuple[int, int, str]]:
    """(first line, lines, text) of the chunks that may be removed if they repeat."""
    out = []
    if not text:
        return out
    lines = text.split("\n")
    start, words, before = 0, 0, 0

    def close(stop: int) -> None:
        if stop > start and (words >= long or stop - start > 1 and words >= least):
            out.append((start, stop - start, "\n".join(lines[start:stop])))

    for i, line in enumerate(lines):
        n = len(line.encode().split())
        if n >= long:
            close(i)
            start, words = i, n
            close(i + 1)
            start, words, before = i + 1, 0, 0
            continue
        own = int(hashlib.md5(line.encode()).hexdigest()[:8], 16)
        words += n
        if (own + 31 * before) % divisor == 0:
            close(i + 1)
            start, words = i + 1, 0
        before = own
    close(len(lines))
    return out


def runs(text: str | None, long: int = LONG) -> list[tuple[int, int]]:
    """(first line, lines) of the least runs of lines that come to long words, from each line that has words on and back from each."""
    if not text:
        return []
    counts = [len(line.encode().split()) for line in text.split("\n")]
    out = set()
    stop, words = 0, 0  # words: of the lines from i up to stop
    for i, n in enumerate(counts):
        while words < long and stop < len(counts):
            words += counts[stop]
            stop += 1
        if words < long:
            break
        if n:
            out.add((i, stop - i))
        words -= n
    start, words = 0, 0  # words: of the lines from start up to i
    for i, n in enumerate(counts):
        words += n
        while words - counts[start] >= long:
            words -= counts[start]
            start += 1
        if n and words >= long:
            out.add((start, i + 1 - start))
    return sorted(out)


def run_digests(text: str, spans: list[tuple[int, int]]) -> list[bytes]:
    """SHA-256 of the SHA-256 of the lines of each span (first line, lines)."""
    lines = [hashlib.sha256(line.encode()).digest() for line in text.split("\n")]
    return [hashlib.sha256(b"".join(lines[a : a + n])).digest() for a, n in spans]


def chunk_hash(text: str) -> int:
    return int.from_bytes(hashlib.md5(text.encode()).digest()[:8], "little", signed=True)


def line_dedup(docs: DataFrame, long: int = LONG, least: int = LEAST, divisor: int = DIVISOR, id_col: str = "doc_id", text_col: str = "text", removed_col: str = "n_lines_removed", with_runs: bool = False) -> DataFrame:
    """All columns of docs with text_col replaced, and removed_col (long).

    Null text stays null, a text of which all goes becomes empty. Rows of equal id and text
    are one document: what one keeps, all keep. Null ids come before all others. Columns that
    docs has stay as they are; if it has removed_col itself, the new one replaces it.
    with_runs: runs of long words are taken beside the chunks, whatever lines they are made of.
    """
    tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]

    def places(batch):
        at, first, count, hashes = [], [], [], []
        for i, t in enumerate(batch.column("text").to_pylist()):
            found = chunks(t, long, least, divisor)
            spans = [(a, n) for a, n, _ in found]
            if with_runs:
                spans = sorted({*spans, *runs(t, long)})
                hashes += [int.from_bytes(d[:8], "little", signed=True) for d in run_digests(t or "", spans)]
            else:
                hashes += [chunk_hash(text) for *_, text in found]
            at += [i] * len(spans)
            first += [a for a, _ in spans]
            count += [n for _, n in spans]
        yield {"id": batch.column("id").take(pa.array(at, pa.int64())), "th": batch.column("th").take(pa.array(at, pa.int64())), "line": first, "n": count, "h": hashes}

    found = checkpoint(map_arrow(rows, places, f"id {kind}, th long, line int, n int, h long"))
    place = F.struct("id", "th", "line")
    repeated = found.groupBy("h").agg(F.count(F.lit(1)).alias("times"), F.min(place).alias("first")).where("times > 1")
    # Places of repeated hashes; the first place's text is what the others are compared with.
    met = found.join(side(repeated.select("h", "first")), "h").withColumn("is_first", place.eqNullSafe(F.col("first"))).drop("first")
    by_doc = checkpoint(met.groupBy("id", "th").agg(F.collect_set(F.struct("line", "n", "h", "is_first")).alias("met")))
    key = lambda df: df.select(F.col("id").alias("_id"), F.col("th").alias("_th"), *[c for c in df.columns if c not in ("id", "th")])

    def of(left: DataFrame, right: DataFrame, how: str, bytes_) -> DataFrame:
        # Ids may be null: the hash joins, and the id is compared null-safely.
        right = key(right)
        n = right.agg(F.sum(bytes_)).first()[0] or 0
        right = F.broadcast(right) if n <= BROADCAST_BYTES else right
        return left.join(right, (left["th"] == right["_th"]) & left["id"].eqNullSafe(right["_id"]), how).drop("_id", "_th")

    held = of(rows.where(F.col("text").isNotNull()), by_doc, "inner", F.size("met").cast("long") * 32 + 64)

    def texts(batch):
        out = {c: [] for c in ("at", "line", "n", "h", "is_first", "text")}
        for i, (t, met) in enumerate(zip(batch.column("text").to_pylist(), batch.column("met").to_pylist(), strict=True)):
            lines = t.split("\n")
            for m in met:
                out["at"].append(i)
                for c in ("line", "n", "h", "is_first"):
                    out[c].append(m[c])
                if not with_runs:
                    out["text"].append("\n".join(lines[m["line"] : m["line"] + m["n"]]))
            if with_runs:  # runs overlap, so their digests travel
                out["text"] += [d.hex() for d in run_digests(t, [(m["line"], m["n"]) for m in met])]
        at = pa.array(out.pop("at"), pa.int64())
        yield out | {"id": batch.column("id").take(at), "th": batch.column("th").take(at)}

    bodies = checkpoint(map_arrow(held, texts, f"id {kind}, th long, line int, n int, h long, is_first boolean, text string"))
    more = [F.min(place).alias("first")] if with_runs else []
    firsts = bodies.where("is_first").groupBy("h").agg(F.min("text").alias("first_text"), *more)
    equal = bodies.where("not is_first").join(checkpoint(firsts), "h").where("text = first_text")
    if with_runs:  # a run that overlaps its own first place goes only beyond it
        beyond = F.col("first.line") + F.col("n")
        over = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th")) & (F.col("line") < beyond)
        equal = equal.select("id", "th", F.when(over, beyond).otherwise(F.col("line")).alias("line"), F.when(over, F.col("line") - F.col("first.line")).otherwise(F.col("n")).alias("n"))
    else:
        equal = equal.select("id", "th", "line", "n")
    gone = checkpoint(equal.groupBy("id", "th").agg(F.collect_set(F.struct("line", "n")).alias("gone")))
    names = [c for c in docs.columns if c != removed_col]
    left = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    joined = of(left, gone, "left", F.size("gone").cast("long") * 16 + 64).select("row", "gone")
    flat = joined.select(*[F.col(f"row.`{c}`").alias(c if c == text_col else f"_{i}") for i, c in enumerate(names)], F.col("gone").alias("_gone"))
    schema = flat.drop("_gone").withColumn("_removed", F.lit(0).cast("long")).schema

    def run(batches):
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            removed = [0] * len(texts)
            for i, gone in enumerate(batch.column("_gone").to_pylist()):
                if gone:
                    lines = texts[i].split("\n")
                    keep = np.ones(len(lines), dtype=bool)
                    for g in gone:
                        keep[g["line"] : g["line"] + g["n"]] = False
                    removed[i] = int((~keep).sum())
                    texts[i] = "\n".join(x for x, k in zip(lines, keep.tolist(), strict=True) if k)
            columns = [pa.array(texts, f.type) if f.name == text_col else batch.column(f.name) for f in batch.schema if f.name != "_gone"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(removed, pa.int64())], names=[f.name for f in batch.schema if f.name != "_gone"] + ["_removed"])

    out = flat.mapInArrow(run, schema)
    return out.select(*[(F.col(text_col) if c == text_col else F.col(f"_{i}")).alias(c) for i, c in enumerate(names)], F.col("_removed").alias(removed_col))
