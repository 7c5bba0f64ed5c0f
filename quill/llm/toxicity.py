"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the words, pairs of neighbours, and pairs that skip one word, hashed
into 2**BITS places; each counts once a text, however often it occurs. Training follows the
per-coordinate rates of FTRL-proximal, whose L1 term leaves few weights; those are what is
broadcast. The sample of labelled rows is bounded by TRAIN_ROWS rows of at most TRAIN_BYTES
bytes each; scoring covers all texts whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quill.llm.runtime import checkpoint, map_arrow, pieces, remainder, texts_of
from quill.llm.words import Words, run_weights

BITS = 18
TRAIN_ROWS, TRAIN_BYTES = 16_000, 1 << 16
#: Labelled ids drawn for each row of the sample, since some have no text or too long a one.
DRAWN = 2
THRESHOLD = 0.3


def features(words: Words, bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(text, place) of every unigram, bigram and skip-bigram, with repeats."""
    h, text = words.hashes, words.text
    shift, weights = np.uint64(64 - bits), run_weights(3)
    out = [(text, (h >> shift).astype(np.int64))]
    for gap in (1, 2):
        if len(h) > gap:
            pair = h[:-gap] * weights[0] + h[gap:] * weights[gap]
            same = text[:-gap] == text[gap:]
            out.append((text[:-gap][same], (pair[same] >> shift).astype(np.int64)))
    return out


def feature_sets(words: Words, n: int, bits: int = BITS) -> list[np.ndarray]:
    """The distinct places of each of n texts."""
    parts = features(words, bits)
    key = np.unique(np.concatenate([(t.astype(np.int64) << bits) | p for t, p in parts]))
    cuts = np.searchsorted(key, np.arange(1, n, dtype=np.int64) << bits)
    return [x & ((1 << bits) - 1) for x in np.split(key, cuts)]


@dataclass(frozen=True)
class Ftrl:
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 1.0
    epochs: int = 4
    bits: int = BITS

    def train(self, rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, float]:
        """Weights and intercept; rows in their order, epoch after epoch."""
        z = np.zeros(1 << self.bits)
        n = np.zeros(1 << self.bits)
        rate = float(labels.mean()) if len(labels) else 0.0
        bias = float(np.log(min(max(rate, 1e-4), 1 - 1e-4) / (1 - min(max(rate, 1e-4), 1 - 1e-4))))
        bias_n = 0.0
        for _ in range(self.epochs):
            for at, y in zip(rows, labels.tolist(), strict=True):
                za, na = z[at], n[at]
                root = np.sqrt(na)
                w = np.where(np.abs(za) <= self.l1, 0.0, -(za - np.sign(za) * self.l1) / ((self.beta + root) / self.alpha + self.l2))
                p = 1.0 / (1.0 + np.exp(-min(35.0, max(-35.0, bias + float(w.sum())))))
                g = p - y
                sigma = (np.sqrt(na + g * g) - root) / self.alpha
                z[at] = za + g - sigma * w
                n[at] = na + g * g
                bias_n += g * g
                bias -= 0.05 * g / (1.0 + np.sqrt(bias_n))
        w = np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))
        return w, bias


def fit(docs: DataFrame, labels: DataFrame, learn_from, config: Ftrl = Ftrl(), train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"):
    """Sparse weights (places, values) and intercept, from labelled rows for which learn_from holds.

    Ids that have a label and a document are drawn by a hash, DRAWN times train_rows at most;
    of their rows, rows without text and of more than train_bytes bytes are left out, and of the
    others train_rows at most, by a hash of id and text, are learned, equal rows as one. An id with
    several labels has the largest. Without any row the model is constant.
    """
    known = labels.where(learn_from & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    known = known.groupBy("_id").agg(F.max("_y").alias("_y"))
    # Only ids travel until some are drawn; those are a broadcast of bounded size, and only their rows are hashed.
    there = known.join(docs.where(learn_from).select(F.col(id_col).alias("_id")), "_id", "left_semi")
    few = there.orderBy(F.xxhash64("_id"), "_id").limit(DRAWN * train_rows)
    rows = docs.where(learn_from & F.col(text_col).isNotNull() & (F.octet_length(text_col) <= train_bytes))
    rows = rows.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(few), "_id").withColumns({"h": F.xxhash64("_id", "text"), "r": F.monotonically_increasing_id()})
    bits = config.bits

    def sets(batch):
        texts = texts_of(batch)
        for a, b in pieces(texts):
            yield {"h": batch.column("h").slice(a, b - a), "r": batch.column("r").slice(a, b - a), "y": batch.column("_y").slice(a, b - a), "at": [x.astype(np.int32) for x in feature_sets(Words(texts[a:b]), b - a, bits)]}

    def learn(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        first = table.column("at").combine_chunks()
        flat, ends = first.values.to_numpy(), first.offsets.to_numpy()
        rows = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        order = np.lexsort((table.column("y").to_numpy(), table.column("h").to_numpy()))
        w, bias = config.train([rows[i] for i in order], table.column("y").to_numpy()[order].astype(float))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_pydict({"at": pa.array([at.tolist()], pa.list_(pa.int64())), "w": pa.array([w[at].tolist()], pa.list_(pa.float64())), "bias": [bias]})

    # The bounded sample meets in one task, which gives back the weights that are not zero.
    hashed = checkpoint(map_arrow(rows, sets, "h long, r long, y int, at array<int>"))
    chosen = hashed.groupBy("h", "y").agg(F.min("r").alias("r")).orderBy("h", "y").limit(train_rows).select("r")
    sample = hashed.join(F.broadcast(chosen), "r")
    model = sample.coalesce(1).mapInArrow(learn, "at array<long>, w array<double>, bias double").collect()
    if not model:
        return np.zeros(0, dtype=np.int64), np.zeros(0), -2.0
    return np.array(model[0].at, dtype=np.int64), np.array(model[0].w), model[0].bias


def score(docs: DataFrame, model, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, score_col: str = "score") -> DataFrame:
    """Adds score_col (0 to 1) to the id, or to the columns named by keep; null and empty texts have the intercept's score."""
    at, w, bias = model
    dense = np.zeros(1 << bits, dtype=np.float32)
    dense[at] = w
    shared = docs.sparkSession.sparkContext.broadcast(dense)  # 2**bits numbers, whatever the corpus
    names = keep or [id_col]
    sent = ["text" if c == text_col else f"c{i}" for i, c in enumerate(names)]  # the text travels once
    rows = docs.select(*[F.col(f"`{c}`").alias(s) for c, s in zip(names, sent, strict=True) if s != "text"], F.col(text_col).alias("text"))
    kinds = dict(docs.dtypes)

    def run(batch):
        weights, texts = shared.value, texts_of(batch)
        for a, b in pieces(texts):
            total = np.full(b - a, bias)
            places = []
            for text, place in features(Words(texts[a:b]), bits):
                used = weights[place] != 0
                places.append((text[used].astype(np.int64) << bits) | place[used])
            key = np.unique(np.concatenate(places))
            np.add.at(total, key >> bits, weights[key & ((1 << bits) - 1)])
            yield {f"c{i}": batch.column(s).slice(a, b - a) for i, s in enumerate(sent)} | {"score": 1 / (1 + np.exp(-np.clip(total, -35, 35)))}

    out = map_arrow(rows, run, "".join(f"c{i} {kinds[c]}, " for i, c in enumerate(names)) + "score double")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("score").alias(score_col))


def toxicity(docs: DataFrame, labels: DataFrame, config: Ftrl = Ftrl(), threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, held_out, score, predicted. Labels are learned only from rows that are not held out.

    Null and empty texts have the intercept's score. Rows that repeat have a result each; rows
    without an id are not held out, and none is learned. Texts are scored whole, however long.
    Other columns are not carried.
    """
    learn = F.coalesce(remainder(id_col, 4) != 2, F.lit(False))
    model = fit(docs, labels, learn, config, id_col=id_col, text_col=text_col)
    out = score(docs, model, config.bits, id_col, text_col)
    held = F.coalesce(remainder(id_col, 4) == 2, F.lit(False))
    return out.select(id_col, held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
