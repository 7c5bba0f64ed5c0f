"""Scoring texts with a hashed maximum-entropy language model.

A token's class is predicted by a softmax whose features are hashed: the token before, the pair before, and
skips to the second and third token before; the token is then predicted within its class. Inside a class the only
features are the tokens themselves, whose maximum-entropy solution is their relative frequency, here with the absolute
discount that the numbers of tokens seen once and twice suggest; what is taken from a class's tokens is its
probability of a token never seen. So the probabilities of all known tokens and of one unknown add up to one.

* Counts: one pass over all training texts counts words and, for each spelling key (the first three and last two bytes
  of a word, hashed), the hashed neighbours. Keys with like neighbours make a class (k-means over a table of fixed size).
* Training: in each of ROUNDS rounds every task takes its share of all training texts through mini-batches of AdaGrad,
  from the weights as they stand, and gives back its changes; they are averaged, feature by feature, by how often each
  task saw the feature. A training text is used once.
* Scoring: HEAD frequent words are broadcast (their number and their bytes are bounded); what the texts have besides is
  joined with the vocabulary by a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quill.llm.runtime import checkpoint, fresh, map_arrow, pieces, remainder, texts_of, tune, written

#: Words that are broadcast, at most, and the bytes of each.
HEAD, HEAD_BYTES = 1 << 17, 64
#: Spelling keys (the first is the end's), columns of neighbours on either side, and classes (the first is the end's).
KEYS, COLUMNS, CLASSES = 4096, 64, 24
#: Hashed pairs, and rows of weights: a bias, three places of keys, pairs.
PAIRS = 1 << 14
FEATURES = 1 + 3 * KEYS + PAIRS
ROUNDS, BATCH, RATE = 3, 8192, 0.1
#: Different words that a task holds before it gives them away, and bytes of text taken at once.
HELD, PIECE = 1 << 20, 4 << 20
#: Rows of a table in one block when tables of tasks are added up.
BLOCK_ROWS = 1024
END = b"\n"

_INSIDE = np.ones(256, dtype=bool)
_INSIDE[[0x20, *range(0x09, 0x0E)]] = False


def spelling_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """1 to KEYS - 1 for each word data[start:end]: words of up to five bytes by all of them, others by their first three and last two."""
    last = ends - 1
    out = np.minimum(ends - starts, 6).astype(np.uint64)
    for at in (starts, np.minimum(starts + 1, last), np.minimum(starts + 2, last), np.maximum(last - 1, starts), last):
        out = (out << np.uint64(8)) | data[at]
    out = (out ^ (out >> np.uint64(23))) * np.uint64(0x9E3779B97F4A7C15)
    return (1 + (out >> np.uint64(32)) % np.uint64(KEYS - 1)).astype(np.int64)


class Stream:
    """The tokens of texts one after the other, an end after each text: the word of each (or -1), its key, its text and its place there."""

    def __init__(self, texts: list[bytes | None]):
        lowered = [(t or b"").lower() for t in texts]
        data = np.frombuffer(b"\n".join(lowered) + b"\n", dtype=np.uint8)
        inside = _INSIDE[data]
        edges = np.flatnonzero(np.diff(inside, prepend=False))
        starts, ends = edges[::2], edges[1::2]
        offsets = np.concatenate([[0], np.cumsum(ends - starts)])
        self.words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[inside])])
        bounds = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in lowered]))
        count = np.diff(bounds) + 1
        self.text = np.repeat(np.arange(len(texts)), count)
        first = np.cumsum(count) - count
        self.place = np.arange(len(self.text)) - first[self.text]
        self.word = np.full(len(self.text), -1)
        is_end = self.place == (count - 1)[self.text]
        self.word[~is_end] = np.arange(len(starts))
        self.key = np.zeros(len(self.text), dtype=np.int64)
        self.key[~is_end] = spelling_keys(data, starts, ends)

    def before(self, gap: int) -> np.ndarray:
        """The key of the token gap places before each, the end's where the text has none."""
        out = np.zeros_like(self.key)
        out[gap:] = self.key[:-gap]
        out[self.place < gap] = 0
        return out

    def features(self) -> list[np.ndarray]:
        """Rows of the table of weights that each token's context has, the bias apart."""
        one, two, three = (self.before(g) for g in (1, 2, 3))
        pair = (((two * KEYS + one).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)).astype(np.int64)
        return [1 + one, 1 + KEYS + two, 1 + 2 * KEYS + three, 1 + 3 * KEYS + pair]


def softmax(weights: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """Probabilities of all classes, a row for each context."""
    out = weights[rows[0]] + weights[0]
    for at in rows[1:]:
        out += weights[at]
    out -= out.max(axis=1, keepdims=True)
    np.exp(out, out=out)
    out /= out.sum(axis=1, keepdims=True)
    return out


class Learner:
    """Mini-batches of AdaGrad over a copy of the weights."""

    def __init__(self, weights: np.ndarray, rate: float = RATE):
        self.weights, self.rate = weights.copy(), rate
        self.squares = np.ones_like(weights)
        self.seen = np.zeros(len(weights), dtype=np.float32)

    def step(self, rows: list[np.ndarray], target: np.ndarray) -> None:
        slope = softmax(self.weights, rows)
        slope[np.arange(len(target)), target] -= 1
        for at in rows:
            order = np.argsort(at.astype(np.uint16), kind="stable")  # FEATURES fit in 16 bits, which sort fast
            own = at[order]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            self._move(own[first], np.add.reduceat(slope[order], first, axis=0), np.diff(first, append=len(own)).astype(np.float32))
        self._move(np.zeros(1, dtype=np.int64), slope.sum(axis=0, keepdims=True), np.array([len(target)], dtype=np.float32))

    def _move(self, at: np.ndarray, slope: np.ndarray, times: np.ndarray) -> None:
        slope /= np.sqrt(times)[:, None]
        squares = self.squares[at] + slope * slope
        self.squares[at] = squares
        slope *= self.rate
        slope /= np.sqrt(squares, out=squares)
        self.weights[at] -= slope
        self.seen[at] += times


def _add_up(df: DataFrame, columns: list[str]) -> dict[int, list[np.ndarray]]:
    """Sums of float32 tables that tasks give away block by block (block int, and a binary for each of columns); of the size of one table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for block, *cells in zip(*(batch.column(c).to_pylist() for c in ("block", *columns)), strict=True):
                own = total.setdefault(block, [np.zeros(len(c) // 4) for c in cells])
                for a, c in zip(own, cells, strict=True):
                    a += np.frombuffer(c, dtype=np.float32)
        if total:
            yield pa.RecordBatch.from_pydict({"block": pa.array(list(total), pa.int32())} | {c: pa.array([t[i].tobytes() for t in total.values()], pa.binary()) for i, c in enumerate(columns)})

    out = df.select("block", *columns).repartition("block").mapInArrow(run, "block int, " + ", ".join(f"{c} binary" for c in columns))
    return {r[0]: [np.frombuffer(x) for x in r[1:]] for r in out.collect()}


def _blocks(*tables: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    for b in range(0, len(tables[0]), BLOCK_ROWS):
        yield b // BLOCK_ROWS, [np.ascontiguousarray(t[b : b + BLOCK_ROWS], dtype=np.float32).tobytes() for t in tables]


def gather(texts: DataFrame) -> DataFrame:
    """From all texts: rows (word, n), a word may have several, and blocks of the table of keys and neighbours."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64()), ("block", pa.int32()), ("cells", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = np.zeros(KEYS * 2 * COLUMNS, dtype=np.float64)
        ends = 0
        held: list[pa.Table] = []

        def counted() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

        def rows(words: pa.Array | pa.ChunkedArray, n: pa.Array | pa.ChunkedArray) -> Iterator[pa.RecordBatch]:
            table = pa.table({"word": words, "n": n})
            table = table.append_column("block", pa.nulls(table.num_rows, pa.int32())).append_column("cells", pa.nulls(table.num_rows, pa.binary()))
            yield from table.cast(schema).to_batches(max_chunksize=50_000)

        for batch in batches:
            whole = texts_of(batch)
            for a, b in pieces(whole, PIECE):
                stream = Stream(whole[a:b])
                ends += b - a
                counts = pc.value_counts(stream.words)
                held.append(pa.table({"word": counts.field(0), "n": counts.field(1)}))
                one = stream.before(1)
                after = np.zeros_like(one)
                after[:-1] = stream.key[1:]
                for side, of in ((0, one), (1, after)):
                    near += np.bincount(stream.key * (2 * COLUMNS) + side * COLUMNS + of % COLUMNS, minlength=len(near))
            if sum(t.num_rows for t in held) > HELD:
                held = [counted()]
                if held[0].num_rows > HELD // 2:
                    yield from rows(held[0].column("word"), held[0].column("n"))
                    held = []
        if held:
            table = counted()
            yield from rows(table.column("word"), table.column("n"))
        if ends:
            yield from rows(pa.array([END]), pa.array([ends]))
            own = [(block, cells) for block, (cells,) in _blocks(near.reshape(KEYS, -1))]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(own), pa.binary()), pa.nulls(len(own), pa.int64()), pa.array([x[0] for x in own], pa.int32()), pa.array([x[1] for x in own], pa.binary())], schema=schema)

    tune(texts.sparkSession)
    return texts.mapInArrow(run, "word binary, n long, block int, cells binary")


def classes(near: np.ndarray, rounds: int = 20, seed: int = 42) -> np.ndarray:
    """A class for each key, by k-means over the square roots of the neighbours' shares, weighted by how often keys occur; the end has class 0 for itself."""
    mass = near.sum(axis=1)
    points = np.sqrt(near / np.maximum(mass, 1)[:, None])
    out = np.ones(KEYS, dtype=np.int64)
    out[0] = 0
    live = np.flatnonzero((mass > 0) & (np.arange(KEYS) > 0))
    if not len(live):
        return out
    x, m = points[live], mass[live]
    # Each centre is drawn by mass and distance to those before.
    rng = np.random.default_rng(seed)
    centres = [x[mass[live].argmax()]]
    gap = ((x - centres[0]) ** 2).sum(axis=1)
    while len(centres) < min(CLASSES - 1, len(live)) and (gap * mass[live]).sum() > 0:
        centres.append(x[rng.choice(len(x), p=gap * mass[live] / (gap * mass[live]).sum())])
        gap = np.minimum(gap, ((x - centres[-1]) ** 2).sum(axis=1))
    c = np.array(centres)
    for _ in range(rounds):
        near_to = (x @ c.T * 2 - (c * c).sum(axis=1)).argmax(axis=1)
        for k in range(len(c)):
            if (near_to == k).any():
                c[k] = np.average(x[near_to == k], axis=0, weights=m[near_to == k])
    out[live] = 1 + near_to
    return out


@dataclass
class Model:
    """Everything that scoring reads except the words beyond the head; of a size that parameters bound."""

    head: list[bytes]
    head_n: np.ndarray
    key_class: np.ndarray
    weights: np.ndarray
    mass: np.ndarray  # tokens of each class
    kinds: np.ndarray  # different ones
    discount: np.ndarray  # of each class
    tokens: int
    vocabulary: int

    def unknown(self) -> np.ndarray:
        """Each class's share of tokens never seen."""
        return self.discount * self.kinds / np.maximum(self.mass, 1)

    def inside(self, n: np.ndarray, of: np.ndarray) -> np.ndarray:
        """log10 of a known token's share of its class."""
        return np.log10(np.maximum(n - self.discount[of], 1e-300) / np.maximum(self.mass[of], 1))


def _classified(vocabulary: DataFrame, key_class: np.ndarray) -> DataFrame:
    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        words = batch.column("word").cast(pa.large_binary())
        at = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)
        is_end = pc.equal(words, pa.scalar(END, pa.large_binary())).to_numpy(zero_copy_only=False)
        yield {"cls": np.where(is_end, 0, key_class[spelling_keys(data, at[:-1], at[1:])]), "n": batch.column("n")}

    return map_arrow(vocabulary, run, "cls int, n long")


def fit(docs: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """The model, and the vocabulary (word, n) of all texts for which learn_from holds; rows are dealt to rounds by a hash of the id."""
    spark = docs.sparkSession
    col = lambda c: docs[f"`{c.replace('`', '``')}`"]
    texts = docs.where(learn_from).select(col(text_col).alias("text"), F.pmod(F.xxhash64(col(id_col).cast("string"), F.lit(11)), F.lit(rounds)).alias("round"))
    found = written(gather(texts.select("text")))
    vocabulary = written(found.where(F.col("word").isNotNull()).groupBy("word").agg(F.sum("n").alias("n")))
    near = np.zeros((KEYS, 2 * COLUMNS))
    for block, (cells,) in _add_up(found.where(F.col("block").isNotNull()), ["cells"]).items():
        own = cells.reshape(-1, 2 * COLUMNS)
        near[block * BLOCK_ROWS : block * BLOCK_ROWS + len(own)] = own
    key_class = classes(near)

    mass, kinds, once, twice = np.zeros((4, CLASSES))
    for r in _classified(vocabulary, key_class).groupBy("cls").agg(F.sum("n"), F.count("*"), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).collect():
        mass[r[0]], kinds[r[0]], once[r[0]], twice[r[0]] = r[1:]
    discount = np.clip((once + 1) / (once + 2 * twice + 2), 0.05, 0.95)
    discount[0] = 0.0
    head = vocabulary.where(F.octet_length("word") <= HEAD_BYTES).orderBy(F.desc("n"), "word").limit(HEAD).toArrow()

    weights = np.zeros((FEATURES, CLASSES), dtype=np.float32)
    weights[0] = np.log(np.maximum(mass, 1e-9) / max(mass.sum(), 1)).clip(-30)  # classes without a token stay out
    for k in range(rounds if mass.sum() else 0):
        weights = _round(texts.where(F.col("round") == k), weights, key_class)
    return Model(head.column("word").to_pylist(), head.column("n").to_numpy(), key_class, weights, mass, kinds, discount, int(mass.sum()), int(kinds.sum())), vocabulary


def _round(texts: DataFrame, weights: np.ndarray, key_class: np.ndarray) -> np.ndarray:
    """The weights after every task's pass over its share of the texts."""
    shared = texts.sparkSession.sparkContext.broadcast((weights, key_class))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, key_class = shared.value
        learner = Learner(start)
        for batch in batches:
            whole = texts_of(batch)
            for a, b in pieces(whole, PIECE):
                stream = Stream(whole[a:b])
                rows, target = stream.features(), key_class[stream.key]
                for i in range(0, len(target), BATCH):
                    learner.step([r[i : i + BATCH] for r in rows], target[i : i + BATCH])
        if learner.seen[0]:
            moved = (learner.weights - start) * learner.seen[:, None]
            own = list(_blocks(moved, learner.seen))
            yield pa.RecordBatch.from_pydict({"block": pa.array([x[0] for x in own], pa.int32()), "moved": pa.array([x[1][0] for x in own], pa.binary()), "seen": pa.array([x[1][1] for x in own], pa.binary())})

    tune(texts.sparkSession)
    out = weights.copy()
    for block, (moved, seen) in _add_up(texts.select("text").mapInArrow(run, "block int, moved binary, seen binary"), ["moved", "seen"]).items():
        at = slice(block * BLOCK_ROWS, block * BLOCK_ROWS + len(seen))
        out[at] += (moved.reshape(len(seen), -1) / np.maximum(seen, 1)[:, None]).astype(np.float32)
    shared.destroy()
    return out


def _log(p: np.ndarray) -> np.ndarray:
    return np.log10(np.maximum(p, 1e-30, dtype=np.float64))


def scored(docs: DataFrame, model: Model, id_col: str, text_col: str) -> DataFrame:
    """For each row what the head decides, its other words taken as unknown: r, id, n_tokens, n_known, base, score; rare: those words, each with its times, its class, and what is added to score if it is known."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    col = lambda c: docs[f"`{c.replace('`', '``')}`"]
    kind = dict(docs.dtypes)[id_col]

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        m = shared.value
        values = pa.array(m.head, pa.large_binary())
        unknown, whole = m.unknown(), texts_of(batch)
        log_n = np.log10(m.head_n + 1.0)
        end = next((i for i, w in enumerate(m.head) if w == END), -1)
        for a, b in pieces(whole, PIECE):
            s, n = Stream(whole[a:b]), b - a
            coded = s.words.dictionary_encode()
            of_word = pc.fill_null(pc.index_in(coded.dictionary, values), -1).to_numpy().astype(np.int64)
            code = coded.indices.to_numpy().astype(np.int64)
            place = np.full(len(s.word), end)
            is_word = s.word >= 0
            place[is_word] = of_word[code]
            of = m.key_class[s.key]
            own, other = np.empty(len(of)), np.empty(len(of))
            rows = s.features()
            for i in range(0, len(of), BATCH):
                p = softmax(m.weights, [r[i : i + BATCH] for r in rows])
                own[i : i + BATCH] = _log(p[np.arange(len(p)), of[i : i + BATCH]])
                other[i : i + BATCH] = _log(p @ unknown.astype(np.float32))
            known = place >= 0
            at = np.maximum(place, 0)
            part = np.where(known, own + m.inside(m.head_n[at], of), other) if len(m.head) else np.zeros(len(of))
            base = np.where(known, log_n[at], 0.0) if len(m.head) else np.zeros(len(of))
            # The rare words of a text, each once.
            rare = np.flatnonzero(~known & is_word)
            key, inverse, times = np.unique(s.text[rare] * max(1, len(coded.dictionary)) + code[s.word[rare]], return_inverse=True, return_counts=True)
            gain = np.bincount(inverse, (own - other)[rare], len(key))
            text, word = key // max(1, len(coded.dictionary)), key % max(1, len(coded.dictionary))
            cls = np.zeros(len(key), dtype=np.int32)
            cls[inverse] = of[rare]
            offsets = np.searchsorted(text, np.arange(n + 1)).astype(np.int32)
            entry = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(word)).cast(pa.binary()), pa.array(times.astype(np.int64)), pa.array(cls), pa.array(gain)], ["word", "times", "cls", "gain"])
            yield {
                "id": batch.column("id").slice(a, n), "n_tokens": np.bincount(s.text, minlength=n), "n_known": np.bincount(s.text, known, n).astype(np.int64),
                "base": np.bincount(s.text, base, n), "score": np.bincount(s.text, part, n), "rare": pa.ListArray.from_arrays(pa.array(offsets), entry),
            }

    out = map_arrow(docs.select(col(id_col).alias("id"), col(text_col).alias("text")), run, f"id {kind}, n_tokens long, n_known long, base double, score double, rare array<struct<word:binary,times:long,cls:int,gain:double>>")
    return out.withColumn("r", F.monotonically_increasing_id())


def score(docs: DataFrame, model: Model, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_tokens, n_known, base_score, score; the latter two are log10 probabilities of the whole text under add-one counts and under the model."""
    rows = written(scored(docs, model, id_col, text_col))
    rare = rows.select("r", F.explode("rare").alias("x")).select("r", "x.word", "x.times", "x.cls", "x.gain")
    share = F.lit([float(x) for x in np.log10(np.maximum(model.mass, 1))])[F.col("cls")]
    discount = F.lit([float(x) for x in model.discount])[F.col("cls")]
    met = rare.join(vocabulary, "word")  # a word that no training text has adds nothing
    more = met.select("r", "times", (F.col("times") * F.log10(F.col("n") + 1.0)).alias("b"), (F.col("gain") + F.col("times") * (F.log10(F.col("n") - discount) - share)).alias("s"))
    more = more.groupBy("r").agg(F.sum("times").alias("times"), F.sum("b").alias("b"), F.sum("s").alias("s"))
    every = float(np.log10(model.tokens + model.vocabulary + 1))
    plus = lambda c, d: F.col(c) + F.coalesce(F.col(d), F.lit(0))
    out = rows.drop("rare").join(more.withColumnsRenamed({"b": "b2", "s": "s2"}), "r", "left")
    return out.select(F.col("id").alias(id_col), "n_tokens", plus("n_known", "times").alias("n_known"), (plus("base", "b2") - F.col("n_tokens") * every).alias("base_score"), plus("score", "s2").alias("score"))


def lm_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from every row whose id's crc32 modulo 7 is not 2; rows without an id are not held out, and none is
    learned. Null texts are empty: an end alone. Texts are scored whole, rows that repeat have a row
    each, other columns are not read. If nothing is learned all tokens are unknown and certain, and scores are 0.
    """
    other = remainder(id_col, 7)
    model, vocabulary = fit(docs, F.coalesce(other != 2, F.lit(False)), id_col, text_col)
    out = score(docs, model, vocabulary, id_col, text_col)
    return out.select(id_col, F.coalesce(other == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
