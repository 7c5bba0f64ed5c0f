"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts of lengths 0 to ORDER, with counts frozen after
training. A byte's probability is that of the longest context in which the language has
seen the byte; each context that has been seen without it costs its escape probability
(method C: as many escapes as distinct bytes), contexts never seen cost nothing, and below
the empty context all bytes are alike. A text's code length in bits under each language is
exact and covers all of its bytes; the shortest wins.

The trees of all languages are laid out as sorted arrays of byte strings (a string is a
context and its next byte), with one column of code lengths for each language, so that a
batch of texts is scored by lookups of all its bytes at once.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quill.llm.runtime import map_arrow, pieces, remainder

ORDER = 3
#: The training sample of a language, at most: texts, and bytes of any one text.
TRAIN_ROWS, TRAIN_BYTES = 400, 1 << 16
#: What stands before the first byte of a text.
PAD = b"\n"


class Lookup:
    """Sorted byte strings of one length (as uint32) and a hash table to find many at once."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(4, int(np.ceil(np.log2(len(keys) + 1))) + 2)
        self.table = np.full(1 << self.bits, -1, dtype=np.int32)
        slots, left, step = self._slots(keys), np.arange(len(keys)), 0
        while len(left):
            at = (slots[left] + step) & (len(self.table) - 1)
            free = self.table[at] < 0
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            first = first[free[first]]
            self.table[at[first]] = left[first]
            left = np.delete(left, first)
            step += 1
        self.probes = step

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(2654435769)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        slots = self._slots(keys)
        rows = self.table[slots]
        out = np.where((rows >= 0) & (self.keys[rows] == keys), rows, -1)
        left = np.flatnonzero((out < 0) & (rows >= 0))
        for step in range(1, self.probes):
            if not len(left):
                break
            rows = self.table[(slots[left] + step) & (len(self.table) - 1)]
            hit = (rows >= 0) & (self.keys[rows] == keys[left])
            out[left[hit]] = rows[hit]
            left = left[~hit & (rows >= 0)]
        return out


def _strings(raw: bytes, n: int) -> np.ndarray:
    """Each byte of raw after the first ORDER pad bytes, with the n - 1 bytes before it, as a number."""
    b = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
    out = np.zeros(len(b) - ORDER, dtype=np.uint32)
    for j in range(n):
        at = ORDER - (n - 1) + j
        out = (out << np.uint32(8)) | b[at : at + len(out)]
    return out


class Model:
    """Code lengths and escapes of all languages for strings of 1 to ORDER + 1 bytes."""

    def __init__(self, samples: dict[str, list[bytes]]):
        self.languages = sorted(samples)
        width = len(self.languages)
        # Texts are apart by ORDER pad bytes; these are themselves not coded.
        coded: list[list[np.ndarray]] = []
        for lang in self.languages:
            raw = PAD * ORDER + (PAD * ORDER).join(t for t in samples[lang] if t)
            coded.append([_strings(raw, n) for n in range(1, ORDER + 2)])
        self.lookups: list[Lookup] = []
        self.bits: list[np.ndarray] = []
        self.contexts: list[Lookup | None] = []
        self.escapes: list[np.ndarray] = []
        below = None
        for n in range(1, ORDER + 2):
            keys = np.unique(np.concatenate([c[n - 1] for c in coded])) if width else np.zeros(0, np.uint32)
            count = np.zeros((len(keys), width))
            for j in range(width):
                own, times = np.unique(coded[j][n - 1], return_counts=True)
                count[np.searchsorted(keys, own), j] = times
            context, of = np.unique(keys >> np.uint32(8), return_inverse=True)
            total = np.zeros((len(context), width))
            kinds = np.zeros((len(context), width))
            np.add.at(total, of, count)
            np.add.at(kinds, of, count > 0)
            seen = total > 0
            escape = np.where(seen, -np.log2(np.where(seen, kinds / np.maximum(total + kinds, 1), 1)), 0.0)
            short = self._lower(below, keys & np.uint32((1 << 8 * (n - 1)) - 1), n - 1) if n > 1 else np.full((len(keys), width), 8.0)
            direct = -np.log2(np.maximum(count, 1) / np.maximum((total + kinds)[of], 1))
            bits = np.where(count > 0, direct, escape[of] + short)
            self.lookups.append(Lookup(keys))
            self.bits.append(bits.astype(np.float32))
            self.contexts.append(Lookup(context.astype(np.uint32)))
            self.escapes.append(escape.astype(np.float32))
            below = n

    def _lower(self, _, keys: np.ndarray, n: int) -> np.ndarray:
        return self.code(keys, n).astype(float)

    def code(self, keys: np.ndarray, n: int) -> np.ndarray:
        """Bits of the last byte of each string of n bytes, for each language."""
        if n == 0:
            return np.full((len(keys), len(self.languages)), 8.0, dtype=np.float32)
        rows = self.lookups[n - 1].find(keys)
        out = self.bits[n - 1][np.maximum(rows, 0)] if len(self.bits[n - 1]) else np.zeros((len(keys), len(self.languages)), np.float32)
        new = np.flatnonzero(rows < 0)
        if len(new):
            rest = keys[new]
            at = self.contexts[n - 1].find(rest >> np.uint32(8)) if len(self.escapes[n - 1]) else np.full(len(rest), -1)
            escape = np.where((at >= 0)[:, None], self.escapes[n - 1][np.maximum(at, 0)], 0) if len(self.escapes[n - 1]) else 0
            out[new] = escape + self.code(rest & np.uint32((1 << 8 * (n - 1)) - 1), n - 1)
        return out

    def lengths(self, texts: list[bytes], most: int = 1 << 19) -> np.ndarray:
        """Code length in bits of each text under each language. Long texts go in stretches that keep their contexts."""
        out = np.zeros((len(texts), len(self.languages)))
        raws = [PAD * ORDER + t for t in texts]
        for a, b in pieces(raws, most):
            if b - a == 1 and len(raws[a]) > most:
                for s in range(ORDER, len(raws[a]), most):
                    out[a] += self.code(_strings(raws[a][s - ORDER : s + most], ORDER + 1), ORDER + 1).sum(axis=0, dtype=float)
                continue
            keys = _strings(b"".join(raws[a:b]), ORDER + 1)
            bits = self.code(keys, ORDER + 1).astype(float)
            ends = np.cumsum([len(r) for r in raws[a:b]])
            total = np.vstack([np.zeros(bits.shape[1]), np.cumsum(bits, axis=0)])
            out[a:b] = total[ends - ORDER] - total[ends - [len(r) for r in raws[a:b]]]
        return out


def fit(docs: DataFrame, learn_from, train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """Trees of all languages, from up to about train_rows texts of each.

    Rows are counted by language first; then about twice train_rows a language are drawn by a
    hash of the id, and the first train_rows of them in its order are learned. Rows without
    text or language and empty texts are not drawn; if too few others were among the drawn, eight
    times as many are, and so on. Of a text of more than train_bytes characters as many from its
    beginning are learned.
    """
    rows = docs.where(learn_from & F.col(lang_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}  # a row a language
    spread = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30))
    learned = F.encode(F.substring(F.col(text_col), 1, train_bytes), "UTF-8")
    texts: dict[str, list[bytes]] = {}
    times, wanted = 2.0, dict(counts)
    while wanted:
        most = {k: min(1 << 30, int((1 << 30) * times * train_rows / n) + 1) for k, n in wanted.items()}
        share = F.create_map(*[F.lit(x) for kv in most.items() for x in kv])
        drawn = rows.where((spread < share[F.col(lang_col)]) & (F.octet_length(text_col) > 0))
        samples: dict[str, list[tuple[int, bytes]]] = {k: [] for k in wanted}
        # The rows that come first in each language's order: a bounded sample.
        first = drawn.select(F.col(lang_col).alias("lang"), learned.alias("raw"), spread.alias("at"))
        first = first.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("at", F.xxhash64("raw")))).where(F.col("n") <= train_rows)
        for r in first.toLocalIterator():
            samples[r["lang"]].append((r["at"], bytes(r["raw"])))
        texts |= {k: [t for _, t in sorted(x)[:train_rows]] for k, x in samples.items()}
        wanted = {k: n for k, n in wanted.items() if len(texts[k]) < train_rows and most[k] < 1 << 30}
        times *= 8
    return Model({k: x for k, x in texts.items() if x})


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, lang_pred, score.

    score is the softmax, over languages, of minus the code lengths, in bits, divided by the
    square root of the text's bytes; ties go to the name that comes first. Null texts and
    texts without a letter are `und` with score 0, as is everything if nothing was learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[id_col]

    def run(batch):
        model, texts = shared.value, batch.column("text").to_pylist()
        known = [i for i, t in enumerate(texts) if t and model.languages and any(map(str.isalpha, t))]
        raws = [texts[i].encode() for i in known]
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        if known:
            bits = model.lengths(raws)
            best = bits.argmin(axis=1)
            gap = (bits - bits.min(axis=1, keepdims=True)) / np.sqrt([[len(r)] for r in raws])
            top = 1 / np.exp2(-gap).sum(axis=1)
            for i, k, s in zip(known, best.tolist(), top.tolist(), strict=True):
                lang[i], score[i] = model.languages[k], s
        yield {"id": batch.column("id"), "lang_pred": lang, "score": score}

    out = map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of docs: id, held_out, lang_pred, score (see identify); learned only from rows that are not held out.

    Rows that repeat have a result each; rows without an id are not held out, and none is
    learned. Texts are read whole, however long. Other columns are not carried.
    """
    held = F.coalesce(remainder(id_col, 3) == 1, F.lit(False))
    model = fit(docs, F.coalesce(remainder(id_col, 3) != 1, F.lit(False)), text_col=text_col, lang_col=lang_col, id_col=id_col)
    return identify(docs, model, id_col, text_col).select(id_col, held.alias("held_out"), "lang_pred", "score")
