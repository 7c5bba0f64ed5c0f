"""The join by Jaccard similarity against all pairs, with hot keys cut into chunks."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quill.llm import jaccard, simhash
from quill.llm.runtime import cells_of


def family(rng, n, words, share):
    """Texts that have a share of a passage in common, and some close copies of one another."""
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for k in range(words):
            if rng.random() > share:
                own[k] = f"v{rng.randint(0, 10**6)}"
        out.append(own)
        if rng.random() < 0.3:
            close = list(own)
            close[rng.randrange(words)] = f"u{rng.randint(0, 10**6)}"
            out.append(close)
    return [" ".join(x) for x in out]


@pytest.mark.parametrize("cell", [jaccard.CELL, 8])
def test_classes_are_those_of_all_pairs(spark, cell):
    rng = random.Random(cell)
    texts = [t for args in ((60, 120, 0.992), (40, 60, 0.97), (20, 200, 0.995)) for t in family(rng, *args)] + ["", None, "a b", "a b"]
    rng.shuffle(texts)
    sets = [frozenset(simhash.shingle_hashes((t or "").encode(), 5).tolist()) for t in texts]
    prints = [simhash.fingerprint(simhash.shingle_hashes((t or "").encode())) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 or sets[i] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.representatives(df, similarity=0.8, set_cell=cell).collect()}
    assert kept == {find(i) for i in range(len(texts))}
    assert 10 < len(kept) < 0.8 * len(texts)


def test_cells_are_whole_over_batches():
    rng = np.random.default_rng(3)
    keys = np.sort(rng.integers(0, 40, 500)).astype(np.int64)
    table = pa.table({"k": keys, "v": np.arange(500)})
    for size in (1, 7, 100, 500):
        batches = table.to_batches(max_chunksize=size) + table.slice(0, 0).to_batches()
        seen = [(k, v) for part, at in cells_of(iter(batches), ("k",)) for s, e in zip(at[:-1], at[1:], strict=True) for k, v in [(set(part["k"][s:e].to_pylist()), part["v"][s:e].to_pylist())]]
        assert all(len(k) == 1 for k, _ in seen) and len(seen) == len(set(keys.tolist()))
        assert [x for _, v in seen for x in v] == list(range(500))
    assert list(cells_of(iter([]), ("k",))) == []


def test_minima_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(5)
    for share in (0.5, 0.8, 0.95):
        both = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
        n = round(2000 * share)
        x, y = both[:2000], np.concatenate([both[:n], both[2000 : 4000 - n]])
        wanted = n / (4000 - n)
        assert abs(jaccard.similarity(np.sort(x), np.sort(y)) - wanted) < 1e-9
        assert abs((jaccard.minima(x) == jaccard.minima(y)).mean() - wanted) < 0.2
