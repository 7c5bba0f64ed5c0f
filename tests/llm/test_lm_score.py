"""The language model against counts and probabilities taken one token at a time."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quill.llm import lm_score

UPPER = {i: i + 32 for i in range(65, 91)}


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER)) + ["\n"]


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    one = ["the", "of", "and", "in", "is", "Äpfel", "tion."] + [f"wor{i}" for i in range(60)]
    two = ["der", "die", "und", "von", "zu"] + [f"lich{i}en" for i in range(60)]
    rows = [(i, " ".join(rng.choices(two if i % 3 == 0 else one, k=rng.randint(1, 40)))) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n "), (n + 3, "The\x0bOF\x00x " * 3), (n + 4, "x" * 50_000), (n + 5, "rare " * 3000), (None, "the of unheard"), (None, None), (4, "the of"), (4, "the of"), (n + 6, "    É")]
    return rows


def plain(rows):
    train = Counter(t for i, text in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2 for t in tokens(text))
    total, kinds = sum(train.values()), len(train)
    out = defaultdict(list)
    for i, text in rows:
        own = tokens(text)
        out[i].append((i is not None and zlib.crc32(str(i).encode()) % 7 == 2, len(own), sum(t in train for t in own), total, sum(math.log10((train[t] + 1) / (total + kinds + 1)) for t in own)))
    return out, train


def own_score(model, train, text):
    """One token after the other, from the model's tables."""
    out, before = 0.0, []
    keys = lambda w: 0 if w == "\n" else int(lm_score.spelling_keys(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())]))[0])
    for w in tokens(text):
        one, two, three = (before[-g] if len(before) >= g else 0 for g in (1, 2, 3))
        pair = ((two * lm_score.KEYS + one) * 0x9E3779B97F4A7C15 % 2**64) >> 50
        x = sum(model.weights[r].astype(float) for r in (0, 1 + one, 1 + lm_score.KEYS + two, 1 + 2 * lm_score.KEYS + three, 1 + 3 * lm_score.KEYS + pair))
        p = np.exp(x - x.max())
        p /= p.sum()
        of = model.key_class[keys(w)]
        share = (train[w] - model.discount[of]) / model.mass[of] * p[of] if w in train else (p * model.discount * model.kinds / np.maximum(model.mass, 1)).sum()
        out += math.log10(share)
        before.append(keys(w))
    return out


@pytest.mark.parametrize("head", [1 << 17, 20])
def test_counts_and_scores(spark, monkeypatch, head):
    monkeypatch.setattr(lm_score, "HEAD", head)
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x", 1, 2.0) for r in rows], "doc_id long, text string, word string, n int, r double").repartition(3)
    want, train = plain(rows)
    got = defaultdict(list)
    for r in lm_score.lm_score(docs).collect():
        got[r.doc_id].append(tuple(r)[1:6] + (r.score,))
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in want.items()}
    better = []
    for k, own in want.items():
        for a, b in zip(sorted(own), sorted(got[k]), strict=True):
            assert a[:4] == b[:4] and b[4] == pytest.approx(a[4], rel=1e-9)
            better.append(b[5] - b[4])
    assert np.mean(better) > 0  # the model beats the counts


@pytest.mark.parametrize("head", [1 << 17, 15])
def test_score_is_the_sum_over_tokens(spark, monkeypatch, head):
    monkeypatch.setattr(lm_score, "HEAD", head)
    rows = [(i, t) for i, t in corpus(120, 5) if i is not None and i != 4]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model, vocabulary = lm_score.fit(docs, F.crc32(F.col("doc_id").cast("string")) % 7 != 2)
    train = plain(rows)[1]
    assert {bytes(r.word).decode(): r.n for r in vocabulary.collect()} == dict(train)
    got = {r.doc_id: r.score for r in lm_score.score(docs, model, vocabulary).collect()}
    for i, text in rows:
        assert got[i] == pytest.approx(own_score(model, train, text), rel=1e-5, abs=1e-5)


def test_probabilities_add_up_to_one(spark):
    rows = [(i, t) for i, t in corpus(120, 9) if i is not None]
    model, vocabulary = lm_score.fit(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(True))
    train = Counter(w for _, t in rows for w in tokens(t))
    p = lm_score.softmax(model.weights, [np.array([1 + r]) for r in (7, lm_score.KEYS + 9, 2 * lm_score.KEYS, 3 * lm_score.KEYS + 5)])[0]
    words = list(train)
    keys = np.array([0 if w == "\n" else lm_score.spelling_keys(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())]))[0] for w in words])
    of = model.key_class[keys]
    known = (p[of] * 10 ** model.inside(np.array([train[w] for w in words]), of)).sum()
    assert known + (p * model.unknown()).sum() == pytest.approx(1, abs=1e-4)


def test_nothing_to_learn(spark):
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2]
    docs = spark.createDataFrame([(i, "a b") for i in held] + [(None, "a")], "doc_id long, text string")
    rows = lm_score.lm_score(docs).collect()
    assert {(r.n_known, r.train_tokens, r.base_score, r.score) for r in rows} == {(0, 0, 0.0, 0.0)}
    assert lm_score.lm_score(docs.limit(0)).count() == 0


def test_stream_looks_back_within_a_text():
    s = lm_score.Stream([b"a b c", None, b"D"])
    a, b, c, d = (int(x) for x in s.key[[0, 1, 2, 5]])
    assert s.key.tolist() == [a, b, c, 0, 0, d, 0] and s.word.tolist() == [0, 1, 2, -1, -1, 3, -1]
    assert s.words.to_pylist() == [b"a", b"b", b"c", b"d"]
    assert [s.before(g).tolist() for g in (1, 2, 3)] == [[0, a, b, c, 0, 0, d], [0, 0, a, b, 0, 0, 0], [0, 0, 0, a, 0, 0, 0]]
