"""Cases that a plain version decides: repeated rows, shared and missing ids, long texts, large numbers, clashing columns."""

import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quill.llm import decontaminate, language, licenses, packing, runtime, simhash, topk, toxicity
from quill.llm.queries import tokenizer_path
from quill.llm.words import Words

LICENSES = "/usr/share/common-licenses"


def word(n):
    return f"w{n}"


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_decontamination_judges_every_row(spark, block_bytes):
    rng = random.Random(2)
    items = [(i, " ".join(word(rng.randint(0, 10**6)) for _ in range(12))) for i in range(12)] + [(None, "x y"), (50, None), (51, "short item")]
    texts = [items[0][1] + " and " + items[7][1], items[3][1], "clean text", None, "", "a short item here", "long " * 50_000 + items[11][1]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0])] * 3 + [(None, texts[0])] * 2 + [(0, texts[1]), (None, None)]
    docs = spark.createDataFrame([(*r, "a", 1, 2) for r in rows], "doc_id long, text string, id string, key int, hits int")
    got = decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes)
    want = {0: [0, 7], 1: [3], 5: [51], 6: [11]}
    of = {t: sorted(map(str, want.get(i, []))) for i, t in enumerate(texts)}
    assert Counter((r.doc_id, tuple(r["items"]), len(r.hits)) for r in got.collect()) == Counter((i, tuple(of[t]), sum(2 if x == "51" else 12 for x in of[t])) for i, t in rows)
    clean = decontaminate.without_hits(docs, got)
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter(r for r in rows if not of[r[1]])


def plain_top(rows, k, clip=lambda s: s):
    sound = [(i, n, [math.floor(256 * float(x)) for x in v]) for n, (i, v) in enumerate(rows)]
    out = Counter()
    for q, n, x in sound:
        if q % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, m, y in sound if m != n and len(x) == len(y))[:k]
            out.update((q, r, i, clip(-s)) for r, (s, i) in enumerate(found, 1))
    return out


@pytest.mark.parametrize(("size", "spread"), [(1.0, 1.0), (1e6, 1e-3), (4e5, 1.0)])
def test_top_k_is_exact_for_large_numbers(spark, size, spread):
    rng = np.random.default_rng(7)
    base = rng.normal(size=24)
    rows = [(i, (size * (base + spread * 1e-6 * rng.normal(size=24))).tolist()) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = Counter(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0).collect()))
    assert got == plain_top(rows, 5)


def test_top_k_beyond_longs_ends_at_them(spark):
    rows = [(0, [1e10, 1e10]), (1, [1e11, 1e11]), (2, [-1e11, -1e11]), (3, [1e9, 0.0]), (50, [0.0, 0.0])]
    got = Counter(map(tuple, topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()))
    assert got == plain_top(rows, 5, lambda s: max(-(2**63) + 1, min(2**63 - 1, s)))


def test_top_k_of_shared_ids(spark):
    rng = np.random.default_rng(8)
    rows = [(i % 60, rng.integers(-3, 4, 5).astype(float).tolist()) for i in range(200)]
    rows += [rows[50], rows[50], (50, [9.0] * 5), (0, rows[0][1])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, id int, x int")
    is_query = F.col("vec_id") % 50 == 0
    want = plain_top(rows, 5)
    assert Counter(map(tuple, topk.top_k(df, is_query).collect())) == want
    assert Counter(map(tuple, topk.top_k(df, is_query, block_bytes=100).collect())) == want
    assert sum(n for (_, r, _, _), n in want.items() if r == 1) == sum(i % 50 == 0 for i, _ in rows)


def test_packing_carries_rows_and_clashing_columns(spark):
    items = spark.createDataFrame([(i % 5, 1 + i % 9, "s", 3.5, "x") for i in range(100)] + [(None, 9, None, None, None)] * 3, "id long, length long, sequence_id string, offset double, `a.b` string")
    out = packing.pack(items, 100, capacity=10, group=16)
    assert out.columns == ["id", "length", "a.b", "sequence_id", "offset"]
    rows = out.collect()
    assert Counter((r.id, r.length) for r in rows) == Counter((r.id, r.length) for r in items.collect())
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in x) <= 10 and [o for o, _ in sorted(x)] == np.cumsum([0] + [n for _, n in sorted(x)])[:-1].tolist() for x in by.values())
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None), (None, "word " * 30_000), (2, "")], "doc_id long, text string")
    pieces = packing.pack_documents(docs, tokenizer_path()).collect()
    assert Counter((r.doc_id, r.doc_tokens) for r in pieces if r.start == 0)[(1, next(r.doc_tokens for r in pieces if r.doc_id == 1))] == 2
    long = [r for r in pieces if r.doc_id is None and r.doc_tokens > 1]
    assert sum(r.length for r in long) == long[0].doc_tokens > 30_000 and sorted(r.start for r in long) == list(range(0, long[0].doc_tokens, 1024))


def test_features_are_words_pairs_and_skips():
    texts = [b"a b c", b"b c", b"x", None, b"a z c a b", b""]
    own = toxicity.feature_sets(Words(texts), len(texts), 40)

    def plain(t):
        w = (t or b"").split()
        return {(x,) for x in w} | {(*p, 1) for p in zip(w, w[1:], strict=False)} | {(*p, 2) for p in zip(w, w[2:], strict=False)}

    for i, a in enumerate(texts):
        assert len(own[i]) == len(plain(a))
        for j, b in enumerate(texts):
            assert len(np.intersect1d(own[i], own[j])) == len(plain(a) & plain(b))


def test_ftrl_is_that_of_a_plain_loop():
    rng = random.Random(4)
    rows = [np.array(sorted(rng.sample(range(64), rng.randint(0, 12))), dtype=np.int64) for _ in range(300)]
    labels = np.array([float(5 in r or rng.random() < 0.1) for r in rows])
    config = toxicity.Ftrl(alpha=0.3, beta=0.7, l1=0.5, l2=0.2, epochs=3, bits=6)
    got, bias = config.train(rows, labels)
    z, n = {}, {}

    def weight(k):
        zk, nk = z.get(k, 0.0), n.get(k, 0.0)
        return 0.0 if abs(zk) <= config.l1 else -(zk - math.copysign(config.l1, zk)) / ((config.beta + math.sqrt(nk)) / config.alpha + config.l2)

    rate = labels.mean()
    b, bn = math.log(rate / (1 - rate)), 0.0
    for _ in range(config.epochs):
        for row, y in zip(rows, labels, strict=True):
            w = {k: weight(k) for k in row.tolist()}
            g = 1 / (1 + math.exp(-(b + sum(w.values())))) - y
            for k, wk in w.items():
                sigma = (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / config.alpha
                z[k] = z.get(k, 0.0) + g - sigma * wk
                n[k] = n.get(k, 0.0) + g * g
            bn += g * g
            b -= 0.05 * g / (1 + math.sqrt(bn))
    assert np.allclose(got, [weight(k) for k in range(64)], atol=1e-9) and abs(bias - b) < 1e-9
    assert 0 < (got == 0).sum() < 64


def test_the_training_sample_is_bounded_by_rows(spark):
    """An id of many rows, labels without documents and texts that can't be learned take no more than their part."""
    rows = [(7, f"hot row {i} fine") for i in range(400)] + [(7, "same again")] * 400 + [(i, f"vile {word(i)}" if i % 2 else f"fine {word(i)}") for i in range(1000, 1200)] + [(5, None), (6, "x" * 70_000), (None, "vile")]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, h string")
    labels = spark.createDataFrame([(7, 0), (5, 1), (6, 1), (None, 1), *[(i, i % 2) for i in range(1000, 1200)], *[(i, 1) for i in range(10**6, 10**6 + 5000)]], "doc_id long, toxic int")
    learn = F.lit(True)
    at, w, bias = toxicity.fit(docs, labels, learn, toxicity.Ftrl(l1=0.5), train_rows=300)
    assert len(at)
    scored = {r.doc_id: r.score for r in toxicity.score(docs.where("doc_id >= 1000"), (at, w, bias)).collect()}
    assert np.mean([s > 0.3 for i, s in scored.items() if i % 2]) > 0.9 and np.mean([s < 0.3 for i, s in scored.items() if not i % 2]) > 0.9
    out = toxicity.toxicity(docs, labels, toxicity.Ftrl(l1=0.5))
    assert out.count() == len(rows) and out.columns == ["doc_id", "held_out", "score", "predicted"]


def test_languages_of_long_and_mostly_empty_texts_are_learned(spark):
    rng = random.Random(9)
    make = lambda parts, n: " ".join("".join(rng.choice(parts) for _ in range(3)) for _ in range(n))
    learned = lambda i: zlib.crc32(str(i).encode()) % 3 != 1
    ids = [i for i in range(400) if learned(i)]
    rows = [(ids[0], make(["ba", "lo"], 20_000), "long")] + [(i, "", "rare") for i in ids[1:200]] + [(ids[200], make(["stra", "kth"], 30), "rare")]
    rows += [(10**6, make(["ba", "lo"], 40), None), (10**6, make(["ba", "lo"], 40), None), (None, make(["stra", "kth"], 40), "rare"), (10**6 + 1, make(["stra", "kth"], 25_000), None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, lang_pred string")
    got = [(r.doc_id, r.lang_pred) for r in language.language(df).collect()]
    assert len(got) == len(rows) and Counter(got)[(10**6, "long")] == 2
    assert {(None, "rare"), (10**6 + 1, "rare"), (ids[0], "long"), (ids[200], "rare"), (ids[1], "und")} <= set(got)
    model = language.fit(df, F.lit(True), train_rows=1)
    assert model.languages == ["long", "rare"] or tuple(model.languages) == ("long", "rare")


def test_coordinates_discard_pairs_of_two_rows_too(spark):
    """Links of cells of every size are those within the radius; the pivots' coordinates discard most pairs before they are verified."""
    rng = random.Random(12)
    fps = sorted({rng.getrandbits(64) for _ in range(300)})
    fps += [f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in fps[:100]]
    fps = np.array(sorted(set(fps)), dtype=np.uint64)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = {(r.u, r.v) for r in simhash.near_links(df, len(fps)).collect()}
    far = np.bitwise_count(fps[:, None] ^ fps[None, :])
    want = {tuple(sorted((int(fps.view(np.int64)[i]), int(fps.view(np.int64)[j])))) for i, j in zip(*np.nonzero(far <= 3), strict=True) if i < j}
    assert got <= want and {n for p in got for n in p} == {n for p in want for n in p}
    references = simhash.pivots(simhash.RADIUS + 2)
    table = simhash.distances(fps, references)
    apart = np.abs(table[:, None] - table[None, :]).max(axis=2)
    assert (apart <= far).all()  # coordinates never lose a pair
    assert (apart[far > 3] > simhash.RADIUS).mean() > 0.99


@pytest.mark.skipif(not os.path.isdir(LICENSES), reason="no licence texts here")
def test_whole_licences_are_found_however_they_are_wrapped(spark):
    texts = {n: open(f"{LICENSES}/{f}").read() for n, f in (("Apache-2.0", "Apache-2.0"), ("GPL-2.0", "GPL-2"), ("GPL-3.0", "GPL-3"), ("LGPL-2.1", "LGPL-2.1"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0"))}
    rows = [(n, t) for n, t in texts.items()]
    rows += [("Apache-2.0", texts["Apache-2.0"].split("END OF TERMS AND CONDITIONS")[0] + "END OF TERMS AND CONDITIONS\n"), ("MPL-2.0", texts["MPL-2.0"].replace("License", "Licence").upper())]
    words = licenses.TEXTS["BSD-3-Clause"][1].split(" ")
    rows += [("BSD-3-Clause", "Copyright (c) 2001, A. N. Author\n" + " ".join(w + ("\n" if i % 7 == 6 else "") for i, w in enumerate(words)))]
    rows += [(None, texts["GPL-2.0"] + "\nmore"), (None, "mit"), (None, "CC0"), (None, "")]
    df = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(rows)], "doc_id long, wanted string, text string")
    got = {r.doc_id: r for r in licenses.license_scan(df).collect()}
    assert [got[i].text_license for i in range(len(rows))] == [n for n, _ in rows]
    assert got[len(rows) - 3].n_license_lines == got[len(rows) - 2].n_license_lines == 0
    tags = spark.createDataFrame([(1, "# SPDX-License-Identifier: Apache-2.0\ncode"), (2, "SPDX-License-Identifier: GPL-2.0-or-later")], "doc_id long, text string")
    assert [r.line_licenses for r in licenses.license_scan(tags).orderBy("doc_id").collect()] == ["Apache-2.0", "GPL-2.0"]


def test_a_cluster_without_a_shared_folder_is_an_error(monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "x"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.shared_folder(Session())
    Context.master = "local[2]"
    assert os.path.isdir(runtime.shared_folder(Session()))


def test_sides_are_broadcast_by_bytes(spark):
    plan = lambda df: df._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(runtime.side(spark.createDataFrame([("x", 1)], "a string, b int")))
    assert "broadcast" not in plan(runtime.side(spark.createDataFrame([("x" * (9 << 20), 1)], "a string, b int")))
