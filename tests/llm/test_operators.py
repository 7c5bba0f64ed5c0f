"""Each corpus operator on small tables against a plain version, with nulls, empties, long texts, repeats and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quill.llm import decontaminate, language, licenses, line_dedup, packing, simhash, token_counts, topk, toxicity
from quill.llm.bpe import merger
from quill.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, h long, row int"


def table(spark, texts, schema=DOCS):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, 2) for i, t in texts], schema)


def word(n):
    return f"w{n}"


@pytest.fixture(scope="module")
def mixed():
    rng = random.Random(5)
    texts = [None, "", " ", "\n\n", "Word", "a b", "é" * 40, " ".join(word(rng.randint(0, 10**6)) for _ in range(30_000))]
    texts += [" ".join(word(rng.randint(0, 60)) for _ in range(rng.randint(1, 80))) for _ in range(60)]
    return [*enumerate(texts), (9, texts[9]), (None, "a b"), (None, None)]


def test_bpe_is_the_librarys():
    own, library = merger(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    rng = random.Random(1)
    texts = ["", None, " ", "  a", "a  b", "x\n y", "x \ny", "<|endoftext|>", "a <|endoftext|>b", "it's we'll", "日本 語", "é" * 300, "a\x1c b", "\x85 a \x85", "🙂🙂 👩‍👩", " \n "]
    texts += ["".join(rng.choice("ab 'st\nré1.,  <|endoftext|>") for _ in range(rng.randint(0, 50))) for _ in range(500)]
    got = [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)]
    assert got == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_token_counts(spark, mixed):
    library = Tokenizer.from_file(tokenizer_path())
    got = token_counts.token_counts(table(spark, mixed), tokenizer_path()).collect()
    want = sorted((str(i), len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in mixed)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert token_counts.token_counts(table(spark, []), tokenizer_path()).count() == 0


def test_packing(spark, mixed):
    library = Tokenizer.from_file(tokenizer_path())
    docs = [(i, t) for i, t in dict(mixed).items() if i is not None]
    rows = packing.pack_documents(table(spark, docs), tokenizer_path()).collect()
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    for i, t in docs:
        ids, at = [*library.encode(t or "", add_special_tokens=False).ids, 0], 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack_documents(table(spark, []), tokenizer_path()).count() == 0


def test_first_fit_decreasing_is_first_fit():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 101, 700)
    bins, offsets = packing.first_fit_decreasing(lengths, 100)
    room = []
    for i in np.argsort(-lengths, kind="stable"):
        at = next((b for b, free in enumerate(room) if free >= lengths[i]), len(room))
        if at == len(room):
            room.append(100)
        assert (bins[i], offsets[i]) == (at, 100 - room[at])
        room[at] -= lengths[i]


def _plain_hits(text, items, span=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    own, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        n = min(len(w), span)
        windows = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
        for k in range(len(own) - n + 1) if n else ():
            if tuple(own[k : k + n]) in windows:
                hit.update(range(k, k + n))
                found.add(str(item))
    return len(own), hit, sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_decontaminate(spark, block_bytes):
    rng = random.Random(2)
    text = lambda n, v: " ".join(rng.choice(["{}", "{}.", "{}\n"]).format(word(rng.randint(0, v))) for _ in range(n))
    items = [(k, text(rng.choice([1, 3, 9, 10, 25]), 9)) for k in range(12)] + [(50, None), (51, ""), (52, "W1 w2"), (52, "w3 W4")]
    docs = [(k, text(rng.randint(0, 120), 9)) for k in range(40)] + [(90, None), (91, ""), (92, items[3][1].upper())]
    bench = spark.createDataFrame([(*x, "y") for x in items], "item_id long, text string, doc_id string")
    found = decontaminate.decontaminate(table(spark, docs), bench, block_bytes=block_bytes).collect()
    assert len(found) == len(docs)
    for r in found:
        n, hit, ids = _plain_hits(dict(docs)[r.doc_id], [x for x in items if x[1] is not None])
        assert (r.n_words, set(r.hits), sorted(r["items"])) == (n, hit, ids)


def test_index_of_several_pieces():
    rng = random.Random(8)
    items = [(str(k), " ".join(word(rng.randint(0, 10**6)) for _ in range(80_000))) for k in range(4)]  # over half a piece each
    items += [("4", "one two three"), ("5", items[3][1][-200:]), ("6", "")]
    index = decontaminate.Index(items)
    assert sum(len(t) for _, t in items) > 2 << 20
    for k in range(4):
        w = items[k][1].split()
        text = " ".join(["x", *w[40_000:40_012], "y", *w[-10:], "one two three"])
        hit, found = index.hits(decontaminate.Words([b"", text.encode()]))
        assert {t for t, _ in found} == {1}
        assert sorted({index.items[i] for _, s in found for i in s}) == sorted({str(k), "4", *(["5"] if k == 3 else [])})
        assert np.flatnonzero(~hit).tolist() == [0, 13]


def test_decontaminate_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    out = decontaminate.digest(decontaminate.decontaminate(table(spark, [(1, "a b"), (2, None)]), bench)).collect()
    assert [(r.n_hit, r.contaminated, r.items_sha256) for r in out] == [(0, False, hashlib.sha256(b"").hexdigest())] * 2
    assert decontaminate.decontaminate(table(spark, []), bench).count() == 0


def test_fingerprints(spark, mixed):
    def plain(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        runs = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in runs]
        return f"{sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)):016x}"

    few = [(i, t) for i, t in mixed if t is None or len(t) < 1000]
    got = simhash.near_duplicates(table(spark, few)).collect()
    texts = {}
    for i, t in few:
        texts.setdefault(i, set()).add(plain(t))
    assert len(got) == len(few) and all(r.fingerprint in texts[r.doc_id] for r in got)


@pytest.mark.parametrize("cell", [4096, 7])
def test_near_links_keep_every_class(spark, cell):
    rng = random.Random(4)
    fps = {0, (1 << 64) - 1}
    for _ in range(40):
        centre = rng.getrandbits(64)
        for _ in range(rng.randint(1, 30)):
            x = centre
            for _ in range(rng.randint(0, 6)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    got = {r.node: r.least for r in simhash.classes(simhash.near_links(df, len(fps), cell=cell)).collect()}
    label = {x: x for x in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            least = min((label[b] for b in fps if (a ^ b).bit_count() <= 3), key=signed)
            if signed(least) < signed(label[a]):
                label[a], changed = least, True
    assert {x: got.get(signed(x), signed(x)) for x in fps} == {x: signed(label[x]) for x in fps}


def test_near_duplicates_edges(spark):
    rows = [(5, None), (3, ""), (9, " \n"), (7, "a b c d"), (8, "a b c d"), (8, "a b c d"), (None, "a b c d"), (None, "z z y")]
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(table(spark, rows)).collect())
    assert got == sorted([("5", "3"), ("3", "3"), ("9", "3"), ("7", "7"), ("8", "7"), ("8", "7"), ("None", "7"), ("None", "None")])
    assert simhash.near_duplicates(table(spark, [])).count() == 0


def test_representatives_by_similarity(spark):
    """No two rows that stay have a Jaccard similarity of 0.8, and every row that goes beside near fingerprints has a near copy."""
    rng = random.Random(11)
    texts = []
    for family in range(12):
        base = [word(rng.randint(0, 10**6)) for _ in range(rng.choice([6, 60, 200, 900]))]
        for _ in range(rng.choice([1, 2, 3, 25])):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 40))):
                own[rng.randrange(len(own))] = word(rng.randint(0, 10**6))
            texts.append((len(texts), " ".join(own)))
    texts += [(None, texts[0][1] + " more"), (500, None), (501, ""), (502, "few words")]
    sets = [frozenset(" ".join((t or "").split()[i : i + 5]) for i in range(max(1, len((t or "").split()) - 4))) if t else frozenset() for _, t in texts]
    near = lambda i, j: bool(sets[i]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    far = [(i, j) for j in range(len(texts)) for i in range(j) if near(i, j) and (simhash.fingerprint(simhash.shingle_hashes(texts[i][1].encode())) ^ simhash.fingerprint(simhash.shingle_hashes(texts[j][1].encode()))).bit_count() > 3]
    assert len(far) > 20
    kept = {(r.doc_id, r.text) for r in simhash.representatives(table(spark, texts), similarity=0.8).collect()}
    stay = [i for i, t in enumerate(texts) if t in kept]
    assert not [1 for j in stay for i in stay if i < j and near(i, j)]
    radius = {(r.doc_id, r.text) for r in simhash.representatives(table(spark, texts)).collect()}
    assert kept < radius
    assert all(any(near(i, j) for j in range(len(texts)) if j != i) for i, t in enumerate(texts) if t in radius - kept)


def test_line_dedup(spark):
    long = " ".join(word(i) for i in range(30))
    short = "one two three four\nfive six seven eight"
    texts = [(1, f"head a\n{long}\ntail a"), (2, f"head b\n{long}\ntail b"), (3, long), (4, None), (5, ""), (6, "only once here"), (None, f"x\n{long}"), (7, short), (8, short), (9, f"{long}\n{long}")]
    got = {r.doc_id: (r.text, r.n_lines_removed) for r in line_dedup.line_dedup(table(spark, texts)).collect()}
    assert got[None] == (f"x\n{long}", 0)  # null ids come first
    assert got[1] == ("head a\ntail a", 1) and got[2] == ("head b\ntail b", 1) and got[3] == ("", 1) and got[9] == ("", 2)
    assert got[4] == (None, 0) and got[5] == ("", 0) and got[6] == ("only once here", 0)
    out = line_dedup.line_dedup(table(spark, texts))
    assert out.columns == [*table(spark, []).columns, "n_lines_removed"]
    assert line_dedup.line_dedup(table(spark, [])).count() == 0


def test_line_dedup_same_rows_are_one(spark):
    long = " ".join(word(i) for i in range(30))
    got = line_dedup.line_dedup(table(spark, [(1, long), (1, long)])).collect()
    assert [r.text for r in got] == [long, long]


def test_chunks_resist_shifts():
    lines = [" ".join(word(random.Random(i).randint(0, 999)) for _ in range(6)) for i in range(60)]
    a = {t for *_, t in line_dedup.chunks("\n".join(lines))}
    b = {t for *_, t in line_dedup.chunks("\n".join(["an added line", *lines[3:]]))}
    assert len(a & b) >= 0.8 * len(a)


@pytest.mark.parametrize(("n", "words"), [(3, 18), (3, 24), (5, 12), (6, 10), (11, 5), (20, 10), (40, 10), (60, 1)])
def test_runs_of_short_lines_go_whole(spark, n, words):
    """A passage of over 50 words goes from every later copy, whatever stands around it; the first copy and what is around stay."""
    rng = random.Random(n * words)
    line = lambda k: " ".join(word(rng.randint(0, 10**9)) for _ in range(k))
    passage = [line(words) for _ in range(n)]
    around = [([line(rng.randint(1, 9)) for _ in range(rng.randint(1, 4))], [line(rng.randint(1, 9)) for _ in range(rng.randint(1, 4))]) for _ in range(30)]
    texts = [(i, "\n".join([*a, *passage, *b])) for i, (a, b) in enumerate(around)]
    got = {r.doc_id: (r.text, r.n_lines_removed) for r in line_dedup.line_dedup(table(spark, texts), with_runs=True).collect()}
    assert got == {i: (t, 0) if i == 0 else ("\n".join([*around[i][0], *around[i][1]]), n) for i, t in texts}


def test_runs_that_overlap_keep_a_copy(spark):
    rng = random.Random(3)
    pool = [word(i) + " a b c d e" for i in range(12)] + ["", " "]
    texts = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 60)))) for i in range(40)] + [(50, "\n".join(["x y z u v w"] * 30)), (51, None)]
    got = {r.doc_id: r for r in line_dedup.line_dedup(table(spark, texts), with_runs=True).collect()}
    lines = lambda ts: {x for t in ts if t for x in t.split("\n")}
    assert lines(r.text for r in got.values()) == lines(t for _, t in texts)
    assert 5 <= got[50].text.count("x y z") < 30 and got[51].text is None


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).round(1).tolist(), 0) for i in range(300)]
    rows += [(300, None, 0), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (302, [float("nan")] * 6, 0), (303, [float("inf")] * 6, 0), (304, [], 0), (305, [1.0, 2.0], 0), (350, [3.0, 1.0], 0), (50, rows[50][1], 0), (None, rows[1][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect()}
    sound = [(i, np.floor(256 * np.array(v, dtype=float))) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for q, v in sound:
        if q % 50 == 0:
            found = sorted(((-int(v @ x), i) for i, x in sound if i != q and len(x) == len(v)))[:5]
            want |= {(q, k, i, -s) for k, (s, i) in enumerate(found, 1)}
    assert got == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_in_blocks(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(400)], "vec_id long, embedding array<double>")
    key = lambda d: sorted(map(tuple, d.collect()))
    is_query = F.col("vec_id") % 20 == 0
    assert key(topk.top_k(df, is_query)) == key(topk.top_k(df, is_query, block_bytes=400))


def test_language(spark):
    rng = random.Random(3)
    parts = {"aa": ["ba", "lo", "mi"], "bb": ["stra", "kth", "urg"]}
    make = lambda p: " ".join("".join(rng.choice(p) for _ in range(3)) for _ in range(25))
    rows = [(i, make(parts[lang]), lang) for i in range(200) for lang in [("aa", "bb")[i % 2]]]
    rows += [(900, None, "aa"), (901, "12 34 !", "aa"), (902, "", "bb"), (903, "balo", None), (None, "stra", "bb")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in language.language(df).collect()}
    assert len(got) == len(rows)
    assert all(got[i].lang_pred == lang for i, _, lang in rows if i is not None and i < 900)
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[903].lang_pred == "aa"
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(200)) and all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in language.language(df.where("doc_id = 903")).collect()} == {"und"}
    assert language.language(df.limit(0)).count() == 0


def test_code_lengths_are_those_of_the_trees():
    samples = {"x": [b"abracadabra", b"abba"], "y": [b"mississippi"]}
    model = language.Model(samples)

    def plain(lang, text):
        order, pad = language.ORDER, language.PAD
        counts = {}
        for t in samples[lang]:
            raw = pad * order + t
            for i in range(order, len(raw)):
                for n in range(order + 1):
                    c = counts.setdefault(raw[i - n : i], {})
                    c[raw[i]] = c.get(raw[i], 0) + 1
        # Between texts the pad is coded as well, as the model's sample does.
        raw = (pad * order).join(samples[lang])
        counts = {}
        raw = pad * order + raw
        for i in range(order, len(raw)):
            for n in range(order + 1):
                c = counts.setdefault(raw[i - n : i], {})
                c[raw[i]] = c.get(raw[i], 0) + 1
        total, raw = 0.0, pad * order + text
        for i in range(order, len(raw)):
            p, n = 1.0, order
            while n >= 0:
                c = counts.get(raw[i - n : i])
                if c:
                    s, d = sum(c.values()), len(c)
                    if raw[i] in c:
                        p *= c[raw[i]] / (s + d)
                        break
                    p *= d / (s + d)
                n -= 1
            else:
                p /= 256
            total -= np.log2(p)
        return total

    for text in (b"abracadabra", b"missabba", b"\xff\x00zz", b"a" * 50):
        assert np.allclose(model.lengths([text, text], most=16)[1], [plain("x", text), plain("y", text)], atol=1e-3)


def test_toxicity(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        bad = rng.random() < 0.3
        words = [word(rng.randint(0, 300)) for _ in range(40)] + (["Vile!"] if bad else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    rows += [(900, None), (901, ""), (None, "vile")]
    df = table(spark, rows)
    marks = spark.createDataFrame([*labels, (900, 1, 1), (None, 1, 1), (5000, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(df, marks).collect()}
    truth = {i: t for i, _, t in labels}
    held = [i for i in range(600) if got[i].held_out]
    assert {i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2} == set(held)
    assert sum(got[i].predicted == truth[i] for i in held) >= 0.97 * len(held)
    assert got[900].predicted == got[901].predicted == 0 and all(0 <= r.score <= 1 for r in got.values()) and len(got) == 603
    assert toxicity.toxicity(df, marks.limit(0)).count() == 603 and toxicity.toxicity(df.limit(0), marks).count() == 0


def test_licenses(spark):
    mit = "The MIT License (MIT)\n\nCopyright (c) 2020 Someone\n\n" + licenses.TEXTS["MIT"][0].replace("Permission", "PERMISSION").replace(", free", " ,  free")
    rows = [(1, mit), (2, "Prose.\nLicensed under the Apache Licence, version 2.0\nReleased under the MIT License."), (3, None), (4, ""), (5, "Licensed under the Apache License, Version 2.0 or not"), (None, "All rights reserved"), (2, "x"), (6, "y" * 200_000)]
    got = sorted(((str(r.doc_id), r.text_license, r.line_licenses, r.n_license_lines) for r in licenses.license_scan(table(spark, rows)).collect()), key=str)
    rights = "LicenseRef-All-Rights-Reserved"
    none = [(i, None, "", 0) for i in ("2", "3", "4", "5", "6")]
    assert got == sorted([("1", "MIT", "", 0), ("2", None, "Apache-2.0,MIT", 2), ("None", rights, rights, 1), *none], key=str)
    assert licenses.license_scan(table(spark, [])).count() == 0
