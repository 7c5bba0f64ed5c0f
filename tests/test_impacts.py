"""Postings in blocks against the plain index, over one batch and over many."""

import random

from quill.operators import impacts, lexical


def corpus(n, seed, first=0):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    weights = [1 / (i + 1) for i in range(200)]
    return [(first + i, " ".join(rng.choices(words, weights, k=rng.choice([3, 10, 30, 400]))), rng.choice(["a", "b"])) for i in range(n)]


def table(spark, rows):
    return spark.createDataFrame(rows, "chunk_id long, content string, chunk_config_sha256 string")


def hits(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in df.collect())


QUERIES = [(1, "w0 w1"), (2, "w50 w180 w3"), (3, "w199"), (4, "nothing"), (5, ""), (6, "w7 w7 w8 w9 w10 w11 w12"), (7, None)]


def test_blocks_give_the_same_and_read_little(spark, tmp_path):
    rows = corpus(3000, 1) + [(9000, None, "a"), (9001, "", "a"), (9002, "w0 " * 50_000, "b"), (9003, "w3 " * 40, None)]
    chunks = table(spark, rows)
    q = spark.createDataFrame(QUERIES, "query_id long, query string")
    impacts.write_index(chunks, str(tmp_path / "i"))
    index = impacts.read_index(spark, str(tmp_path / "i"))
    assert hits(index.search(q, 7)) == hits(lexical.search(q, chunks, 7))
    assert hits(index.search(q, 7, "a")) == hits(lexical.search(q, chunks.where("chunk_config_sha256 = 'a'"), 7))
    assert hits(index.search(q, 5000)) == hits(lexical.search(q, chunks, 5000))
    work = {r.query_id: r for r in index.searched(q, 7)[1].collect()}
    assert work[1].postings_read < 0.35 * work[1].postings and work[6].blocks_read < 0.5 * work[6].blocks
    assert all(w.postings_read <= w.postings for w in work.values()) and 4 not in work


def test_batches_are_found_without_a_rebuild(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(impacts, "SEGMENTS", 2)
    q = spark.createDataFrame(QUERIES, "query_id long, query string")
    live = {r[0]: r for r in corpus(300, 2)}
    impacts.write_index(table(spark, list(live.values())), str(tmp_path / "i"))
    index = impacts.read_index(spark, str(tmp_path / "i"))
    for batch in range(3):
        new = {r[0]: r for r in corpus(40, 10 + batch, 1000 * (batch + 1))}
        live |= new
        index = index.append(table(spark, list(new.values()))).maintained()
        assert len(index.segments) <= 2
    index = index.delete(spark.range(0, 100).withColumnRenamed("id", "chunk_id"))
    changed = {r[0]: r for r in corpus(40, 99, 80)}  # some of them deleted before
    live = {i: r for i, r in live.items() if i >= 100} | changed
    index = index.append(table(spark, list(changed.values())), replace=True)
    want = hits(lexical.search(q, table(spark, list(live.values())), 9))
    assert hits(index.search(q, 9)) == want
    merged = index.merge(all_segments=True)
    assert len(merged.segments) == 1 and not merged.state.below("dead") and hits(merged.search(q, 9)) == want
    assert hits(impacts.read_index(spark, str(tmp_path / "i")).search(q, 9)) == want


def test_empty_index(spark, tmp_path):
    impacts.write_index(table(spark, []), str(tmp_path / "i"), stemmed=False)
    index = impacts.read_index(spark, str(tmp_path / "i"))
    q = spark.createDataFrame(QUERIES, "query_id long, query string")
    assert index.search(q, 3).count() == 0 and index.stemmed is False
    assert index.append(table(spark, [(1, "w0s W0S", "a")])).search(spark.createDataFrame([(1, "w0s")], "query_id long, query string"), 3).first().chunk_id == 1
