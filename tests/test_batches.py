"""Python workers get texts in batches that are bounded whatever the table's size, and results are the same."""

import re
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from quill.functions import sentences, text
from quill.functions.stem import stem
from quill.operators import impacts, lexical, positions
from quill.sources import shared

ROWS = [(i, "Some words here. Other-words there, and " + f"w{i % 7} " * 40) for i in range(3000)]


def loose(spark):
    """As sessions begin."""
    for key in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{key}")


def batches_of(df):
    """The largest number of rows and bytes that a worker is given at once under the session's settings."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    got = df.mapInArrow(run, "n long, bytes long").agg(F.max("n"), F.max("bytes")).first()
    return got[0], got[1]


def test_batches_are_bounded_for_each_operator_on_texts(spark):
    chunks = spark.createDataFrame(ROWS, "chunk_id long, content string").coalesce(1)
    column = F.col("content")
    for start in (lambda: positions.positional_postings(chunks), lambda: lexical.postings(chunks), lambda: chunks.select(text.sentences(column)), lambda: chunks.select(text.lexemes(column))):
        loose(spark)
        start()
        assert batches_of(chunks)[0] <= shared.BATCH_ROWS
    long = spark.range(100, numPartitions=1).select(F.repeat(F.lit("word "), 100_000).alias("content"))
    assert batches_of(long)[1] <= 2 * shared.BATCH_BYTES


def test_long_texts_give_the_same_positions_sentences_and_stems(spark):
    rows = [(0, "Alpha beta. Gamma! " * 60_000), (1, None), (2, ""), (3, "Beta alpha-beta."), *((i, "Alpha. Beta gamma.") for i in range(4, 2500))]
    chunks = spark.createDataFrame(rows, "chunk_id long, content string")
    got = {(r.chunk_id, r.lexeme): r.positions for r in positions.positional_postings(chunks).where("chunk_id < 4").collect()}
    assert got[0, "alpha"] == [1 + 3 * i for i in range(256)] and got[3, "beta"] == [1, 4] and {i for i, _ in got} == {0, 3}
    n = {r.chunk_id: r.n for r in chunks.select("chunk_id", F.size(sentences.sentences(F.col("content"))).alias("n")).collect()}
    assert n[0] == 120_000 and n[1] == n[2] == 0 and n[3] == 1 and all(n[i] == 2 for i in range(4, 2500))
    plain = lexical.postings(chunks).groupBy("lexeme").agg(F.sum("tf")).collect()
    assert {r[0]: r[1] for r in plain} == {"alpha": 60_000 + 1 + 2496, "beta": 60_000 + 1 + 1 + 2496, "gamma": 60_000 + 2496}


def test_bounded_search_explodes_no_positions(spark):
    chunks = spark.createDataFrame([(1, "word " * 1000), (2, "word other-word"), (3, "else")], "chunk_id long, content string")
    q = spark.createDataFrame([(0, "other-word word"), (1, "else else")], "query_id long, query string")
    found = positions.search(q, positions.positional_postings(chunks), 3)
    assert "explode(positions" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.query_id, r.chunk_id, r["rank"]) for r in found.collect()) == [(0, 1, 1), (0, 2, 2), (1, 3, 1)]


def test_tasks_grow_with_the_texts_and_a_stored_index_meets_by_chunk(spark, tmp_path, monkeypatch):
    chunks = spark.createDataFrame([(i, f"w{i % 50} w{i % 3} a{i} " * 5, "ab"[i % 2]) for i in range(600)], "chunk_id long, content string, chunk_config_sha256 string")
    lexical.write_index(chunks, str(tmp_path / "i"), task_bytes=2000)
    tasks = {int(re.search(r"part-(\d+)", f.name)[1]) for f in (tmp_path / "i").rglob("part-*.parquet")}
    assert max(tasks) > 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(lexical, "PAIRS", 100)
    q = spark.createDataFrame([(1, "w1 w7"), (2, "a5"), (3, ""), (4, "w2 w40 a9 none")], "query_id long, query string")
    index = spark.read.parquet(str(tmp_path / "i"))
    found = lexical.matches_by_postings(q, index)
    assert found.rdd.getNumPartitions() > 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, lexical.matches(q, chunks).collect()))
    assert sorted(map(tuple, lexical.search(q, None, 7, index=index).collect())) == sorted(map(tuple, lexical.search(q, chunks, 7).collect()))


def test_blocks_are_put_together_across_batches(monkeypatch):
    monkeypatch.setattr(impacts, "AT_ONCE", 3)
    rows = [(b, c, x, k, i, i % 5 + 1) for b in (0, 1) for c in (None, "a") for x in ("p", "q") for k in (7, 8) for i in range(4)]
    names = ["band", "chunking", "lexeme", "block", "chunk_id", "tf"]
    kinds = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    whole = pa.RecordBatch.from_arrays(columns, names=names)
    for size in (1, 3, 4, 7, 64):
        got = [r for b in impacts._together(whole.slice(at, size) for at in range(0, len(rows), size)) for r in b.to_pylist()]
        assert len(got) == 16 and [(r["band"], r["chunking"], r["lexeme"], r["block"]) for r in got] == list(dict.fromkeys(r[:4] for r in rows))
        assert all(r["most"] == 4 and r["entries"] == [{"chunk_id": i, "tf": i + 1} for i in range(4)] for r in got)
    assert list(impacts._together(iter([]))) == []


def test_long_junk_words_stay_in_no_worker():
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        assert all(stem(f"{i:05d}" * 20_000 + "hoping") == f"{i:05d}" * 20_000 + "hope" for i in range(50))
        assert tracemalloc.get_traced_memory()[0] - before < 1_000_000
    finally:
        tracemalloc.stop()
