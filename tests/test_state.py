"""Streaming dedup by state, and the vector cache in buckets."""

import json
import time

from pyspark.sql import functions as F

from quill.config import RetrievalConfig
from quill.operators import embedding
from quill.sources.vector_cache import VectorCache
from quill.streaming import incremental

CONFIG = RetrievalConfig(chunk_tokens=20)


def arrive(spark, folder, name, rows, horizon):
    """What is in the table after a run that finds new rows, and the run's last progress."""
    (folder / "in").mkdir(exist_ok=True)
    (folder / "in" / f"{name}.json").write_text("\n".join(json.dumps(dict(zip(("paper_id", "title", "text"), r, strict=True))) for r in rows))
    stream = spark.readStream.schema("paper_id string, title string, text string").json(str(folder / "in"))
    query = incremental.ingest_stream(stream, str(folder / "chunks"), str(folder / "check"), CONFIG, horizon=horizon)
    query.awaitTermination()
    state = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return sorted((r.paper_id, r.content) for r in spark.read.parquet(str(folder / "chunks")).collect()), state[-1]


def test_state_outlives_a_restart(spark, tmp_path):
    one, two = ("p1", "T", "First sentence here. Second one."), ("p2", "T", "Other words.")
    first, state = arrive(spark, tmp_path, "a", [one, one], "1 day")
    assert [p for p, _ in first] == ["p1"] and state == 1
    second, state = arrive(spark, tmp_path, "b", [one, two], "1 day")  # a query of its own, from the checkpoint
    assert [p for p, _ in second] == ["p1", "p2"] and state == 2
    assert arrive(spark, tmp_path, "c", [two, one, one], "1 day") == (second, 2)


def test_state_ends_with_the_horizon(spark, tmp_path):
    many = [(f"p{i}", "T", f"Words of paper {i}.") for i in range(30)]
    assert arrive(spark, tmp_path, "a", many, "1 second")[1] == 30
    time.sleep(2.5)
    arrive(spark, tmp_path, "b", [("q", "T", "New words.")], "1 second")
    rows, state = arrive(spark, tmp_path, "c", [("r", "T", "Newer words.")], "1 second")
    assert len(rows) == 32 and state <= 2  # the thirty keys are forgotten


def test_cache_is_looked_up_where_it_lies(spark):
    spark.sql("DROP TABLE IF EXISTS quill_cache")
    cache = VectorCache(spark, "quill_cache", 8)
    vectors = spark.createDataFrame([(f"d{i}", [float(i), 1.0]) for i in range(50)] + [("d1", [9.0, 9.0]), (None, [1.0]), ("x", None)], "digest string, vec array<float>")
    assert [cache.put(vectors, "m"), cache.put(vectors, "m"), cache.put(vectors.limit(3), "other")] == [50, 0, 3]
    wanted = spark.createDataFrame([("d1",), ("d1",), ("d49",), ("none",), (None,)], "digest string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = VectorCache(spark, "quill_cache").lookup(wanted, "m")
        assert sorted((r.digest, list(r.vec)) for r in found.collect()) == [("d1", [1.0, 1.0]), ("d49", [49.0, 1.0])]
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        stored = plan[plan.index("SortMergeJoin") : plan.index("quill_cache")]  # the join's first side
        assert "Bucketed: true" in plan and "Exchange" not in stored
        assert "Exchange" not in plan[: plan.index("SortMergeJoin")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_embedding_fills_and_reads_the_cache(spark):
    spark.sql("DROP TABLE IF EXISTS quill_cache_2")
    cache, calls = VectorCache(spark, "quill_cache_2", 4), spark.sparkContext.accumulator(0)

    class Counting(embedding.DigestEncoder):
        def encode_documents(self, texts):
            calls.add(len(texts))
            return super().encode_documents(texts)

    chunks = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b", "x"), (4, "c", None)], "chunk_id long, embed_input string, chunk_config_sha256 string").withColumn(
        "embed_input_sha256", F.when(F.col("chunk_id") != 4, F.sha2("embed_input", 256))
    )
    none = spark.createDataFrame([], "chunk_id long, model string, vec array<float>")
    for expected in (3, 4):  # a, b and c; then c again, which has no digest
        rows = embedding.embed(chunks, none, "m", Counting, cache=cache).collect()
        assert sorted(r.chunk_id for r in rows) == [1, 2, 3, 4] and calls.value == expected
        assert next(r.vec for r in rows if r.chunk_id == 1) == next(r.vec for r in rows if r.chunk_id == 2)
    spark.sql("DROP TABLE quill_cache_2")
    spark.sql("DROP TABLE quill_cache")
