import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.dtypes == docs.dtypes
            sizes.append(out.count())
            docs = out
    assert sizes == sorted(sizes, reverse=True) and sizes[2] == sizes[1] and sizes[3] < sizes[2]
    kept = docs.select("doc_id").join(out.select("doc_id").distinct(), "doc_id", "left_anti").count()
    assert kept == 0
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_stages_take_empty_tables(spark, stage):
    assert stage(spark, spark.read.parquet(f"{SF}/documents.parquet").limit(0), SF).count() == 0


CLASHING = ("score", "n_lines_removed", "_id", "_key", "_row", "_head", "fingerprint", "component_id", "row", "fp", "c0", "a.b")


def test_stages_judge_rows_by_their_own_text(spark):
    """Nulls in every column, ids that repeat or are missing, equal rows, and extra columns by the stages' own names."""
    rng = random.Random(5)
    prose = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(30))
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    clean = {k: prose() for k in ("one", "two", "three", "four", "five", "six")}
    rows = [(None, clean["one"]), (None, clean["two"]), (7, clean["three"]), (7, clean["four"]), (8, clean["five"]), (8, clean["five"]), (None, clean["six"]), (9, clean["six"]), (None, leak), (7, leak), (10, None), (11, ""), (12, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    docs = spark.createDataFrame([(i, t, None, None, None, *CLASHING) for i, t in rows], schema)
    stages = dict(corpus_pipeline.STAGES)

    def after(name):
        out = stages[name](spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        got = out.collect()
        assert all(tuple(r[c] for c in CLASHING) == CLASHING for r in got)
        return Counter((r.doc_id, r.text) for r in got)

    assert after("toxicity") == Counter(rows)
    whole = after("line dedup")
    assert sum(whole.values()) == len(rows) and all(whole[i, t] for i, t in rows[:4])
    near = after("near-dedup")
    # A class of near copies keeps one row: that of a known id before one without, then that of the least id.
    assert near == Counter([*rows[:5], (9, clean["six"]), (7, leak), (10, None)])
    assert after("decontamination") == Counter(r for r in rows if r[1] != leak)
