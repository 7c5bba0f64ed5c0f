"""Hand-computed cases of stored tables, scalar functions and measures."""

import pytest
from pyspark.sql import functions as F

from quill.functions import text as T
from quill.functions import vector as V
from quill.operators import chunking, ranking, store


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("passage, query, want", [("Warmup, warmup. The end", "warmup the", 3.0), ("a b", "c", 0.0), ("", "a", 0.0), ("a a", None, 0.0), ("a .,? a", "a .", 2.0)])
def test_word_overlap(spark, passage, query, want):
    assert one(spark, T.word_overlap(F.lit(passage).cast("string"), T.overlap_terms(F.lit(query).cast("string")))) == want


def test_chunks_stand_at_their_offsets(spark):
    text = " ".join(f"S{i} " + " ".join(f"w{k}" for k in range(i % 5)) + " end." for i in range(40)).replace("  ", " ")
    rows = [("p", "", 0, "A", text, 0, False), ("p", "", 1, "B", text, len(text), False), ("q", "", 0, "A", None, 0, False), ("r", "", 0, "References", text, 0, True)]
    sections = spark.createDataFrame(rows, "paper_id string, title string, ordinal int, path string, text string, char_start int, is_references boolean")
    got = chunking.chunk_sections(sections, 20, 0.2, headers=False).orderBy("paper_id", "ordinal").collect()
    assert {c.paper_id for c in got} == {"p"} and [c.ordinal for c in got] == list(range(len(got)))
    assert all(c.content == (text + text)[c.char_start : c.char_end] == c.embed_input for c in got)
    assert [c.section_path for c in got] == sorted(c.section_path for c in got)


@pytest.mark.parametrize("values, fraction, want", [([4, 2, 1, 3], 0.5, 3.0), ([2, 1], 0.5, 1.0), ([7], 0.95, 7.0), ([], 0.5, 0.0)])
def test_nearest_rank_rounds_halves_to_even(spark, values, fraction, want):
    assert one(spark, V.nearest_rank(F.lit(None).cast("array<double>") if not values else F.array(*[F.lit(float(v)) for v in values]), fraction)) == want


def test_recall(spark):
    arm = lambda ids: spark.createDataFrame([(1, c, r) for r, c in enumerate(ids, 1)], "query_id long, chunk_id long, rank long")
    assert ranking.recall_at_k(arm([1, 2, 3]), arm([2, 9, 1]), 2).first().recall == 0.5
    assert ranking.recall_at_k(arm([]), arm([2]), 2).first().recall == 0.0


def test_inserts_and_upserts(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "x")], "id long, title string, kept string")
    new = spark.createDataFrame([(2, "B", "y"), (3, "c", "y"), (3, "d", "y")], "id long, title string, kept string")
    assert [tuple(r) for r in store.insert_ignore(old, new, ("id",), ("title",)).collect()] == [(3, "c", "y")]
    assert store.insert_ignore(new, new, ("id",)).count() == 0
    got = store.upsert(old, new.where("title <> 'd'"), "id", ("title",)).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "a", "x"), (2, "B", "x"), (3, "c", None)]


def test_fetch_by_ids(spark):
    asked = spark.createDataFrame([(0, "b"), (1, "av2"), (2, "bv1"), (3, "z")], "position long, id string")
    stored = spark.createDataFrame([("av2", "A"), ("bv1", "B"), ("cv1", "C")], "id string, title string")
    got = store.fetch_by_ids(asked, stored).orderBy("position").collect()
    assert [(r.id, r.position) for r in got] == [("bv1", 0), ("av2", 1)]
    assert [r.id for r in store.missing_ids(asked, stored).collect()] == ["z"]
