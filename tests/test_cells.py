"""The maintained index of cells against exact search and against an index that is built anew."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quill.operators import cells, dense, store
from quill.sources import commits


def hits(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in df.collect())


def recall(found, truth):
    pair = lambda rows: {(q, c) for q, _, c, _ in rows}
    return len(pair(found) & pair(truth)) / len(pair(truth))


def table(spark, rows):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in rows], "chunk_id long, vec array<double>")


def asked(spark, rows):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in rows], "query_id long, vec array<double>")


def test_spread_vectors_are_found_with_a_quarter_of_the_codes(spark, tmp_path):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(1500, 48))
    vectors, queries = table(spark, enumerate(m)), asked(spark, enumerate(rng.normal(size=(60, 48))))
    dense.write_index(vectors, str(tmp_path / "i"))
    index = dense.read_index(spark, str(tmp_path / "i"))
    assert len(index.centres) == cells.cells_for(1500) == 232
    breadth = len(index.centres) * 2 // 9
    assert cells.read_share(index, queries, breadth) <= 0.25
    truth = hits(dense.search(queries, vectors, 10))
    assert recall(hits(index.probed(queries, 10, breadth)), truth) >= 0.9
    assert hits(index.probed(queries, 10, len(index.centres))) == truth


def test_inserts_and_deletes_equal_a_new_index(spark, tmp_path):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(400, 17))
    queries = asked(spark, enumerate(rng.normal(size=(12, 17))))
    path = str(tmp_path / "i")
    dense.write_index(table(spark, list(enumerate(m))[:250]), path, 20)
    index = dense.read_index(spark, path)
    live = dict(list(enumerate(m))[:250])

    def agrees(index):
        dense.write_index(table(spark, live.items()), str(tmp_path / "new"), like=index)
        new = dense.read_index(spark, str(tmp_path / "new"))
        assert hits(index.probed(queries, 5, 4)) == hits(new.probed(queries, 5, 4))
        again = dense.read_index(spark, path)
        assert again.state == index.state and sorted(r.chunk_id for r in again.vectors.select("chunk_id").collect()) == sorted(live)

    index = index.upsert(table(spark, [(i, m[i]) for i in range(250, 400)]))  # new ones
    live |= {i: m[i] for i in range(250, 400)}
    index = index.delete(spark.range(0, 60).withColumnRenamed("id", "chunk_id"))
    live = {i: v for i, v in live.items() if i >= 60}
    index = index.upsert(table(spark, [(i, -m[i]) for i in range(40, 80)]))  # some come back, some change
    live |= {i: -m[i] for i in range(40, 80)}
    agrees(index)
    assert len(index.segments) == 3
    part = index.merge()  # the newest are small
    agrees(part)
    assert len(part.segments) < 3
    late = cells.read_index(spark, path)
    gone = late.delete(spark.range(300, 310).withColumnRenamed("id", "chunk_id"))
    whole = part.merge(all_segments=True)  # made without knowing of the delete, which stays in force
    live = {i: v for i, v in live.items() if not 300 <= i < 310}
    assert len(whole.segments) == 1 and whole.state.version == gone.state.version + 1
    agrees(whole)
    with pytest.raises(commits.Conflict):
        part.merge(all_segments=True)  # its segments are merged already
    assert not cells.read_index(spark, path).log.abandoned()


def test_many_segments_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cells, "SEGMENTS", 2)
    rng = np.random.default_rng(3)
    path = str(tmp_path / "i")
    dense.write_index(table(spark, enumerate(rng.normal(size=(50, 6)))), path, 4)
    index = dense.read_index(spark, path)
    for i in range(3):
        index = index.upsert(table(spark, [(100 + i, rng.normal(size=6))])).maintained()
        assert len(index.segments) <= cells.SEGMENTS
    assert index.vectors.count() == 53


def test_odd_vectors(spark, tmp_path):
    rows = [(1, [1.0, 0.0, 0.0]), (2, None), (3, [0.0, 0.0, 0.0]), (4, [1.0, 2.0]), (5, [float("nan"), 1.0, 1.0]), (6, [0.0, 1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "chunk_id long, vec array<double>")
    dense.write_index(vectors, str(tmp_path / "i"), 2)
    index = dense.read_index(spark, str(tmp_path / "i"))
    assert [r[2] for r in hits(index.probed(asked(spark, [(0, [1.0, 0.1, 0.0])]), 5, 2))] == [1, 6]
    assert index.probed(asked(spark, [(0, [1.0, 0.1])]), 5, 2).count() == 0
    index = index.upsert(spark.createDataFrame([(1, None)], "chunk_id long, vec array<double>"))
    assert [r[2] for r in hits(index.probed(asked(spark, [(0, [1.0, 0.1, 0.0])]), 5, 2))] == [6]
    dense.write_index(vectors.limit(0), str(tmp_path / "empty"))
    assert dense.read_index(spark, str(tmp_path / "empty")).widened(asked(spark, [(0, [1.0])]), 5, 1).count() == 0


def test_command_line_index_follows_the_tables(spark, tmp_path, capsys):
    from quill import cli
    from quill.config import RetrievalConfig
    from quill.operators import embedding, impacts
    from quill.sources import tables

    for t in tables.SCHEMAS:
        spark.sql(f"DROP TABLE IF EXISTS {t}")
    tables.create(spark)
    key, model = RetrievalConfig().chunking_sha256(), RetrievalConfig().embedding_model
    encoder = embedding.DigestEncoder()

    def add(ids):
        rows = [(i, f"p{i}", 0, f"chunk number w{i} about learning", key) for i in ids]
        chunks = spark.createDataFrame(rows, "chunk_id long, paper_id string, ordinal long, content string, chunk_config_sha256 string")
        known = dict(spark.read.table("chunks").dtypes)
        full = chunks.select(*[(chunks[c] if c in chunks.columns else F.lit(None)).cast(k).alias(c) for c, k in known.items()])
        tables.append_new(full.withColumn("content_sha256", F.sha2("content", 256)), "chunks", store.CHUNK_KEY)
        vectors = [(i, model, 3, encoder.encode_documents([f"t{i}"])[0], key) for i in ids]
        tables.append_new(spark.createDataFrame(vectors, tables.SCHEMAS["embeddings"]), "embeddings", store.VECTOR_KEY)

    path = str(tmp_path / "index")
    add(range(6))
    assert cli.main(["index", path]) == 0 and "cells: version 2, 1 segments" in capsys.readouterr().out
    add(range(6, 9))
    assert cli.main(["index", path]) == cli.main(["index", path]) == 0
    assert capsys.readouterr().out.count("version 3, 2 segments") == 4  # the second run finds nothing new
    assert sorted(r.chunk_id for r in impacts.read_index(spark, f"{path}/blocks").ids.collect()) == list(range(9))
    assert sorted(r.chunk_id for r in cells.read_index(spark, f"{path}/cells").vectors.collect()) == list(range(9))
    tables.replace(tables.read(spark, "chunks").where("chunk_id <> 8"), "chunks")
    assert cli.main(["index", path]) == 0
    assert cli.main(["search", "w7 learning", "--index", path, "--fusion", "lexical_only", "--top-k", "1"]) == 0
    assert "[7]" in capsys.readouterr().out
    for t in tables.SCHEMAS:
        spark.sql(f"DROP TABLE IF EXISTS {t}")


def test_a_search_of_all_cells_is_exact_among_vectors_too_close_for_their_codes(spark, tmp_path):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=24)
    near = [centre + 1e-3 * rng.normal(size=24) for _ in range(800)]
    vectors = table(spark, enumerate([*near, *rng.normal(size=(400, 24))]))
    queries = asked(spark, enumerate(centre + 1e-3 * rng.normal(size=(8, 24))))
    dense.write_index(vectors, str(tmp_path / "i"), cells=12)
    index = dense.read_index(spark, str(tmp_path / "i"))
    assert hits(index.widened(queries, 10, len(index.centres))) == hits(dense.search(queries, vectors, 10))
    assert hits(index.delete(vectors.where("chunk_id < 400")).widened(queries, 10, 99)) == hits(dense.search(queries, vectors.where("chunk_id >= 400"), 10))
