"""Hand-computed cases of retrieval, ranking, text, layout and chunking."""

import pytest
from pyspark.sql import functions as F

from quill.config import RetrievalConfig
from quill.functions import text as T
from quill.functions import vector as V
from quill.functions.stem import stem
from quill.operators import chunking, layout, lexical, ranking, store
from quill.operators.embedding import DigestEncoder, embed
from quill.plans import retrieve as plans
from quill.sources import tables
from quill.telemetry import StageTimer


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def arm(spark, ids):
    return spark.createDataFrame([(1, c, r) for r, c in enumerate(ids, 1)], "query_id long, chunk_id long, rank long")


def test_chunking_identity():
    assert RetrievalConfig().chunking_sha256() == "b9e8df546d58a652563d39e66714329848d05ca4918a1d6d3accaeb36b696875"
    assert RetrievalConfig(final_top_k=9).chunking_sha256() == RetrievalConfig().chunking_sha256() != RetrievalConfig(chunk_tokens=9).chunking_sha256()
    assert RetrievalConfig.from_json(RetrievalConfig(rrf_k=7).to_json()).rrf_k == 7
    with pytest.raises(ValueError):
        RetrievalConfig(fusion="bm25")


@pytest.mark.parametrize("lists, ids", [([[1, 2, 3], [3, 1, 4]], [1, 3, 2, 4]), ([[9], [4]], [4, 9]), ([[5, 6, 7], []], [5, 6, 7]), ([[], []], []), ([[11, 22, 33]], [11, 22, 33])])
def test_fusion(spark, lists, ids):
    rows = ranking.reciprocal_rank_fusion([arm(spark, x) for x in lists]).orderBy("rank").collect()
    assert [r.chunk_id for r in rows] == ids and [r["rank"] for r in rows] == list(range(1, len(ids) + 1))


def test_rrf_score(spark):
    assert one(spark, V.rrf_score(F.array(F.lit(1), F.lit(3)), 60)) == pytest.approx(1 / 61 + 1 / 63)


@pytest.mark.parametrize("query, texts, want", [("warmup learning rate", ["nothing relevant here at all", "one warmup mention", "warmup warmup warmup learning rate"], [103, 102, 101]), ("query", ["query"] * 3, [101, 102, 103])])
def test_rerank(spark, query, texts, want):
    fused = arm(spark, range(101, 101 + len(texts))).withColumn("score", F.lit(1.0))
    chunks = spark.createDataFrame([(101 + i, t) for i, t in enumerate(texts)], "chunk_id long, content string")
    q = spark.createDataFrame([(1, query)], "query_id long, query string")
    out = ranking.rerank(fused, q, chunks, ranking.word_overlap_scorer(), 50, 3)
    assert [r.chunk_id for r in out.orderBy("rank").collect()] == want
    assert {r.reason for r in ranking.apply_floor(ranking.rerank(fused, q, chunks, ranking.constant_scorer(-3), 50, 3), 0.0).collect()} == {"below_score_floor"}
    assert {r.reason for r in ranking.apply_floor(ranking.rerank(fused, q, chunks, None, 50, 3, enabled=False), 999.0).collect()} == {None}


def test_lexical(spark):
    texts = ["Learning rate warmup stabilises transformer training in the early steps.", "Warmup schedules interact with the optimiser.", "Nothing here mentions the terms."]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string")
    q = spark.createDataFrame([(1, "warmup transformer training stabilises"), (2, "the of and"), (3, "???")], "query_id long, query string")
    rows = lexical.search(q, chunks, 5).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.chunk_id, r.score) for r in rows] == [(1, 0, round(4 / 14, 6)), (1, 1, round(1 / 11, 6))]


def test_stemmer():
    words = "caresses ponies running hopping relational generously happy knightly skies conditional hopeful adoption"
    assert [stem(w) for w in words.split()] == "caress poni run hop relat generous happi knight sky condit hope adopt".split()


@pytest.mark.parametrize("abbreviation", ["e.g.", "i.e.", "et al.", "Fig.", "Eq.", "Sec.", "cf.", "vs."])
def test_abbreviations_end_no_sentence(spark, abbreviation):
    assert len(one(spark, T.sentences(F.lit(f"We follow prior work {abbreviation} Smith and colleagues in this setup.")))) == 1


def test_sentence_offsets(spark):
    got = one(spark, T.sentences(F.lit("Alpha beta. Gamma delta. Alpha beta.")))
    assert [s.start for s in got] == [0, 12, 25] and one(spark, T.sentences(F.lit("   "))) == []


def words(n, marker):
    return " ".join([f"{marker.upper()}0", *[f"{marker}{i}" for i in range(1, n - 1)], "end."])


def chunks_of(spark, text, tokens, overlap):
    s = spark.createDataFrame([("p", "", 0, "Body", text, 0, False)], "paper_id string, title string, ordinal int, path string, text string, char_start int, is_references boolean")
    return chunking.chunk_sections(s, tokens, overlap, headers=False).orderBy("ordinal").collect()


def test_chunks(spark):
    text = " ".join(words(6, f"s{i}x") for i in range(9))
    assert [c.token_count for c in chunks_of(spark, text, 20, 0.0)] == [18, 18, 18]
    got = chunks_of(spark, text, 20, 0.5)
    assert got[1].content.startswith("S2X0") and all(c.token_count <= 20 for c in got)
    assert all(c.token_count <= 10 for c in chunks_of(spark, words(35, "w"), 10, 0.0)) and chunks_of(spark, "", 10, 0.0) == []


def sections_of(spark, lines):
    rows, at = [], 0
    for i, (t, bold) in enumerate(lines):
        rows.append(("p", i, t, at, at + len(t), 12.0 if bold else 10.0, bold))
        at += len(t) + 2
    frame = spark.createDataFrame(rows, "paper_id string, idx int, text string, char_start int, char_end int, font_size double, bold boolean")
    parsed = spark.createDataFrame([("p", "\n\n".join(t for t, _ in lines), 10.0)], "paper_id string, text string, body_font_size double")
    return layout.sections(layout.headings(frame, parsed), parsed).orderBy("ordinal").collect()


def test_sections(spark):
    got = sections_of(spark, [("1 Introduction", True), ("Prose.", False), ("3 Method", True), ("3.2 Training", True), ("4 Results", True), ("5 References", True)])
    assert [s.path for s in got] == ["1 Introduction", "3 Method", "3 Method > 3.2 Training", "4 Results", "5 References"] and got[-1].is_references
    assert [s.path for s in sections_of(spark, [("Only prose here.", False)])] == ["Body"]
    assert [s.path for s in sections_of(spark, [("A title", False), ("Abstract", True), ("Introduction", True)])] == ["Frontmatter", "Abstract", "Introduction"]


def test_dehyphenation_and_text(spark):
    lines = spark.createDataFrame([("p", 1, 0, 0, "re-"), ("p", 1, 0, 1, "joined"), ("p", 1, 1, 0, "next\x07")], "paper_id string, page int, block_position int, line int, text string")
    assert layout.document_text(layout.assemble(lines)).first().text == "rejoined\n\nnext"


def test_embedding_cache(spark):
    chunks = spark.createDataFrame([(i, f"text {i % 3}", f"d{i % 3}", "c") for i in range(6)], "chunk_id long, embed_input string, embed_input_sha256 string, chunk_config_sha256 string")
    empty = spark.createDataFrame([], "chunk_id long, model string, dim int, vec array<float>, chunk_config_sha256 string")
    assert store.embed_report(store.embed_plan(chunks, empty, "m")).first().asDict()["encoded"] == 3
    made = embed(chunks, empty, "m", lambda: DigestEncoder(8))
    assert made.count() == 6 and made.select("vec").distinct().count() == 3
    assert embed(chunks, made, "m", lambda: DigestEncoder(8)).count() == 0


def test_migrations(tmp_path):
    (tmp_path / "001_a.sql").write_text("x")
    (tmp_path / "010_b.sql").write_text("y")
    found = tables.discover(str(tmp_path))
    assert [m[0] for m in found] == [1, 10] and [m[0] for m in tables.pending(found, {1: found[0][2]})] == [10]
    for applied in ({1: "other"}, {10: found[1][2]}):
        with pytest.raises(tables.MigrationError):
            tables.pending(found, applied)


def test_timer():
    timer = StageTimer()
    timer.add("dense", 40)
    timer.add("lexical", 1.23456)
    timer.add("dense", 12)
    assert timer.snapshot() == {"dense": 52, "lexical": 1.235}


def test_retrieve_without_candidates(spark):
    q = spark.createDataFrame([(1, "???")], "query_id long, query string")
    c = spark.createDataFrame([(1, "text")], "chunk_id long, content string")
    out = plans.retrieve(q, c, None, RetrievalConfig(fusion="lexical_only"))
    assert out.count() == 0 and [(r.n, r.refused) for r in plans.summary(q, out).collect()] == [(0, False)]
