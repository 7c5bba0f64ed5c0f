"""Sentences, chunks, layout, ingest and the stored indexes against plain versions."""

import random
import re
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from quill.config import RetrievalConfig
from quill.functions import sentences as S
from quill.functions import text as T
from quill.functions.stem import stem
from quill.functions.tokens import WhitespaceCounter
from quill.operators import chunking, dense, layout, lexical, ranking, store
from quill.plans import benchmark, ingest
from quill.plans import retrieve as plans
from quill.telemetry import StageTimer

COUNTER = WhitespaceCounter()


def plain_pack(tokens, budget, overlap):
    """One sentence after the other, with the buffer itself."""
    out, pending = [], []
    for i, t in enumerate(tokens):
        if pending and sum(tokens[j] for j in pending) + t > budget:
            out.append((pending[0], pending[-1]))
            suffix = []
            if overlap > 0 and len(pending) > 1:
                for j in reversed(pending[1:]):
                    if sum(tokens[x] for x in suffix) + tokens[j] > overlap:
                        break
                    suffix.insert(0, j)
            pending = [] if sum(tokens[j] for j in suffix) + t > budget else suffix
        pending.append(i)
    return out + ([(pending[0], pending[-1])] if pending else [])


def test_packing_is_that_of_a_buffer():
    rng = random.Random(3)
    for _ in range(400):
        tokens = [rng.randint(0, 12) for _ in range(rng.randint(0, 40))]
        budget, overlap = rng.randint(1, 30), rng.randint(0, 12)
        assert S.pack(tokens, budget, overlap) == plain_pack(tokens, budget, overlap)


def test_pieces_are_as_long_as_fits():
    rng = random.Random(4)
    for _ in range(200):
        words = ["w" * rng.randint(1, 5) for _ in range(rng.randint(1, 60))]
        text, budget = "  ".join(words), rng.randint(1, 9)
        got = S.cut(text, 0, len(text), budget, COUNTER)
        assert [len(text[a:b].split()) for a, b, _ in got] == [min(budget, len(words) - i) for i in range(0, len(words), budget)]
        assert [n for *_, n in got] == [len(text[a:b].split()) for a, b, _ in got]


def test_long_texts_take_one_pass():
    text = "A short one. " * 200_000
    spans = S.split(text)
    own = S.fitted(text, spans, 64, COUNTER)
    assert len(spans) == 200_000 and len(S.pack([n for *_, n in own], 64, 9)) > 9_000


def test_figure_only_sentences_and_pages(spark):
    """Sentences that stand on figure-only pages alone are left out; pages are those that a chunk overlaps."""
    one, two, three = "Prose on page one. More of it. ", "Figure words. Axis labels. ", "The text goes on. And ends."
    text = one + two + three
    edges = [0, len(one), len(one) + len(two), len(text)]
    pages = [(i + 1, a, b) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    df = spark.createDataFrame([("p", "T", [(0, "Body", 0, text)], pages, [2])], f"paper_id string, title string, sections {chunking.SECTIONS}, pages {chunking.PAGES}, figure_only array<int>")
    got = chunking.chunk_papers(df, 100, 0.0, headers=False).collect()
    assert [(r.content, r.page_start, r.page_end) for r in got] == [("Prose on page one. More of it. The text goes on. And ends.", 1, 3)]
    kept = chunking.chunk_papers(df.withColumn("figure_only", F.lit(None).cast("array<int>")), 8, 0.0, headers=False).orderBy("ordinal").collect()
    assert [(r.page_start, r.page_end) for r in kept] == [(1, 1), (2, 3), (3, 3)] or "Figure words." in kept[1].content
    rng = random.Random(8)
    for _ in range(200):
        cuts = sorted(rng.sample(range(1, 200), 5))
        own = [{"page": i + 1, "char_start": a, "char_end": b} for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, 200], strict=True))]
        where = S.Pages(own, [2, 3])
        a = rng.randint(0, 198)
        b = rng.randint(a + 1, 200)
        met = [p["page"] for p in own if p["char_start"] < b and p["char_end"] > a]
        assert where.range(a, b) == (min(met), max(met)) and where.only_figures(a, b) == (set(range(min(met), max(met) + 1)) <= {2, 3})


def test_bold(spark):
    rows = [(16, "Times"), (0, "Times-BOLD"), (4, "CMR-bd"), (15, "Times"), (20, "x")]
    df = spark.createDataFrame(rows, "flags int, font string")
    assert [r.b for r in df.select(layout.is_bold(F.col("flags"), F.col("font")).alias("b")).collect()] == [True, True, True, False, True]


def plain_order(blocks):
    """Blocks (id, x0, y0, x1, y1) of a page 600 wide, in reading order."""
    wide = [b for b in blocks if b[3] - b[1] > 0.65 * 600]
    left = [b for b in blocks if b not in wide and (b[1] + b[3]) / 2 < 300]
    right = [b for b in blocks if b not in wide and b not in left]
    if len(left) < 2 or len(right) < 2:
        return [b[0] for b in sorted(blocks, key=lambda b: (b[2], b[1], b[0]))], False
    out, top = [], float("-inf")
    for w in [*sorted(wide, key=lambda b: (b[2], b[1], b[0])), None]:
        bottom = w[2] if w else float("inf")
        for column in (left, right):
            out += [b[0] for b in sorted(column, key=lambda b: (b[2], b[1], b[0])) if top <= b[2] < bottom]
        if w:
            out.append(w[0])
            top = w[4]
    return out, True


def test_reading_order(spark):
    rng = random.Random(6)
    pages = []
    for p in range(40):
        blocks, y = [], 0
        for i in range(rng.randint(1, 14)):
            kind = rng.choice(["wide", "left", "left", "right", "right"])
            x0, x1 = {"wide": (50, 550), "left": (50, 290), "right": (310, 550)}[kind]
            y += rng.randint(1, 40)
            blocks.append((i, float(x0), float(y), float(x1), float(y + rng.randint(5, 20))))
        # Separators don't overlap one another here.
        seps = sorted((b for b in blocks if b[3] - b[1] > 390), key=lambda b: b[2])
        gone = {b[0] for a, b in zip(seps, seps[1:], strict=False) if b[2] < a[4]}
        pages.append([b for b in blocks if b[0] not in gone])
    rows = [("p", n, b[0], 0.0, 600.0, *b[1:]) for n, blocks in enumerate(pages) for b in blocks]
    df = spark.createDataFrame(rows, "paper_id string, page int, block int, page_x0 double, page_x1 double, x0 double, y0 double, x1 double, y1 double")
    got = {}
    for r in layout.reading_order(df).orderBy("page", "position").collect():
        got.setdefault(r.page, ([], r.two_columns))[0].append(r.block)
    for n, blocks in enumerate(pages):
        assert got[n] == plain_order(blocks), n
    assert {two for _, two in got.values()} == {True, False}


def spans_of(paper, lines, error=None):
    """Spans of a file of one column: (page, text, size)."""
    box = (0.0, 0.0, 600.0, 800.0)
    return [(paper, page, *box, i, 50.0, 20.0 * i, 500.0, 20.0 * i + 10, 0, 0, text, size, "Times", 0, error) for i, (page, text, size) in enumerate(lines)]


SPANS = "paper_id string, page int, page_x0 double, page_y0 double, page_x1 double, page_y1 double, block int, x0 double, y0 double, x1 double, y1 double, line int, span int, text string, size double, font string, flags int, error string"


def test_ingest(spark):
    prose = "Training goes well here. " * 20
    lines = [(1, "1 Introduction", 14.0), (1, prose, 10.0), (2, "Figure 1 shows it.", 10.0), (3, "2 Method", 14.0), (3, prose, 10.0), (3, "References", 14.0), (3, "Smith 2001. A paper.", 10.0)]
    rows = spans_of("a", lines) + spans_of("b", [(1, prose, 10.0)]) + spans_of("c", [(1, None, None)], "ValueError: bad")
    spans = spark.createDataFrame(rows, SPANS)
    kind = "id string, title string, pdf_sha256 string"
    corpus = spark.createDataFrame([("a", "Paper A", "1"), ("b", "Paper B", "2"), ("c", "Paper C", "3"), ("d", "Paper D", None), ("e", "Paper E", "5"), ("f", "Paper F", "6")], kind)
    config = RetrievalConfig(chunk_tokens=40)
    stored = spark.createDataFrame([("e", "Old E", "5"), ("f", "Old F", "0")], kind)
    there = spark.createDataFrame([(7, i, 0, "x", config.chunking_sha256()) for i in ("e", "f")], "chunk_id long, paper_id string, ordinal long, content_sha256 string, chunk_config_sha256 string")
    done = ingest.ingest(corpus, spans, stored, there, config)
    status = {r.paper_id: r for r in done.status.collect()}
    assert {k: (r.status, r.reason) for k, r in status.items()} == {"a": ("ingested", None), "b": ("ingested", None), "c": ("failed", "ValueError: bad"), "d": ("failed", "no file"), "e": ("skipped", None), "f": ("failed", "no text")}
    assert not status["a"].used_fallback and status["b"].used_fallback and not status["a"].two_columns
    chunks = done.chunks.orderBy("chunk_id").collect()
    assert [r.chunk_id for r in chunks] == list(range(8, 8 + len(chunks))) and status["a"].chunks_inserted == sum(r.paper_id == "a" for r in chunks)
    own = [r for r in chunks if r.paper_id == "a"]
    assert [r.ordinal for r in own] == list(range(len(own))) and {r.section_path for r in own} == {"1 Introduction", "2 Method"}
    assert not any("Figure 1 shows" in r.content or "Smith" in r.content for r in own) and own[0].embed_input.startswith("Paper A — 1 Introduction\n\n")
    assert {(r.page_start, r.page_end) for r in own} == {(1, 1), (3, 3)} and all(r.token_count <= 40 for r in own)
    assert {r.id: r.title for r in done.papers.collect()} == {"a": "Paper A", "b": "Paper B", "e": "Old E", "f": "Old F"}
    both = there.unionByName(done.chunks.select(there.columns))
    again = ingest.ingest(corpus.where("id in ('a', 'b')"), spans, done.papers.select("id", "title", "pdf_sha256"), both, config)
    assert again.chunks.count() == 0 and ingest.report(again.status).first().papers_skipped_unchanged == 2
    other = ingest.ingest(corpus, spans, stored, there, RetrievalConfig(chunk_tokens=40, drop_figure_only_pages=False, drop_references=False, contextual_headers=False)).chunks.collect()
    assert any("Figure 1 shows" in r.content for r in other) and any("Smith" in r.content for r in other) and all(r.content == r.embed_input for r in other)
    report = ingest.report(done.status).first()
    assert (report.papers_seen, report.papers_ingested, report.papers_skipped_unchanged, report.papers_failed, report.section_fallbacks, report.two_column_papers) == (6, 2, 1, 3, 1, 0)


def test_numbers_without_one_task(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["hot"] * 5 + ["a", "b", None]), rng.choice([None, *map(float, range(50))])) for _ in range(500)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r.p for r in store.nearest_rank_by(df, "k", "v", 0.95, "p").collect()}
    for key in ("hot", "a", "b", None):
        own = sorted(v for k, v in rows if k == key and v is not None)
        assert got[key] == own[round(0.95 * (len(own) - 1))]
    numbers = store.numbered(df, ("k", "v"), "n").collect()
    first = lambda r: (r.k is not None, r.k or "", r.v is not None, r.v or 0)
    assert sorted(r.n for r in numbers) == list(range(1, 501)) and [first(r) for r in sorted(numbers, key=lambda r: r.n)] == sorted(map(first, numbers))


def test_bare_ids_find_the_latest_version(spark):
    meta = spark.createDataFrame([("pv9", 9), ("pv10", 10), ("qv1", 1), ("cs/1v2", 2)], "id string, n int")
    ids = spark.createDataFrame([(0, "p"), (1, "qv1"), (2, "p"), (3, "cs/1"), (4, "z")], "position long, id string")
    assert [(r.id, r.position) for r in store.fetch_by_ids(ids, meta).orderBy("position").collect()] == [("pv10", 0), ("qv1", 1), ("cs/1v2", 3)]
    assert [r.id for r in store.missing_ids(ids, meta).collect()] == ["z"]


DOCS = [(1, "The learner was learning to learn rates.", "c"), (2, "Rates of optimisers and their rating", "c"), (3, None, "c"), (4, "the of and", "d"), (5, "Learned nothing, rated twice", "d")]


@pytest.mark.parametrize("stemmed", [True, False])
def test_lexemes_and_stored_postings(spark, tmp_path, stemmed):
    chunks = spark.createDataFrame(DOCS, "chunk_id long, content string, chunk_config_sha256 string")
    form = stem if stemmed else str
    want = {}
    for i, text, key in DOCS:
        for w in re.findall(r"\w+", (text or "").lower()):
            if w not in T.STOP_WORDS:
                want[key, form(w), i] = want.get((key, form(w), i), 0) + 1
    lexical.write_index(chunks, str(tmp_path / "i"), stemmed)
    index = spark.read.parquet(str(tmp_path / "i"))
    for df in (index, lexical.postings(chunks, stemmed, keep=("chunk_config_sha256",))):
        assert {(r.chunk_config_sha256, r.lexeme, r.chunk_id): r.tf for r in df.collect()} == want
    q = spark.createDataFrame([(1, "learning rate"), (2, "the"), (3, "")], "query_id long, query string")
    both = [lexical.search(q, chunks, 5, stemmed).collect(), lexical.search(q, None, 5, stemmed, index).collect()]
    assert sorted(both[0]) == sorted(both[1]) and {r.query_id for r in both[0]} <= {1}
    assert [r.chunk_id for r in sorted(both[0], key=lambda r: r["rank"])] == ([1, 2, 5] if stemmed else [1])
    plan = lexical.search(q, None, 5, stemmed, plans.one_chunking(index, "d"))
    assert {r.chunk_id for r in plan.collect()} == ({5} if stemmed else set())


def test_ranks_go_by_whole_scores(spark):
    rows = [(1, 1, 5000), (1, 2, 5001), (1, 3, 5001), (1, 4, 4000)]
    df = spark.createDataFrame(rows, "query_id long, chunk_id long, n long").select("query_id", "chunk_id", lexical.score(F.col("n")).alias("score"))
    assert [r.chunk_id for r in lexical.top(df, 3).orderBy("rank").collect()] == [2, 3, 1]


def test_dense_search_and_index(spark, tmp_path):
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(12, 24))
    rows = [(i, (middle[i % 12] + 0.6 * rng.normal(size=24)).tolist()) for i in range(600)]
    rows += [(1000, rows[5][1]), (1001, None), (1002, [0.0] * 24), (1003, [1.0, 2.0]), (1004, [float("nan")] * 24)]
    vectors = spark.createDataFrame(rows, "chunk_id long, vec array<double>")
    asked = [(i, (middle[i % 12] + 0.5 * rng.normal(size=24)).tolist()) for i in range(20)] + [(50, rows[5][1]), (51, None), (52, [1.0, 1.0])]
    queries = spark.createDataFrame(asked, "query_id long, vec array<double>")
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v is not None and np.isfinite(v).all() and np.any(v)}
    want = {}
    for q, v in asked:
        if v is not None:
            u = np.array(v) / np.linalg.norm(v)
            want[q] = [i for _, i in sorted((-round(float(u @ x), 12), i) for i, x in unit.items() if len(x) == len(u))[:10]]

    def ids(df):
        out = {}
        for r in df.orderBy("query_id", "rank").collect():
            out.setdefault(r.query_id, []).append(r.chunk_id)
        return out

    assert ids(dense.search(queries, vectors, 10)) == want and want[50][:2] == [5, 1000]
    dense.write_index(vectors, str(tmp_path / "i"), 16)
    index = dense.read_index(spark, str(tmp_path / "i"))
    own = queries.where("query_id <> 52")
    assert ids(index.probed(own, 10, 16)) == {k: v for k, v in want.items() if k != 52}
    found = ids(index.probed(own, 10, 4))
    assert statistics.fmean(len(set(found[k]) & set(v)) / 10 for k, v in want.items() if k != 52) >= 0.9
    read = benchmark._read_share(index, own, 4, {r[0]: r[1] for r in index.codes.groupBy("cell").count().collect()})
    assert read <= 0.4
    wide = ids(index.widened(own, 100, 1))
    assert all(len(x) == 100 for x in wide.values())
    with pytest.raises(RuntimeError):
        benchmark.benchmark_index(spark, queries.limit(0), vectors, str(tmp_path / "i"))
    report = benchmark.benchmark_index(spark, own.where("query_id < 3"), vectors, str(tmp_path / "j"), 8, (0.25, 1.0))
    text = benchmark.lines(report)
    assert any("build time" in x for x in text) and len(text) == 8 and report.where("n_probe = 8").first().recall_at_10 == 1.0
    assert benchmark.percentile([], 0.5) == 0.0 and benchmark.percentile([3.0, 1.0, 2.0, 9.0], 0.5) == 3.0


def test_single_arms_models_and_runs(spark):
    chunks = spark.createDataFrame([(i, f"alpha {'beta ' * (i % 3)}", "S", f"p{i % 2}", 1, 2, 0, 9) for i in range(6)], "chunk_id long, content string, section_path string, paper_id string, page_start int, page_end int, char_start int, char_end int")
    vectors = spark.createDataFrame([(i, [1.0, float(i)], m) for i in range(6) for m in ("m", "n") if not (m == "n" and i < 5)], "chunk_id long, vec array<double>, model string").withColumn("chunk_config_sha256", F.lit("k"))
    q = spark.createDataFrame([(1, "beta", [1.0, 0.0]), (2, "zzz", None)], "query_id long, query string, vec array<double>")
    keyed = chunks.withColumn("chunk_config_sha256", F.lit("k"))
    ids = lambda df: [r.chunk_id for r in df.where("query_id = 1").orderBy("rank").collect()]
    off = {"rerank_enabled": False, "final_top_k": 9}
    assert ids(plans.retrieve(q, keyed, vectors, RetrievalConfig(fusion="lexical_only", **off))) == [2, 5, 1, 4]
    assert ids(plans.retrieve(q, keyed, vectors, RetrievalConfig(fusion="dense_only", **off), chunking="k", model="m")) == [0, 1, 2, 3, 4, 5]
    assert ids(plans.retrieve(q, keyed, vectors, RetrievalConfig(fusion="dense_only", **off), chunking="k", model="n")) == [5]
    assert ids(plans.retrieve(q, keyed, vectors, RetrievalConfig(dense_enabled=False, **off))) == [2, 5, 1, 4]
    assert plans.retrieve(q, keyed, vectors, RetrievalConfig(dense_enabled=False, lexical_enabled=False)).count() == 0
    assert ranking.reciprocal_rank_fusion([]) is None
    papers = spark.createDataFrame([("p0", "Zero"), ("p1", "One")], "id string, title string")
    timer = StageTimer()
    got = plans.run(q, keyed, vectors.where("model = 'm'"), papers, RetrievalConfig(final_top_k=3), timer=timer)
    rows = got.candidates.where("query_id = 1").orderBy("rank").collect()
    assert [r.chunk_id for r in rows] == [2, 5, 1] and rows[0].paper_title == "Zero" and rows[0].content.startswith("alpha beta") and rows[0].page_end == 2 and rows[0].char_end == 9
    assert list(got.timings_ms) == ["dense_ms", "lexical_ms", "fusion_ms", "rerank_ms"] and all(v > 0 for v in got.timings_ms.values())
    one, two = got.summary.orderBy("query_id").collect()
    assert (one.n, one.dense_count, one.lexical_count, one.fused_count) == (3, 6, 4, 6) and (two.n, two.fused_count, two.refused) == (0, 0, False)
    stats = {r.query_id: r for r in got.stats.collect()}
    assert stats[1].scored == 6 and stats[1].survivors == 3 and (stats[2].survivors, stats[2].mean_movement, stats[2].scored, stats[2].truncation_rate) == (0, 0.0, 0, 0.0)
    refused = plans.run(q, keyed, vectors.where("model = 'm'"), papers, RetrievalConfig(score_floor=99.0))
    assert refused.candidates.count() == 0 and refused.summary.where("query_id = 1").first().refused


def test_a_stage_that_raises_is_timed():
    timer = StageTimer(clock=iter([1.0, 1.5]).__next__)
    with pytest.raises(ValueError), timer.stage("x"):
        raise ValueError
    assert timer.snapshot() == {"x": 500.0}
