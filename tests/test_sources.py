"""Sources, sinks, tables, streams, the command line and the registries."""

import json
import urllib.error
from datetime import date

import pytest
from pyspark.sql import functions as F

from quill import cli, registry
from quill.config import RetrievalConfig
from quill.functions.tokens import VocabularyCounter, WhitespaceCounter, token_count
from quill.operators import embedding, ranking, store
from quill.sources import metadata, pdf, shared, tables
from quill.streaming import incremental

ENTRY = (
    "<entry><id>http://arxiv.org/abs/{id}</id><title>{title}</title><summary> An\n abstract </summary><published>2020-01-31T23:30:00Z</published><author><name>A  One</name></author>"
    '<author><name>B Two</name></author><category term="cs.LG"/><category term="cs.CL"/>{pdf}</entry>'
)


def feed(*entries):
    return ('<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom">' + "".join(entries) + "</feed>").encode()


def entry(i, title="A\n  title", pdf=""):
    return ENTRY.format(id=i, title=title, pdf=pdf)


LINK = '<link title="pdf" href="http://x/p.pdf" rel="related"/>'


def test_atom_by_spark_and_on_the_driver(spark, tmp_path):
    broken = "<entry><id>http://arxiv.org/abs/9v1</id><summary>s</summary><published>2020-01-01T00:00:00Z</published></entry>"
    answer = feed(entry("2001.1v2"), entry("cs/99v1", pdf=LINK), broken)
    (tmp_path / "a.xml").write_bytes(answer)
    here = metadata.parse_atom(answer)
    assert [(e["id"], e["title"], e["pdf_url"]) for e in here] == [("2001.1v2", "A title", "https://arxiv.org/pdf/2001.1v2"), ("cs/99v1", "A title", "http://x/p.pdf")]
    there = {r.id: r.asDict() for r in metadata.read_atom(spark, str(tmp_path / "a.xml")).collect()}
    assert there == {e["id"]: e for e in here}
    assert here[0]["published_at"] == date(2020, 1, 31) and here[0]["authors"] == ["A One", "B Two"] and here[0]["categories"] == ["cs.LG", "cs.CL"] and here[0]["abstract"] == "An abstract"


def error(code):
    return urllib.error.HTTPError("u", code, "m", None, None)


def test_fetcher_waits_and_tries_again():
    now, slept, answers = [0.0], [], [error(503), OSError("gone"), b"ok", b"next"]

    def sleep(s):
        slept.append(s)
        now[0] += s

    def get(_):
        a = answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a

    f = metadata.Fetcher(get=get, sleep=sleep, clock=lambda: now[0])
    assert f.get("u") == b"ok" and slept[:3] == [3, 6] + slept[2:3] and f.get("u") == b"next"
    assert slept[-1] == 3.0
    for code, tries in ((404, 1), (429, 5)):
        left = [error(code)] * 9
        g = metadata.Fetcher(get=lambda _, left=left: (_ for _ in ()).throw(left.pop()), sleep=lambda s: None, clock=lambda: 0.0)
        with pytest.raises(urllib.error.HTTPError):
            g.get("u")
        assert 9 - len(left) == tries


def test_search_and_fetch_by_ids():
    pages = {0: [f"{i}v1" for i in range(3)], 3: ["2v1", "7v1"], 4: []}
    asked = []

    def get(url):
        asked.append(url)
        start = int(url.split("start=")[1].split("&")[0])
        return feed(*[entry(i) for i in pages.get(start, [])])

    f = metadata.Fetcher(get=get, sleep=lambda s: None, clock=lambda: 0.0)
    assert [e["id"] for e in f.search(["cs.LG", "cs.CL"], 10, page=3)] == ["0v1", "1v1", "2v1", "7v1"]
    assert "cat%3Acs.LG+OR+cat%3Acs.CL" in asked[0] and [e["id"] for e in f.search(["x"], 2)] == ["0v1", "1v1"]
    g = metadata.Fetcher(get=lambda url: feed(*[entry(i) for i in ("5v9", "5v10", "6v1")]), sleep=lambda s: None, clock=lambda: 0.0)
    assert [e["id"] for e in g.by_ids(["6v1", "5", "5v9", "8", "6"])] == ["6v1", "5v10", "5v9"]


def test_files_are_kept_whole(tmp_path):
    calls = []
    f = metadata.Fetcher(get=lambda u: calls.append(u) or b"data", sleep=lambda s: None, clock=lambda: 0.0)
    path = tmp_path / "c" / metadata.file_name("cs/99v1")
    assert f.to_file("u", str(path)) == str(path) and path.name == "cs_99v1.pdf" and path.read_bytes() == b"data"
    f.to_file("u", str(path))
    path.write_bytes(b"")
    f.to_file("u", str(path))
    assert len(calls) == 2 and not list(path.parent.glob("*.part"))


def test_manifest_round_trip(spark, tmp_path):
    rows = [("b", "Title two", date(2020, 1, 2)), ("a", "T" * 200, date(2021, 1, 2)), ("c", "Three", date(2020, 1, 2))]
    papers = spark.createDataFrame(rows, "id string, title string, published_at date")
    metadata.write_manifest(papers, str(tmp_path / "m"), ("two papers", "of cs"))
    lines = [x for f in sorted((tmp_path / "m").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines == ["# two papers", "# of cs", "a  # " + "T" * 90, "c  # Three", "b  # Title two"]
    (tmp_path / "m2").write_text("x1 # one\n\n  # none\n y2  \n")
    assert [r.id for r in metadata.read_manifest(spark, str(tmp_path / "m2")).collect()] == ["x1", "y2"]


def test_corpus_and_extraction(spark, tmp_path):
    (tmp_path / "cs_1.pdf").write_bytes(b"one\ntwo")
    (tmp_path / "2.pdf").write_bytes(b"bad")
    files = metadata.read_files(spark, str(tmp_path))
    papers = spark.createDataFrame([("cs/1", "A"), ("2", "B"), ("3", "C")], "id string, title string")
    got = {r.id: r for r in metadata.corpus(papers, files).collect()}
    assert got["3"].pdf_sha256 is None and got["cs/1"].path.endswith("cs_1.pdf") and len(got["2"].pdf_sha256) == 64

    def extractor(content):
        if content == b"bad":
            raise ValueError("no pages")
        return [{"page": 1, "block": i, "line": 0, "span": 0, "text": t} for i, t in enumerate(content.decode().split("\n"))]

    spans = pdf.extract_spans(files, extractor).orderBy("path", "block").collect()
    assert [(r.text, r.error) for r in spans] == [(None, "ValueError: no pages"), ("one", None), ("two", None)]


def test_appends_and_batches(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS some_vectors")
    spark.createDataFrame([], "chunk_id long, model string, dim int").write.mode("overwrite").saveAsTable("some_vectors")
    new = spark.createDataFrame([(1, "m", 3), (1, "m", 3), (2, "m", 3)], "chunk_id long, model string, dim int")
    assert [tables.append_new(new, "some_vectors", store.VECTOR_KEY, ("dim",)) for _ in range(2)] == [2, 0]
    tables.replace(spark.read.table("some_vectors").withColumn("dim", F.col("dim") + 1), "some_vectors")
    assert sorted(r.dim for r in spark.read.table("some_vectors").collect()) == [4, 4]
    spark.sql("DROP TABLE some_vectors")
    path = str(tmp_path / "t")
    assert tables.append_batch(new, path, "0") and not tables.append_batch(new, path, "0") and tables.append_batch(new, path, "1")
    assert spark.read.parquet(path).count() == 6 and not [f for f in (tmp_path / "t").iterdir() if f.name.startswith("_")]
    assert tables.folder_bytes(spark, path) > 0 == tables.folder_bytes(spark, path + "x")


def test_migrations_run_once(spark, tmp_path):
    for t in ("quill_migrated", "quill_versions"):
        spark.sql(f"DROP TABLE IF EXISTS {t}")
    (tmp_path / "001_one.sql").write_text("-- a table\nCREATE TABLE quill_migrated (a INT) USING parquet;\nINSERT INTO quill_migrated VALUES (1);")
    assert tables.status(spark, str(tmp_path), "quill_versions") == [(1, "one", False)]
    assert tables.migrate(spark, str(tmp_path), "quill_versions") == [1] and tables.migrate(spark, str(tmp_path), "quill_versions") == []
    (tmp_path / "002_two.sql").write_text("INSERT INTO quill_migrated VALUES (2)")
    assert tables.status(spark, str(tmp_path), "quill_versions") == [(1, "one", True), (2, "two", False)]
    assert tables.migrate(spark, str(tmp_path), "quill_versions") == [2] and spark.read.table("quill_migrated").count() == 2
    for t in ("quill_migrated", "quill_versions"):
        spark.sql(f"DROP TABLE {t}")


def test_health_models_and_registries(spark):
    assert tables.health(spark)["ok"] and tables.health(None)["ok"] is False
    assert tables.dimension_of("BAAI/bge-base-en-v1.5") == 768 and tables.table_for("BAAI/bge-small-en-v1.5") == "embeddings_384"
    with pytest.raises(KeyError, match="bge-small"):
        tables.dimension_of("x")
    own = registry.Registry("thing", a=int)
    own.add("b", str)
    assert own.get("b") is str
    with pytest.raises(KeyError, match="known are a, b"):
        own.get("c")


def test_counters(spark, tmp_path):
    from tokenizers import Tokenizer
    from tokenizers.models import WordPiece
    from tokenizers.pre_tokenizers import Whitespace

    own = Tokenizer(WordPiece({"[UNK]": 0, "play": 1, "##ing": 2, "a": 3}, unk_token="[UNK]"))
    own.pre_tokenizer = Whitespace()
    own.enable_truncation(2)
    own.save(str(tmp_path / "t.json"))
    counter = VocabularyCounter(str(tmp_path / "t.json"))
    assert counter.counts(["playing a play", "", "zzz"]) == [4, 0, 1] and WhitespaceCounter().counts(["a b", ""]) == [2, 0]
    df = spark.createDataFrame([("playing a",), (None,), ("",)], "t string")
    path = str(tmp_path / "t.json")
    assert [r.n for r in df.select(token_count(F.col("t"), lambda: VocabularyCounter(path)).alias("n")).collect()] == [3, None, 0]


def test_streams_append_each_chunk_once(spark, tmp_path):
    config = RetrievalConfig(chunk_tokens=20)
    schema = "paper_id string, title string, text string"

    def arrive(name, rows):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{name}.json").write_text("\n".join(json.dumps(dict(zip(("paper_id", "title", "text"), r, strict=True))) for r in rows))
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        incremental.ingest_stream(stream, str(tmp_path / "chunks"), str(tmp_path / "check"), config).awaitTermination()
        return spark.read.parquet(str(tmp_path / "chunks"))

    one = ("p1", "T", "First sentence here. Second one.")
    assert arrive("a", [one, ("p2", "T", None)]).count() == 1
    out = arrive("b", [one, ("p3", "T", "Another text. " + "Many more words follow. " * 20)])
    assert out.groupBy("paper_id").count().where("paper_id = 'p1'").first()["count"] == 1 and out.where("paper_id = 'p3'").count() > 3
    assert out.select("chunk_config_sha256").distinct().count() == 1


def test_logged_queries_and_prefixes(spark):
    spark.sql("DROP TABLE IF EXISTS quill_log")
    spark.createDataFrame([], tables.SCHEMAS["query_logs"]).write.mode("overwrite").saveAsTable("quill_log")
    tables.log_query(spark, "quill_log", "why", "{}", [3, 1], '{"a":1}', False)
    row = spark.read.table("quill_log").first()
    assert (row.question, row.retrieved_ids, row.refused, row.cost) == ("why", [3, 1], False, None) and row.created_at
    spark.sql("DROP TABLE quill_log")
    q = spark.createDataFrame([(1, "why")], "query_id long, query string")
    got = embedding.encode_queries(q, lambda: embedding.DigestEncoder(16)).first()
    assert [round(x, 5) for x in got.vec] == [round(x, 5) for x in embedding.DigestEncoder(16).encode_query(embedding.QUERY_PREFIX + "why")]


def test_arrow_scorer(spark):
    calls = []

    def score(queries, passages):
        calls.append(len(queries))
        return [len(p) - len(q) for q, p in zip(queries, passages, strict=True)]

    pairs = spark.createDataFrame([(1, i, "q", "x" * i) for i in range(40)], "query_id long, chunk_id long, query string, content string").coalesce(1)
    got = ranking.arrow_scorer(score)(pairs).orderBy("chunk_id").collect()
    assert [r.rerank_score for r in got] == [float(i - 1) for i in range(40)]


def test_shared_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", [1.0]), (None, None, None)], "i long, s string, v array<double>")
    out = shared.checkpoint(df)
    assert out.dtypes == df.dtypes and sorted(map(str, out.collect())) == sorted(map(str, df.collect()))
    assert shared.checkpoint(df.limit(0)).count() == 0


def test_command_line(spark, tmp_path, capsys):
    for t in tables.SCHEMAS:
        spark.sql(f"DROP TABLE IF EXISTS {t}")
    (tmp_path / "atom.xml").write_bytes(feed(entry("1v1", "Learning rates"), entry("2v1", "Optimisers"), entry("3v1", "Lost")))
    (tmp_path / "pdf").mkdir()
    prose = "Warmup of the learning rate helps training at first. The rate decays afterwards in small steps. " * 12
    (tmp_path / "pdf" / "1v1.pdf").write_text("1 Introduction\n" + prose)
    (tmp_path / "pdf" / "2v1.pdf").write_text("bad")

    def extractor(content):
        if content == b"bad":
            raise ValueError("no pages")
        box = {"page_x0": 0.0, "page_x1": 600.0, "x0": 50.0, "x1": 550.0}
        return [{"page": 1, "block": i, "line": 0, "span": 0, "text": t, "size": 14.0 if i == 0 else 10.0, "font": "Times", "flags": 0, "y0": 30.0 * i, "y1": 30.0 * i + 20, **box} for i, t in enumerate(content.decode().split("\n"))]

    registry.EXTRACTORS.add("lines", extractor)
    assert cli.main(["ingest", str(tmp_path / "atom.xml"), str(tmp_path / "pdf"), "--extractor", "lines"]) == 0
    out = capsys.readouterr().out
    assert "papers_ingested           1" in out and "papers_failed             2" in out and "! 2v1: ValueError: no pages" in out and "! 3v1: no file" in out
    assert cli.main(["ingest", str(tmp_path / "atom.xml"), str(tmp_path / "pdf"), "--extractor", "lines"]) == 0
    assert "papers_skipped_unchanged  1" in capsys.readouterr().out and spark.read.table("papers").count() == 1
    for _ in range(2):
        assert cli.main(["embed"]) == 0
    out = capsys.readouterr().out.split("embed\n")
    assert "written           0" in out[2] and "written           0" not in out[1]
    assert cli.main(["search", "learning rate warmup", "--top-k", "2"]) == 0
    assert "Learning rates — Body p. 1-1 was #1" in capsys.readouterr().out
    assert cli.main(["search", "learning rate warmup", "--compare"]) == 0
    out = capsys.readouterr().out
    assert all(arm in out for arm in ("lexical_only", "dense_only", "rrf ", "rrf_rerank"))
    assert cli.main(["bench-index", str(tmp_path / "index"), "--queries", "2", "--cells", "2", "--rebuild"]) == 0
    assert "index build time" in capsys.readouterr().out
    assert cli.main(["stats"]) == cli.main(["health"]) == cli.main(["manifest", str(tmp_path / "m")]) == 0
    for t in tables.SCHEMAS:
        spark.sql(f"DROP TABLE IF EXISTS {t}")
