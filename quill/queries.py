"""Queries over the driver's tables, one or more for each operator, with DuckDB SQL where it can say the same.

Documents stand in for chunks (chunk_id is doc_id, the paper is the source, the language is
the chunking key), embeddings for their vectors (chunk_id is vec_id), and benchmark items,
with the vector of their own number, for queries.
"""

from __future__ import annotations

import atexit
import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quill.config import WIDEST, RetrievalConfig
from quill.functions import text as T
from quill.functions import vector as V
from quill.operators import cells, chunking, dense, impacts, layout, lexical, positions, ranking, store
from quill.plans import benchmark, ingest
from quill.plans import retrieve as plans
from quill.sources import metadata, shared, tables
from quill.sources.vector_cache import VectorCache
from quill.stemsql import stems

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _chunks(spark, sf_dir):
    d = _read(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("paper_id"), F.col("doc_id").alias("ordinal"), F.when(F.col("n_chars") > 150, "Body").otherwise("Short").alias("section_path"),
        F.col("text").alias("content"), F.col("text").alias("embed_input"), T.count_words(F.col("text")).alias("token_count"), F.lit(1).alias("page_start"), (F.floor(F.col("n_chars") / 3000) + 1).cast("int").alias("page_end"),
        F.col("lang").alias("chunk_config_sha256"), F.sha2("text", 256).alias("content_sha256"), F.sha2("text", 256).alias("embed_input_sha256"),
    )


def _vectors(spark, sf_dir):
    e = _read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"), F.lit("m").alias("model"), F.col("label").cast("string").alias("chunk_config_sha256"))


def _questions(spark, sf_dir):
    b, e = _read(spark, sf_dir, "benchmark"), _read(spark, sf_dir, "embeddings")
    return b.join(e, b["item_id"] == e["vec_id"]).select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.col("embedding").alias("vec"))


def _lines(spark, sf_dir):
    """Documents' lines as spans: a short line is set larger."""
    d = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), F.posexplode(F.split("text", "\n")).alias("seq", "text"))
    order = Window.partitionBy("paper_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(order), F.lit(0))
    return d.select(
        "paper_id", F.col("seq").cast("long").alias("seq"), "text", (F.floor(F.col("seq") / 20) + 1).cast("int").alias("page"), F.when(F.length("text") < 60, 12.0).otherwise(10.0).alias("font_size"),
        F.lit(False).alias("bold"), F.col("seq").alias("block"), F.lit(0).alias("line"), start.alias("char_start"), (start + F.length("text")).alias("char_end"),
    )


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_WORDS_RE = r"'[\p{L}\p{N}]+'"


def _lex(text: str) -> str:
    """Words without stop words, not stemmed yet."""
    return f"list_filter(regexp_extract_all(lower({text}), {_WORDS_RE}), lambda w: w NOT IN ({_STOP}))"


_CHUNKS = r"""chunks AS (SELECT doc_id AS chunk_id, source AS paper_id, doc_id AS ordinal, CASE WHEN n_chars > 150 THEN 'Body' ELSE 'Short' END AS section_path, text AS content,
    len(regexp_extract_all(text, '\S+'))::BIGINT AS token_count, 1 AS page_start, (1 + n_chars // 3000)::INT AS page_end, lang AS chunk_config_sha256, sha256(text) AS embed_input_sha256 FROM documents)"""
_QUESTIONS = "questions AS (SELECT item_id AS query_id, text AS query, embedding AS vec FROM benchmark JOIN embeddings ON item_id = vec_id)"
_VECTORS = "vectors AS (SELECT vec_id AS chunk_id, embedding AS vec, label::VARCHAR AS chunk_config_sha256 FROM embeddings)"
_WORDS = f"dw AS (SELECT doc_id AS chunk_id, lang, unnest({_lex('text')}) AS word FROM documents), qw AS (SELECT DISTINCT query_id, unnest({_lex('query')}) AS word FROM questions), vocabulary AS (SELECT word FROM dw UNION SELECT word FROM qw), {stems('vocabulary')}"
_MATCHES = f"""{_WORDS}, dl AS (SELECT chunk_id, lexeme FROM dw JOIN stems USING (word)), ql AS (SELECT DISTINCT query_id, lexeme FROM qw JOIN stems USING (word)),
    matches AS (SELECT query_id, chunk_id, count(*) AS n FROM ql JOIN dl USING (lexeme) GROUP BY ALL)"""


def _lexical(k: int, name: str = "lexical") -> str:
    return f"{name} AS (SELECT query_id, chunk_id, round(n / (n + 10.0::DOUBLE), 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, chunk_id) AS rank FROM matches) WHERE rank <= {k})"


def _dense(k: int, name: str = "dense", where: str = "true") -> str:
    return f"""{name} AS (SELECT query_id, chunk_id, round(cosine, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, {lexical.TIE}) DESC, chunk_id) AS rank FROM (
        SELECT query_id, chunk_id, list_cosine_similarity(q.vec::DOUBLE[], v.vec::DOUBLE[]) AS cosine FROM questions q, vectors v WHERE {where})) WHERE rank <= {k})"""


_FUSED = f"""arms AS (SELECT query_id, chunk_id, rank FROM dense UNION ALL SELECT query_id, chunk_id, rank FROM lexical),
    fused AS (SELECT query_id, chunk_id, round(total, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(total, {lexical.TIE}) DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS total FROM arms GROUP BY ALL))"""
_STRIPPED = r"regexp_replace({}, '^[.,?]+|[.,?]+$', '', 'g')"
_TERMS = rf"list_transform(regexp_extract_all(lower({{}}), '\S+'), lambda w: {_STRIPPED.format('w')})"


def _reranked(source: str = "fused", top_n: int = 50, k: int = 5) -> str:
    return rf"""pairs AS (SELECT f.query_id, f.chunk_id, f.score, f.rank AS fused_rank, len(list_filter({_TERMS.format("d.text")}, lambda w: list_contains(t.terms, w)))::DOUBLE AS rerank_score
        FROM {source} f JOIN documents d ON d.doc_id = f.chunk_id JOIN (SELECT query_id, list_distinct({_TERMS.format("query")}) AS terms FROM questions) t ON t.query_id = f.query_id WHERE f.rank <= {top_n}),
    reranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, chunk_id) AS rank FROM pairs) WHERE rank <= {k})"""


_ALL = f"WITH {_QUESTIONS}, {_VECTORS}, {_MATCHES}, {_lexical(50)}, {_dense(50)}, {_FUSED}"


# Retrieval


@query(f"{_ALL}, {_reranked()} SELECT query_id, chunk_id, score, fused_rank, rerank_score, rank, CASE WHEN max(rerank_score) OVER (PARTITION BY query_id) < 0 THEN 'below_score_floor' END AS reason FROM reranked")
def hybrid_retrieve(spark, sf_dir):
    return plans.retrieve(_questions(spark, sf_dir), _chunks(spark, sf_dir), _vectors(spark, sf_dir), index=_index(spark, sf_dir))


@query(f"{_ALL}, {_reranked()} SELECT query_id, chunk_id, score, fused_rank, rerank_score, rank, CASE WHEN max(rerank_score) OVER (PARTITION BY query_id) < 0 THEN 'below_score_floor' END AS reason FROM reranked")
def hybrid_retrieve_stored(spark, sf_dir):
    """From both stored indexes, all cells read."""
    index, config = _cells(spark, sf_dir), RetrievalConfig(hnsw_ef_search=WIDEST)
    return plans.retrieve(_questions(spark, sf_dir), _chunks(spark, sf_dir), config=config, index=_blocks(spark, sf_dir), cells=index)


@query(f"WITH {_QUESTIONS}, {_VECTORS}, {_dense(50)} SELECT * FROM dense")
def dense_topk(spark, sf_dir):
    return dense.search(_questions(spark, sf_dir), _vectors(spark, sf_dir), 50)


@query(f"WITH {_QUESTIONS}, {_VECTORS}, {_CHUNKS}, {_dense(50)} SELECT query_id, dense.chunk_id, score, rank, paper_id, section_path FROM dense JOIN chunks USING (chunk_id)")
def dense_topk_join(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    papers = chunks.select("paper_id").distinct()
    hits = dense.search(_questions(spark, sf_dir), _vectors(spark, sf_dir), 50)
    return dense.with_metadata(hits, chunks.select("chunk_id", "paper_id", "section_path"), papers)


@query(f"WITH {_QUESTIONS}, {_VECTORS}, {_dense(50, where='chunk_config_sha256 = ' + chr(39) + '1' + chr(39))} SELECT * FROM dense")
def filter_chunking(spark, sf_dir):
    return dense.search(_questions(spark, sf_dir), plans.one_chunking(_vectors(spark, sf_dir), "1"), 50)


@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_similarity(spark, sf_dir):
    e = _read(spark, sf_dir, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(b, "vec_id").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("next")), 6).alias("similarity"))


@query(f"WITH {_QUESTIONS}, {_MATCHES}, {_lexical(50)} SELECT * FROM lexical")
def lexical_topk(spark, sf_dir):
    return lexical.search(_questions(spark, sf_dir), _chunks(spark, sf_dir), 50)


def _stored(spark, sf_dir, name, write) -> str:
    """The path of an index, built at most once a session in the shared folder."""
    path = f"{shared.shared_folder(spark)}/index-{name}-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}-{spark.sparkContext.applicationId}"
    if not tables.exists(spark, f"{path}/_SUCCESS") and not tables.exists(spark, f"{path}/_log"):
        write(path)
        atexit.register(shared.remove_folder, spark, path)
    return path


def _index(spark, sf_dir):
    return spark.read.parquet(_stored(spark, sf_dir, "postings", lambda path: lexical.write_index(_chunks(spark, sf_dir), path)))


def _cells(spark, sf_dir):
    return dense.read_index(spark, _stored(spark, sf_dir, "cells", lambda path: dense.write_index(_vectors(spark, sf_dir), path)))


@query(f"WITH {_QUESTIONS}, {_WORDS} SELECT lang AS chunk_config_sha256, count(DISTINCT lexeme) AS lexemes, count(*) AS occurrences FROM dw JOIN stems USING (word) GROUP BY 1")
def stored_postings(spark, sf_dir):
    """Builds the stored index, and counts what it holds."""
    return _index(spark, sf_dir).groupBy("chunk_config_sha256").agg(F.countDistinct("lexeme").alias("lexemes"), F.sum("tf").alias("occurrences"))


def _blocks(spark, sf_dir):
    return impacts.read_index(spark, _stored(spark, sf_dir, "blocks", lambda path: impacts.write_index(_chunks(spark, sf_dir), path)))


@query(f"WITH {_QUESTIONS}, {_MATCHES}, {_lexical(10)} SELECT * FROM lexical")
def lexical_topk_blocks(spark, sf_dir):
    """From stored blocks with bounds: most postings are not opened."""
    return _blocks(spark, sf_dir).search(_questions(spark, sf_dir), 10)


@query(f"WITH {_QUESTIONS}, {_MATCHES} SELECT count(DISTINCT query_id) AS queries, count(*) > 0 AS fewer_read FROM matches")
def lexical_blocks_read(spark, sf_dir):
    """Of how many queries the blocks' bounds were read, and whether that left postings unopened."""
    work = _blocks(spark, sf_dir).searched(_questions(spark, sf_dir), 10)[1]
    return work.agg(F.count(F.lit(1)).alias("queries"), (F.sum("postings_read") < F.sum("postings")).alias("fewer_read"))


@query(f"WITH {_QUESTIONS}, {_MATCHES}, {_lexical(10)} SELECT * FROM lexical")
def lexical_topk_segments(spark, sf_dir):
    """The same from an index that grew by batches, from which chunks were taken and put back."""

    def write(path):
        c = _chunks(spark, sf_dir)
        part = F.pmod(F.xxhash64("chunk_id"), F.lit(3))
        impacts.write_index(c.where(part == 0), path)
        index = impacts.read_index(spark, path).append(c.where(part == 1)).append(c.where(part == 2))
        again = c.where(F.col("chunk_id") % 5 == 0)
        index.delete(again).append(again).append(c.where(F.col("chunk_id") % 7 == 0), replace=True)

    return impacts.read_index(spark, _stored(spark, sf_dir, "segments", write)).search(_questions(spark, sf_dir), 10)


@query(f"WITH {_QUESTIONS}, {_MATCHES}, {_lexical(50)} SELECT * FROM lexical")
def lexical_topk_postings(spark, sf_dir):
    """From the stored index."""
    return lexical.search(_questions(spark, sf_dir), None, 50, index=_index(spark, sf_dir))


@query(f"WITH {_QUESTIONS}, {_MATCHES.replace('FROM dw JOIN stems USING (word)), ql', chr(70) + 'ROM dw JOIN stems USING (word) WHERE lang = ' + chr(39) + 'en' + chr(39) + '), ql')}, {_lexical(50)} SELECT * FROM lexical")
def lexical_topk_chunking(spark, sf_dir):
    """One chunking of the stored index: its partitions alone are read."""
    return lexical.search(_questions(spark, sf_dir), None, 50, index=plans.one_chunking(_index(spark, sf_dir), "en"))


@query(f"WITH {_QUESTIONS}, {_MATCHES} SELECT query_id, count(*) AS n_chunks FROM matches GROUP BY query_id")
def lexical_match(spark, sf_dir):
    return lexical.matches(_questions(spark, sf_dir), _chunks(spark, sf_dir)).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_chunks"))


@query(f"WITH {_QUESTIONS}, {_MATCHES} SELECT query_id, chunk_id, round(n / (n + 10.0::DOUBLE), 6) AS score FROM matches")
def lexical_score(spark, sf_dir):
    return lexical.matches(_questions(spark, sf_dir), _chunks(spark, sf_dir)).select("query_id", "chunk_id", F.round(lexical.score(F.col("n")), 6).alias("score"))


@query(f"""WITH w AS (SELECT item_id, unnest({_lex('text')}) AS word FROM benchmark), vocabulary AS (SELECT DISTINCT word FROM w), {stems('vocabulary')}, l AS (SELECT item_id, string_agg(DISTINCT lexeme, ' ' ORDER BY lexeme) AS lexemes FROM w JOIN stems USING (word) GROUP BY 1)
    SELECT b.item_id, coalesce(lexemes, '') AS lexemes FROM benchmark b LEFT JOIN l ON b.item_id = l.item_id""")
def lexemes(spark, sf_dir):
    return _read(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.lexeme_set(F.col("text")), " ").alias("lexemes"))


@query(f"WITH {_QUESTIONS}, {_WORDS} SELECT lang AS chunk_config_sha256, lexeme, chunk_id, count(*) AS tf FROM dw JOIN stems USING (word) GROUP BY ALL")
def postings(spark, sf_dir):
    return lexical.postings(_chunks(spark, sf_dir), keep=("chunk_config_sha256",))


_TOKENS = r"""t AS (SELECT doc_id AS chunk_id, unnest(ts) AS token, unnest(range(len(ts))) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*') AS ts FROM documents)),
    w AS (SELECT *, 1 + coalesce(sum(CASE WHEN contains(token, '-') THEN 2 + length(token) - length(replace(token, '-', '')) ELSE 1 END) OVER (PARTITION BY chunk_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM t),
    p AS (SELECT chunk_id, token AS word, pos FROM w UNION ALL SELECT chunk_id, unnest(parts), pos + unnest(range(1, len(parts) + 1)) FROM (SELECT chunk_id, pos, string_split(token, '-') AS parts FROM w WHERE contains(token, '-')))"""


@query(
    f"""WITH {_TOKENS}, kept AS (SELECT chunk_id, word, least(pos, 16383) AS pos FROM p WHERE word NOT IN ({_STOP})), vocabulary AS (SELECT DISTINCT word FROM kept), {stems('vocabulary')},
    n AS (SELECT chunk_id, lexeme, pos, row_number() OVER (PARTITION BY chunk_id, lexeme ORDER BY pos) AS nth FROM (SELECT DISTINCT chunk_id, lexeme, pos FROM kept JOIN stems USING (word)))
    SELECT lexeme, chunk_id, count(*) AS n, min(pos)::INT AS first, max(pos)::INT AS last, sum(pos)::BIGINT AS total FROM n WHERE nth <= 256 GROUP BY ALL"""
)
def positional_postings(spark, sf_dir):
    p = F.col("positions")
    found = positions.positional_postings(_chunks(spark, sf_dir))
    total = F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("lexeme", "chunk_id", F.size(p).cast("long").alias("n"), F.array_min(p).alias("first"), F.array_max(p).alias("last"), total.alias("total"))


@query(
    f"""WITH {_QUESTIONS}, dw AS (SELECT 0 AS chunk_id, '' AS word WHERE false), qw AS (SELECT DISTINCT query_id, unnest({_lex('query')}) AS word FROM questions), {_TOKENS},
    kept AS (SELECT chunk_id, word, least(pos, 16383) AS pos FROM p WHERE word NOT IN ({_STOP})), vocabulary AS (SELECT word FROM kept UNION SELECT word FROM qw), {stems('vocabulary')},
    n AS (SELECT chunk_id, lexeme, pos, row_number() OVER (PARTITION BY chunk_id, lexeme ORDER BY pos) AS nth FROM (SELECT DISTINCT chunk_id, lexeme, pos FROM kept JOIN stems USING (word))),
    ql AS (SELECT DISTINCT query_id, lexeme FROM qw JOIN stems USING (word)), matches AS (SELECT query_id, chunk_id, count(*) AS n FROM ql JOIN n USING (lexeme) WHERE nth <= 256 GROUP BY ALL), {_lexical(20)}
    SELECT * FROM lexical"""
)
def lexical_topk_bounded(spark, sf_dir):
    """Under the bounds of stored positions."""
    return positions.search(_questions(spark, sf_dir), positions.positional_postings(_chunks(spark, sf_dir)), 20)


@query(
    f"WITH questions AS (SELECT * FROM (VALUES (1, ''), (2, 'the of and'), (3, '???'), (4, 'en that')) t(query_id, query)), {_MATCHES} SELECT query_id::BIGINT AS query_id, count(*) AS n_chunks FROM matches GROUP BY query_id"
)
def degenerate_query(spark, sf_dir):
    q = spark.createDataFrame([(1, ""), (2, "the of and"), (3, "???"), (4, "en that")], "query_id long, query string")
    return lexical.matches(q, _chunks(spark, sf_dir)).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_chunks"))


@query("SELECT item_id, round(CASE WHEN item_id % 5 = 0 THEN 0 ELSE 1.0::DOUBLE / (60 + 1 + item_id % 7) + 1.0::DOUBLE / (60 + 3) END, 9) AS score FROM benchmark")
def rrf_score(spark, sf_dir):
    ranks = F.when(F.col("item_id") % 5 == 0, F.array().cast("array<long>")).otherwise(F.array(F.col("item_id") % 7 + 1, F.lit(3).cast("long")))
    return _read(spark, sf_dir, "benchmark").select("item_id", F.round(V.rrf_score(ranks, 60), 9).alias("score"))


@query(f"{_ALL} SELECT query_id, chunk_id, score, rank FROM fused")
def rrf_fusion(spark, sf_dir):
    return plans.fused(_questions(spark, sf_dir), _chunks(spark, sf_dir), _vectors(spark, sf_dir), RetrievalConfig(), index=_index(spark, sf_dir))


@query(f"WITH {_QUESTIONS}, {_MATCHES}, {_lexical(50)}, {_reranked('lexical', 20, 10)} SELECT query_id, chunk_id, score, fused_rank, rerank_score, rank FROM reranked")
def rerank(spark, sf_dir):
    q, c = _questions(spark, sf_dir), _chunks(spark, sf_dir)
    return ranking.rerank(lexical.search(q, c, 50, index=_index(spark, sf_dir)), q, c, ranking.word_overlap_scorer(), 20, 10)


@query(f"WITH {_QUESTIONS}, {_MATCHES}, {_lexical(50)}, {_reranked('lexical', 20, 10)} SELECT query_id, count(*) AS survivors, avg(abs(fused_rank - rank)) AS mean_movement, max(abs(fused_rank - rank)) AS max_movement FROM reranked GROUP BY query_id")
def rank_movement(spark, sf_dir):
    return ranking.rank_movement(rerank(spark, sf_dir))


@query(
    f"WITH {_QUESTIONS}, {_MATCHES}, {_lexical(50)}, {_reranked('lexical', 20, 10)} SELECT query_id, chunk_id, rank, CASE WHEN max(rerank_score) OVER (PARTITION BY query_id) < 60 THEN 'below_score_floor' END AS reason FROM reranked"
)
def score_floor(spark, sf_dir):
    return ranking.apply_floor(rerank(spark, sf_dir), 60.0).select("query_id", "chunk_id", "rank", "reason")


@query(
    rf"""WITH {_QUESTIONS}, {_MATCHES}, {_lexical(50)}, p AS (SELECT query_id, len(regexp_extract_all(query, '\S+')) + len(regexp_extract_all(text, '\S+')) AS n FROM lexical JOIN questions USING (query_id) JOIN documents ON doc_id = chunk_id)
    SELECT query_id, count(*) AS scored, count(*) FILTER (WHERE n > 512) AS truncated_pairs, (count(*) FILTER (WHERE n > 512) / count(*))::DOUBLE AS truncation_rate FROM p GROUP BY query_id"""
)
def truncation_rate(spark, sf_dir):
    q, c = _questions(spark, sf_dir), _chunks(spark, sf_dir)
    pairs = lexical.search(q, c, 50, index=_index(spark, sf_dir)).join(lexical.broadcast_if_small(q.select("query_id", "query")), "query_id").join(c.select("chunk_id", "token_count"), "chunk_id")
    return ranking.truncation_rate(pairs, T.count_words(F.col("query")) + F.col("token_count"))


@query(
    f"""{_ALL}, {_reranked()}, r AS (SELECT query_id, max(rerank_score) < 60 AS refused, string_agg(chunk_id::VARCHAR, ',' ORDER BY rank) AS ids, count(*) AS k FROM reranked GROUP BY query_id),
    dc AS (SELECT query_id, count(*) AS dense_count FROM dense GROUP BY 1), lc AS (SELECT query_id, count(*) AS lexical_count FROM lexical GROUP BY 1)
    SELECT q.query_id, coalesce(refused, false) AS refused, CASE WHEN refused THEN 'below_score_floor' END AS reason, CASE WHEN coalesce(refused, true) THEN '' ELSE ids END AS chunk_ids, CASE WHEN coalesce(refused, true) THEN 0 ELSE k END AS n,
    coalesce(dense_count, 0) AS dense_count, coalesce(lexical_count, 0) AS lexical_count
    FROM questions q LEFT JOIN r USING (query_id) LEFT JOIN dc USING (query_id) LEFT JOIN lc USING (query_id)"""
)
def retrieval_summary(spark, sf_dir):
    q, c, v = _questions(spark, sf_dir), _chunks(spark, sf_dir), _vectors(spark, sf_dir)
    config = RetrievalConfig(score_floor=60.0)
    out = plans.run(q, c, v, None, config, index=_index(spark, sf_dir)).summary
    return out.select("query_id", "refused", "reason", F.array_join("chunk_ids", ",").alias("chunk_ids"), F.col("n").cast("long").alias("n"), "dense_count", "lexical_count")


@query(
    f"""{_ALL}, {_reranked()} SELECT 'lexical_only' AS arm, query_id, chunk_id, rank, rank AS was FROM lexical WHERE rank <= 5 UNION ALL SELECT 'dense_only', query_id, chunk_id, rank, rank FROM dense WHERE rank <= 5
    UNION ALL SELECT 'rrf', query_id, chunk_id, rank, rank FROM fused WHERE rank <= 5 UNION ALL SELECT 'rrf_rerank', query_id, chunk_id, rank, fused_rank FROM reranked"""
)
def compare_modes(spark, sf_dir):
    return plans.compare_modes(_questions(spark, sf_dir), _chunks(spark, sf_dir), _vectors(spark, sf_dir), index=_index(spark, sf_dir))


@query(
    f"""WITH {_QUESTIONS}, {_VECTORS}, {_dense(10)}, {_dense(10, "near", "chunk_config_sha256 <> '0'")},
    t AS (SELECT query_id, count(*) AS n FROM dense GROUP BY 1), h AS (SELECT query_id, count(*) AS hit FROM dense JOIN near USING (query_id, chunk_id) GROUP BY 1)
    SELECT round(coalesce(avg(coalesce(hit, 0) / n), 0), 9) AS recall FROM t LEFT JOIN h USING (query_id)"""
)
def recall_at_k(spark, sf_dir):
    q, v = _questions(spark, sf_dir), _vectors(spark, sf_dir)
    found = ranking.recall_at_k(dense.search(q, v, 10), dense.search(q, v.where("chunk_config_sha256 <> '0'"), 10), 10)
    return found.select(F.round("recall", 9).alias("recall"))


@query(
    f"""WITH {_QUESTIONS}, {_VECTORS}, {_dense(10)}, counted AS (SELECT q.query_id, count(d.chunk_id) AS wanted FROM questions q LEFT JOIN dense d ON d.query_id = q.query_id GROUP BY 1)
    SELECT count(*) AS queries, sum(wanted)::BIGINT AS wanted, sum(wanted) > 0 AS enough, count(*) > 0 AS a_quarter_at_most FROM counted"""
)
def ann_recall(spark, sf_dir):
    """How many of the exact search's hits there are, whether the stored index at its usual breadth finds nine tenths of them, and whether it reads a quarter of the codes at most for it."""
    q, index = _questions(spark, sf_dir), _cells(spark, sf_dir)
    breadth = RetrievalConfig().n_probe(len(index.centres))
    truth, found = dense.search(q, _vectors(spark, sf_dir), 10), index.probed(q, 10, breadth)
    both = truth.select("query_id", "chunk_id", F.lit(1).alias("t")).join(found.select("query_id", "chunk_id", F.lit(1).alias("f")), ["query_id", "chunk_id"], "left")
    share = cells.read_share(index, q, breadth)
    return both.agg(F.countDistinct("query_id").alias("queries"), F.sum("t").alias("wanted"), (F.sum("f") >= 0.9 * F.sum("t")).alias("enough"), F.lit(share <= 0.25).alias("a_quarter_at_most"))


@query(f"WITH {_QUESTIONS}, {_VECTORS}, {_dense(10)} SELECT query_id, chunk_id, score, rank FROM dense")
def ann_exact(spark, sf_dir):
    """The stored index with all cells read is the exact search."""
    index = _cells(spark, sf_dir)
    return index.widened(_questions(spark, sf_dir), 10, len(index.centres))


@query(f"WITH {_QUESTIONS}, {_VECTORS}, {_dense(400)} SELECT query_id, count(*) AS n, max(rank) AS last FROM dense GROUP BY 1")
def ann_widened(spark, sf_dir):
    """Searches that find fewer than k in their cells read more until they have them."""
    found = _cells(spark, sf_dir).widened(_questions(spark, sf_dir), 400, 1)
    return found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("last"))


@query(
    f"""WITH {_QUESTIONS}, {_VECTORS}, {_dense(10)}, t AS (SELECT a.query_id, count(b.chunk_id) / count(*) AS found FROM dense a LEFT JOIN dense b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id GROUP BY 1)
    SELECT (SELECT count(*) FROM vectors) AS rows, (SELECT count(*) FROM (VALUES (0.0625), (0.25), (1.0)) b(share)) AS breadths, (SELECT round(avg(found), 6) FROM t) AS widest_recall, true AS grows, (SELECT count(*) > 0 FROM vectors) AS has_bytes"""
)
def index_benchmark(spark, sf_dir):
    """Recall over a sweep of breadths, sizes and build time, without latencies."""
    b = benchmark.benchmark_index(spark, _questions(spark, sf_dir), _vectors(spark, sf_dir), _stored(spark, sf_dir, "cells", lambda path: dense.write_index(_vectors(spark, sf_dir), path)), sweep=(0.0625, 0.25, 1.0), latencies=False)
    rows = b.where("n_probe is not null")
    order = F.transform(F.array_sort(F.collect_list(F.struct("n_probe", "recall_at_10"))), lambda x: x["recall_at_10"])  # a row a breadth
    return rows.agg(F.max("rows").alias("rows"), F.count(F.lit(1)).alias("breadths"), F.round(F.max_by("recall_at_10", "n_probe"), 6).alias("widest_recall"), (order == F.array_sort(order)).alias("grows"), (F.min("index_bytes") > 0).alias("has_bytes"))


@query(f"""{_ALL}, {_reranked()}, t AS (SELECT query_id, chunk_id, rank FROM (SELECT *, max(rerank_score) OVER (PARTITION BY query_id) AS best FROM reranked) WHERE best >= 0)
    SELECT query_id, chunk_id, rank, source AS paper_id, CASE WHEN n_chars > 150 THEN 'Body' ELSE 'Short' END AS section_path, sha256(text) AS digest, 1 AS page_start, (1 + n_chars // 3000)::INT AS page_end, upper(source) AS paper_title FROM t JOIN documents ON doc_id = chunk_id""")
def candidates(spark, sf_dir):
    """run(): what was found, with what chunks and papers show."""
    c = _chunks(spark, sf_dir)
    papers = c.select(F.col("paper_id").alias("id"), F.upper("paper_id").alias("title")).distinct()
    found = plans.run(_questions(spark, sf_dir), c, _vectors(spark, sf_dir), papers, index=_index(spark, sf_dir)).candidates
    return found.select("query_id", "chunk_id", "rank", "paper_id", "section_path", F.sha2("content", 256).alias("digest"), "page_start", "page_end", "paper_title")


@query(
    """SELECT user_id, list_sort(list(value))[least(greatest(round_even((0.95::DOUBLE * (count(*) - 1))::DOUBLE, 0)::INT, 0), count(*) - 1) + 1] AS p95 FROM events WHERE value IS NOT NULL GROUP BY user_id"""
)
def nearest_rank_percentile(spark, sf_dir):
    return store.nearest_rank_by(_read(spark, sf_dir, "events"), "user_id", "value", 0.95, "p95")


# Text and chunks


@query(r"SELECT doc_id, regexp_replace(replace(text, 'e', chr(7) || 'e' || chr(9)), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g') AS text FROM documents")
def strip_controls(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", T.strip_controls(F.replace("text", F.lit("e"), F.lit("\x07e\t"))).alias("text"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '\S+'))::BIGINT AS tokens FROM documents")
def token_counts(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", T.count_words(F.col("text")).alias("tokens"))


@query("SELECT doc_id, greatest(1, least(300, 510) - n_chars % 400)::BIGINT AS budget FROM documents")
def content_budget(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", T.content_budget("BAAI/bge-small-en-v1.5", 300, F.col("n_chars") % 400).alias("budget"))


@query("SELECT doc_id, source || ' — ' || lang || chr(10) || chr(10) || text AS embed_input FROM documents")
def embed_input(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.concat(T.header(F.col("source"), F.col("lang")), "text").alias("embed_input"))


@query("SELECT doc_id, sha256(text) AS content_sha256, sha256(source || ' — ' || lang || chr(10) || chr(10) || text) AS embed_input_sha256 FROM documents")
def chunk_digests(spark, sf_dir):
    d = embed_input(spark, sf_dir).join(_read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return d.select("doc_id", F.sha2("text", 256).alias("content_sha256"), F.sha2("embed_input", 256).alias("embed_input_sha256"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def content_digest(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


_ABBR = "|".join(a.replace(".", r"\.") for a in T.ABBREVIATIONS)
# The last full stop of an abbreviation is hidden, boundaries are marked, then the text is cut.
_SENTENCES = rf"""list_filter(list_transform(string_split(regexp_replace(regexp_replace({{}}, '(^|\s)((?i:{_ABBR}))\.', '\1\2' || chr(2), 'g'), '([.!?])[ \t\n]+([A-Z(\["''])', '\1' || chr(1) || '\2', 'g'), chr(1)),
    lambda s: regexp_replace(replace(s, chr(2), '.'), '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g')), lambda s: s <> '')"""


@query(f"SELECT doc_id, unnest(ss) AS sentence, (generate_subscripts(ss, 1) - 1)::INTEGER AS n FROM (SELECT doc_id, {_SENTENCES.format('text')} AS ss FROM documents)")
def split_sentences(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("n", "s"))
    return d.select("doc_id", F.col("s.text").alias("sentence"), "n")


@query(f"SELECT doc_id, count(*) AS sentences, sum(length(s))::BIGINT AS chars FROM (SELECT doc_id, unnest({_SENTENCES.format('text')}) AS s FROM documents) GROUP BY 1")
def sentence_offsets(spark, sf_dir):
    """What stands between the offsets of sentences: those that are the sentence itself, and their characters."""
    d = _read(spark, sf_dir, "documents").select("doc_id", "text", F.explode(T.sentences(F.col("text"))).alias("s"))
    own = F.substring(F.col("text"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    return d.where(own == F.col("s.text")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), F.sum(F.length(own)).alias("chars"))


_PIECES = r"""s AS (SELECT doc_id, si, list_filter(regexp_extract_all(sentence, '\S+'), lambda w: true) AS w, sentence FROM (SELECT doc_id, unnest(ss) AS sentence, generate_subscripts(ss, 1) AS si FROM (SELECT doc_id, {S} AS ss FROM documents))),
    p AS (SELECT doc_id, si, 0 AS pi, sentence AS piece, len(w) AS tok FROM s WHERE len(w) <= {B} UNION ALL
          SELECT doc_id, si, k AS pi, array_to_string(list_slice(w, k * {B} + 1, k * {B} + {B}), ' ') AS piece, len(list_slice(w, k * {B} + 1, k * {B} + {B})) AS tok FROM (SELECT *, unnest(range(0, (len(w) + {B} - 1) // {B})) AS k FROM s WHERE len(w) > {B}))"""


def _pieces_sql(budget: int) -> str:
    return _PIECES.replace("{S}", _SENTENCES.format("text")).replace("{B}", str(budget))


@query(rf"WITH {_pieces_sql(12)} SELECT doc_id, regexp_replace(piece, '\s+', ' ', 'g') AS piece, row_number() OVER (PARTITION BY doc_id ORDER BY si, pi) - 1 AS n FROM p")
def hard_split(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.pieces(F.col("text"), 12)).alias("n", "s"))
    return d.select("doc_id", F.regexp_replace("s.text", r"\s+", " ").alias("piece"), F.col("n").cast("long").alias("n"))


_BUDGET, _OVERLAP = 64, 9
# A chunk's end e and the next one's start nx depend on its first piece alone; the chain from 1 is followed.
_CHUNKED = rf"""WITH RECURSIVE {_pieces_sql(_BUDGET)},
    q AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY si, pi) AS i, piece, tok, sum(tok) OVER (PARTITION BY doc_id ORDER BY si, pi ROWS UNBOUNDED PRECEDING) AS c FROM p),
    ends AS (SELECT a.doc_id, a.i AS st, max(b.i) AS e, max(b.c) AS ce FROM q a JOIN q b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + {_BUDGET} AND b.c - a.c + a.tok <= {_BUDGET} GROUP BY ALL),
    cand AS (SELECT x.doc_id, x.st, x.e, x.ce, min(j.i) AS cd, arg_min(j.c - j.tok, j.i) AS before FROM ends x LEFT JOIN q j ON j.doc_id = x.doc_id AND j.i > x.st AND j.i <= x.e AND x.ce - j.c + j.tok <= {_OVERLAP} GROUP BY ALL),
    nx AS (SELECT k.doc_id, k.st, k.e, CASE WHEN n.i IS NULL THEN NULL WHEN k.cd IS NULL OR k.ce - k.before + n.tok > {_BUDGET} THEN k.e + 1 ELSE k.cd END AS nxt FROM cand k LEFT JOIN q n ON n.doc_id = k.doc_id AND n.i = k.e + 1),
    chain(doc_id, ordinal, st, e, nxt) AS (SELECT doc_id, 0::BIGINT, st, e, nxt FROM nx WHERE st = 1 UNION ALL SELECT n.doc_id, h.ordinal + 1, n.st, n.e, n.nxt FROM chain h JOIN nx n ON n.doc_id = h.doc_id AND n.st = h.nxt)
    SELECT h.doc_id, ordinal, sum(tok)::BIGINT AS token_count, sha256(regexp_replace(string_agg(piece, ' ' ORDER BY i), '\s+', ' ', 'g')) AS digest FROM chain h JOIN q ON q.doc_id = h.doc_id AND q.i BETWEEN h.st AND h.e GROUP BY ALL"""


@query(_CHUNKED)
def chunk_documents(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), F.lit("").alias("title"), "text")
    chunks = chunking.chunk_papers(chunking.one_section(d), _BUDGET, 0.15, headers=False)
    return chunks.select(F.col("paper_id").alias("doc_id"), "ordinal", "token_count", F.sha2(F.regexp_replace("content", r"\s+", " "), 256).alias("digest"))


@query("SELECT doc_id, CASE WHEN f = '' THEN substr(text, 1, 300) ELSE f END AS query FROM (SELECT doc_id, text, substr(regexp_replace(split_part(text, '. ', 1), '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g'), 1, 300) AS f FROM documents)")
def pseudo_queries(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", T.pseudo_query(F.col("text")).alias("query"))


# Layout

_LINES = """lines AS (SELECT paper_id, seq, text, (seq // 20 + 1)::INT AS page, CASE WHEN length(text) < 60 THEN 12.0::DOUBLE ELSE 10.0 END AS font_size,
    coalesce(sum(length(text) + 1) OVER (PARTITION BY paper_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start
    FROM (SELECT doc_id AS paper_id, unnest(ls) AS text, generate_subscripts(ls, 1) - 1 AS seq FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))"""
_NAMES = ", ".join(f"'{h}'" for h in T.HEADINGS)
_STRIP = r"regexp_replace(text, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g')"
_NUMBER = rf"nullif(regexp_extract(text, '{T.NUMBERED}', 1), '')"
_IS_HEADING = rf"({_NUMBER} IS NOT NULL OR regexp_replace(lower({_STRIP}), '[.:]+$', '') IN ({_NAMES}))"


@query(f"WITH {_LINES} SELECT paper_id, seq, {_NUMBER} AS number FROM lines WHERE {_IS_HEADING}")
def heading_parse(spark, sf_dir):
    return _lines(spark, sf_dir).where(T.is_heading(F.col("text"))).select("paper_id", "seq", T.heading_number(F.col("text")).alias("number"))


@query(
    rf"""WITH {_LINES} SELECT paper_id, seq FROM lines WHERE length(text) BETWEEN 3 AND 100 AND len(regexp_extract_all(text, '\S+')) <= 12 AND font_size >= 10.5
    AND length(regexp_replace(text, '[^\p{{L}}\s]', '', 'g')) / length(text) >= 0.7 AND NOT (rtrim(text) LIKE '%.' AND regexp_matches(text, '(^|\s)\p{{Ll}}\S*\s*$'))"""
)
def heading_filter(spark, sf_dir):
    t = F.col("text")
    looks = F.length(t).between(3, layout.HEADING_CHARS) & (T.count_words(t) <= layout.HEADING_WORDS) & (F.col("font_size") >= 10.0 * layout.HEADING_RATIO) & T.reads_like_title(t)
    return _lines(spark, sf_dir).where(looks).select("paper_id", "seq")


@query(
    f"""WITH {_LINES}, h AS (SELECT paper_id, seq, char_start FROM lines WHERE {_IS_HEADING})
    SELECT paper_id, seq, char_start, coalesce(lead(char_start) OVER (PARTITION BY paper_id ORDER BY seq), length(text))::BIGINT AS char_end FROM h JOIN documents ON doc_id = paper_id"""
)
def section_bounds(spark, sf_dir):
    h = _lines(spark, sf_dir).where(T.is_heading(F.col("text"))).select("paper_id", "seq", "char_start")
    d = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), F.length("text").alias("n"))
    end = F.coalesce(F.lead("char_start").over(Window.partitionBy("paper_id").orderBy("seq")), F.col("n")).cast("long")
    return h.join(d, "paper_id").withColumn("char_end", end).drop("n")


def _parsed(spark, sf_dir):
    sizes = layout.body_font_size(_lines(spark, sf_dir))
    return _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), "text").join(sizes, "paper_id")


@query()
def section_path(spark, sf_dir):
    lines = layout.group_lines(_lines(spark, sf_dir))
    parsed = _parsed(spark, sf_dir)
    return layout.sections(layout.headings(lines, parsed), parsed)


@query()
def drop_references(spark, sf_dir):
    s = section_path(spark, sf_dir)
    return s.where(~F.col("is_references")).groupBy("used_fallback").agg(F.count(F.lit(1)).alias("n_sections"))


@query(f"WITH {_LINES} SELECT paper_id, seq + 1 AS idx, {_STRIP} AS text, char_start, char_start + length(text) AS char_end FROM lines WHERE {_STRIP} <> ''")
def group_lines(spark, sf_dir):
    return layout.group_lines(_lines(spark, sf_dir)).select("paper_id", "idx", "text", "char_start", "char_end")


@query(
    f"""WITH {_LINES}, w AS (SELECT paper_id, font_size, greatest(1, length(text)) AS n FROM lines), r AS (SELECT paper_id, font_size, unnest(range(0, n)) AS k FROM w)
    SELECT paper_id, quantile_cont(font_size, 0.5) AS body_font_size FROM r GROUP BY paper_id"""
)
def body_font_size(spark, sf_dir):
    return layout.body_font_size(_lines(spark, sf_dir))


@query(
    f"""WITH {_LINES}, i AS (SELECT doc_id AS paper_id, (n_chars // 3)::BIGINT AS char_start, (2 * n_chars // 3)::BIGINT AS char_end FROM documents)
    SELECT i.paper_id, i.char_start, i.char_end, coalesce(min(page), 1)::INT AS page_start, coalesce(max(page), 1)::INT AS page_end
    FROM i LEFT JOIN lines l ON l.paper_id = i.paper_id AND l.char_start < i.char_end AND l.char_start + length(l.text) > i.char_start GROUP BY ALL"""
)
def page_range(spark, sf_dir):
    d = _read(spark, sf_dir, "documents")
    i = d.select(F.col("doc_id").alias("paper_id"), F.floor(F.col("n_chars") / 3).alias("char_start"), F.floor(F.col("n_chars") * 2 / 3).alias("char_end"))
    return layout.page_range(i, _lines(spark, sf_dir).select("paper_id", "char_start", "char_end", "page"))


@query(f"WITH {_LINES} SELECT paper_id, page FROM lines GROUP BY ALL HAVING sum(length(text) + CASE WHEN seq = 0 THEN 0 ELSE 2 END) < 280")
def figure_only_pages(spark, sf_dir):
    return layout.figure_only_pages(_assembled(spark, sf_dir))


def _assembled(spark, sf_dir):
    return layout.assemble(_lines(spark, sf_dir).select("paper_id", "page", F.col("block").alias("block_position"), "line", "text"))


@query("SELECT doc_id AS paper_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents WHERE text IS NOT NULL")
def document_text(spark, sf_dir):
    return layout.document_text(_assembled(spark, sf_dir))


@query()
def reading_order(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    left = F.when(F.col("seq") % 2 == 0, 50.0).otherwise(310.0)
    boxes = lines.select("paper_id", "page", "block", F.lit(0.0).alias("page_x0"), F.lit(600.0).alias("page_x1"), left.alias("x0"), (F.col("seq") % 20 * 30).cast("double").alias("y0"), (left + F.when(F.length("text") > 400, 480).otherwise(240)).alias("x1"), (F.col("seq") % 20 * 30 + 25).cast("double").alias("y1"))
    return layout.reading_order(boxes).select("paper_id", "page", "block", "position", "two_columns")


# Stored tables


@query(f"""WITH {_CHUNKS}, c AS (SELECT count(*) AS chunks, count(*) FILTER (WHERE token_count < 50) AS short_chunks, count(DISTINCT chunk_config_sha256) AS chunkings, count(DISTINCT section_path) AS distinct_sections,
    count(DISTINCT paper_id) AS papers_with_chunks, coalesce(sum(page_end - page_start + 1), 0)::BIGINT AS pages FROM chunks)
    SELECT (SELECT count(DISTINCT source) FROM documents) AS papers, c.*, CASE WHEN papers_with_chunks > 0 THEN chunks / papers_with_chunks ELSE 0 END AS mean_chunks_per_paper FROM c""")
def corpus_stats(spark, sf_dir):
    c = _chunks(spark, sf_dir)
    return store.corpus_stats(c.select("paper_id").distinct(), c)


@query(f"WITH {_CHUNKS} SELECT count(*) AS fallback_papers FROM (SELECT paper_id FROM chunks GROUP BY 1 HAVING bool_and(section_path = 'Body'))")
def fallback_papers(spark, sf_dir):
    return store.fallback_papers(_chunks(spark, sf_dir))


@query(
    f"""WITH {_CHUNKS} SELECT min(token_count) AS min, quantile_cont(token_count, 0.05) AS p5, quantile_cont(token_count, 0.25) AS p25, quantile_cont(token_count, 0.5) AS p50, quantile_cont(token_count, 0.75) AS p75,
    quantile_cont(token_count, 0.95) AS p95, max(token_count) AS max FROM chunks"""
)
def token_percentiles(spark, sf_dir):
    return store.token_percentiles(_chunks(spark, sf_dir))


@query(f"WITH {_CHUNKS} SELECT chunk_id, token_count FROM chunks WHERE token_count < 50")
def short_chunks(spark, sf_dir):
    return _chunks(spark, sf_dir).where(F.col("token_count") < store.SHORT_CHUNK).select("chunk_id", "token_count")


@query(f"WITH {_CHUNKS} SELECT DISTINCT paper_id FROM chunks WHERE chunk_config_sha256 = 'de'")
def chunks_exist(spark, sf_dir):
    c = _chunks(spark, sf_dir)
    return c.select("paper_id").distinct().join(plans.one_chunking(c, "de").select("paper_id"), "paper_id", "left_semi")


@query("SELECT doc_id AS chunk_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def pending_chunks(spark, sf_dir):
    return store.pending_chunks(_chunks(spark, sf_dir), _vectors(spark, sf_dir), "m").select("chunk_id")


_CACHED = "cached AS (SELECT sha256(text) AS digest, min(doc_id) AS chunk_id FROM documents JOIN embeddings ON doc_id = vec_id GROUP BY 1)"


@query(f"WITH {_CACHED} SELECT digest, chunk_id FROM cached WHERE digest IN (SELECT sha256(text) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings))")
def cached_vectors(spark, sf_dir):
    c, v = _chunks(spark, sf_dir), _vectors(spark, sf_dir)
    return store.cached_vectors(v, c, store.pending_chunks(c, v, "m").select(F.col("embed_input_sha256").alias("digest")), "m").select("digest", "chunk_id")


@query(f"WITH {_CACHED} SELECT digest, round(embedding[1]::DOUBLE, 6) AS first FROM cached JOIN embeddings ON vec_id = chunk_id WHERE digest IN (SELECT sha256(text) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings))")
def vector_cache(spark, sf_dir):
    """Digests of texts without a vector, looked up in a cache that holds those of all others."""
    c, v = _chunks(spark, sf_dir), _vectors(spark, sf_dir)
    table = "quill_cache_" + hashlib.sha256(f"{sf_dir} {spark.sparkContext.applicationId}".encode()).hexdigest()[:16]
    cache = VectorCache(spark, table)
    known = store.cached_vectors(v, c, c.select(F.col("embed_input_sha256").alias("digest")), "m")
    cache.put(known, "m")
    found = cache.lookup(store.pending_chunks(c, v, "m").select(F.col("embed_input_sha256").alias("digest")), "m")
    return found.select("digest", F.round(F.col("vec")[0].cast("double"), 6).alias("first"))


_PLAN = f"""{_CACHED}, r AS (SELECT doc_id AS chunk_id, sha256(text) AS digest, vec_id IS NOT NULL AS has FROM documents LEFT JOIN embeddings ON doc_id = vec_id),
    plan AS (SELECT r.chunk_id, r.digest, CASE WHEN has THEN 'already' WHEN c.digest IS NOT NULL THEN 'cached' WHEN row_number() OVER (PARTITION BY r.digest, has ORDER BY r.chunk_id) = 1 THEN 'encoded' ELSE 'duplicate' END AS status
             FROM r LEFT JOIN cached c ON r.digest = c.digest)"""


@query(f"WITH {_PLAN} SELECT * FROM plan")
def embed_plan(spark, sf_dir):
    return store.embed_plan(_chunks(spark, sf_dir), _vectors(spark, sf_dir), "m")


@query(
    f"""WITH {_PLAN}, n AS (SELECT count(*) FILTER (WHERE status = 'already') AS already_embedded, count(*) FILTER (WHERE status = 'cached') AS cache_hits, count(*) FILTER (WHERE status = 'encoded') AS encoded,
    count(*) FILTER (WHERE status = 'duplicate') AS duplicates FROM plan) SELECT *, CASE WHEN cache_hits + encoded > 0 THEN cache_hits / (cache_hits + encoded) ELSE 0 END AS hit_rate FROM n"""
)
def embed_report(spark, sf_dir):
    return store.embed_report(embed_plan(spark, sf_dir))


@query("SELECT source AS paper_id, min(doc_id) AS chunk_id, sha256(text) AS content_sha256 FROM documents WHERE lang <> 'en' AND sha256(text) || source NOT IN (SELECT sha256(text) || source FROM documents WHERE lang = 'fr') GROUP BY source, sha256(text)")
def insert_ignore_chunks(spark, sf_dir):
    c = _chunks(spark, sf_dir)
    key = ("paper_id", "content_sha256")
    return store.insert_ignore(c.where("chunk_config_sha256 = 'fr'"), c.where("chunk_config_sha256 <> 'en'"), key, ("chunk_id",)).select("paper_id", "chunk_id", "content_sha256")


@query("SELECT vec_id AS chunk_id, label FROM embeddings WHERE label <> 0")
def insert_ignore_vectors(spark, sf_dir):
    v = _vectors(spark, sf_dir).withColumn("label", F.col("chunk_config_sha256").cast("int"))
    both = v.unionByName(v)
    return store.insert_ignore(v.where("label = 0"), both, store.VECTOR_KEY, ("chunk_id",)).select("chunk_id", "label")


@query(
    """SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN n.c_custkey IS NULL THEN o.c_name ELSE n.c_name END AS c_name, o.c_mktsegment
    FROM (SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey % 3 <> 0) o FULL JOIN (SELECT c_custkey, upper(c_name) || '!' AS c_name FROM customer WHERE c_custkey % 2 = 0) n ON o.c_custkey = n.c_custkey"""
)
def upsert_papers(spark, sf_dir):
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    new = c.where("c_custkey % 2 = 0").select("c_custkey", F.concat(F.upper("c_name"), F.lit("!")).alias("c_name"))
    return store.upsert(c.where("c_custkey % 3 <> 0"), new, "c_custkey", ("c_name",))


@query("SELECT d.doc_id FROM documents d WHERE NOT (doc_id % 3 <> 0 AND doc_id IN (SELECT doc_id FROM labels))")
def incremental_skip(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("pdf_sha256"))
    stored = d.select("id", F.when(F.col("id") % 3 != 0, F.col("pdf_sha256")).otherwise("changed").alias("pdf_sha256"))
    done = _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("paper_id"), F.lit("c").alias("chunk_config_sha256"))
    return d.join(store.unchanged(d, stored, done, "c").select("id"), "id", "left_anti").select(F.col("id").alias("doc_id"))


@query("SELECT vec_id AS chunk_id, coalesce(lang, label::VARCHAR) AS chunk_config_sha256 FROM embeddings LEFT JOIN documents ON doc_id = vec_id")
def backfill_chunking_key(spark, sf_dir):
    return store.backfill_chunking_key(_vectors(spark, sf_dir), _chunks(spark, sf_dir)).select("chunk_id", "chunk_config_sha256")


def _named(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select(F.concat(F.lit("p"), "doc_id", F.lit("v"), F.col("doc_id") % 3 + 1).alias("id"), F.col("lang").alias("title"))


def _asked(spark, sf_dir):
    b = _read(spark, sf_dir, "labels")
    # A third of the ids asked for are bare, a third have a version that may not be there.
    return b.select(F.col("doc_id").alias("position"), F.concat(F.lit("p"), F.col("doc_id"), F.when(F.col("doc_id") % 3 == 0, "").otherwise("v2")).alias("id"))


_ASKED = "asked AS (SELECT doc_id AS position, 'p' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'v2' END AS id FROM labels), named AS (SELECT 'p' || doc_id || 'v' || (doc_id % 3 + 1) AS id, 'p' || doc_id AS bare, lang AS title FROM documents)"


@query(f"WITH {_ASKED} SELECT n.id, title, min(position) AS position FROM asked a JOIN named n ON a.id = n.id OR a.id = n.bare GROUP BY ALL")
def fetch_by_ids(spark, sf_dir):
    return store.fetch_by_ids(_asked(spark, sf_dir), _named(spark, sf_dir))


@query(f"WITH {_ASKED} SELECT position, id FROM asked WHERE id NOT IN (SELECT id FROM named) AND id NOT IN (SELECT bare FROM named)")
def missing_ids(spark, sf_dir):
    return store.missing_ids(_asked(spark, sf_dir), _named(spark, sf_dir))


@query("SELECT sha256(text) AS digest, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1")
def dedup_digest(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("digest"), "doc_id")
    return d.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, lang FROM documents ORDER BY sha256('0.42' || doc_id), doc_id LIMIT 20")
def sample_chunks(spark, sf_dir):
    return store.seeded_sample(_read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "0.42", 20)


def _pages(spark, sf_dir):
    """Documents as spans of a file: a block for each line, pages of 20; a seventh can't be read, an eleventh has no file."""
    d = _lines(spark, sf_dir)
    bad = F.col("paper_id") % 7 == 0
    box = [F.lit(float(x)).alias(c) for c, x in (("page_x0", 0), ("page_y0", 0), ("page_x1", 600), ("page_y1", 800), ("x0", 50), ("x1", 500))]
    y = (F.col("seq") % 20 * 30).cast("double")
    return d.select(
        "paper_id", "page", *box, F.col("seq").cast("int").alias("block"), y.alias("y0"), (y + 20).alias("y1"), F.lit(0).alias("line"), F.lit(0).alias("span"), F.when(~bad, F.col("text")).alias("text"),
        F.col("font_size").alias("size"), F.lit("Times").alias("font"), F.lit(0).alias("flags"), F.when(bad, "ValueError: no").alias("error"),
    )


def _ingested(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").where(F.length("text") > 0)
    corpus = d.select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.when(F.col("doc_id") % 11 != 0, F.sha2("text", 256)).alias("pdf_sha256"))
    # A third is stored as it is, and chunked.
    papers = corpus.where("id % 3 = 0 and pdf_sha256 is not null")
    config = RetrievalConfig(chunk_tokens=64)
    made = papers.select(F.col("id").alias("paper_id"), F.lit(0).cast("long").alias("ordinal"), F.lit("x").alias("content_sha256"), F.lit(config.chunking_sha256()).alias("chunk_config_sha256"), F.col("id").alias("chunk_id"))
    return ingest.ingest(corpus, _pages(spark, sf_dir), papers, made, config)


@query("""WITH d AS (SELECT *, doc_id % 11 <> 0 AS has_file FROM documents WHERE length(text) > 0)
    SELECT doc_id AS paper_id, CASE WHEN doc_id % 3 = 0 AND has_file THEN 'skipped' WHEN NOT has_file OR doc_id % 7 = 0 THEN 'failed' ELSE 'ingested' END AS status,
    CASE WHEN doc_id % 3 = 0 AND has_file THEN NULL WHEN NOT has_file THEN 'no file' WHEN doc_id % 7 = 0 THEN 'ValueError: no' END AS reason FROM d""")
def ingest_status(spark, sf_dir):
    return _ingested(spark, sf_dir).status.select("paper_id", "status", "reason")


@query("""WITH d AS (SELECT doc_id % 3 = 0 AND doc_id % 11 <> 0 AS skipped, NOT (doc_id % 3 = 0 AND doc_id % 11 <> 0) AND (doc_id % 11 = 0 OR doc_id % 7 = 0) AS failed FROM documents WHERE length(text) > 0)
    SELECT count(*) AS papers_seen, count(*) FILTER (WHERE NOT skipped AND NOT failed) AS papers_ingested, count(*) FILTER (WHERE skipped) AS papers_skipped_unchanged, count(*) FILTER (WHERE failed) AS papers_failed FROM d""")
def ingest_report(spark, sf_dir):
    return ingest.report(_ingested(spark, sf_dir).status).select("papers_seen", "papers_ingested", "papers_skipped_unchanged", "papers_failed")


@query()
def ingest_chunks(spark, sf_dir):
    c = _ingested(spark, sf_dir).chunks
    return c.select("chunk_id", "paper_id", "ordinal", "section_path", "token_count", "page_start", "page_end", "char_start", "char_end", "content_sha256")


@query("SELECT DISTINCT trim(split_part(line, '#', 1)) AS id FROM (SELECT unnest(string_split(c_name || '  # ' || c_mktsegment || chr(10) || '# comment' || chr(10) || '  ' || c_custkey || '  ' || chr(10), chr(10))) AS line FROM customer) WHERE trim(split_part(line, '#', 1)) <> ''")
def manifest_scan(spark, sf_dir):
    """A manifest that is written and read again."""
    path = f"{shared.shared_folder(spark)}/manifest-{uuid.uuid4().hex}"
    c = _read(spark, sf_dir, "customer")
    lines = F.array(F.concat("c_name", F.lit("  # "), "c_mktsegment"), F.lit("# comment"), F.concat(F.lit("  "), F.col("c_custkey").cast("string"), F.lit("  ")), F.lit(""))
    c.select(F.explode(lines).alias("value")).write.text(path)
    atexit.register(shared.remove_folder, spark, path)
    return metadata.read_manifest(spark, path).distinct()


@query("SELECT o_orderkey::VARCHAR AS id, o_orderkey || '  # ' || substr(o_orderpriority, 1, 90) AS line FROM orders")
def manifest_listing(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_orderdate").alias("published_at"))
    return metadata.manifest_lines(o)


@query("SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 6) AS total, len(embedding)::INTEGER AS dim FROM embeddings")
def vector_decode(spark, sf_dir):
    e = _read(spark, sf_dir, "embeddings").select("vec_id", V.decode(F.concat(F.lit("["), F.array_join(F.col("embedding").cast("array<double>").cast("array<string>"), ","), F.lit("]"))).alias("v"))
    return e.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.size("v").alias("dim"))
