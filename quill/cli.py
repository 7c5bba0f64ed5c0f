"""python -m quill.cli: ingest, embed, index, search, bench-index, stats, manifest, migrate, health over a warehouse's tables."""

from __future__ import annotations

import argparse
import json
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quill import registry
from quill.config import FUSIONS, RetrievalConfig
from quill.operators import cells, embedding, impacts, store
from quill.plans import benchmark, ingest
from quill.plans.retrieve import candidates, compare_modes, retrieve
from quill.sources import commits, metadata, pdf, tables
from quill.sources.vector_cache import VectorCache


def report(df: DataFrame, title: str) -> str:
    """A one-row report as lines for people."""
    row = df.first().asDict()
    width = max(map(len, row))
    return "\n".join([title, *(f"  {k.ljust(width)}  {v}" for k, v in row.items())])


def listing(rows) -> list[str]:
    """Candidates as lines for people: the rank after and before reranking, where the chunk stands, and how it begins."""
    out = []
    for r in rows:
        rerank = f" rerank {r.rerank_score:.3f}" if r.rerank_score is not None else ""
        out.append(f"{r['rank']}. [{r.chunk_id}] {r.paper_title or r.paper_id} — {r.section_path} p. {r.page_start}-{r.page_end} was #{r.fused_rank} score {r.score:.4f}{rerank}")
        out.append(f"   {' '.join(r.content.split())[:160]}")
    return out


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="quill")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("stats")
    sub.add_parser("health")
    m = sub.add_parser("manifest")
    m.add_argument("path")
    i = sub.add_parser("ingest", help="papers from Atom files, and the spans of their files")
    i.add_argument("atom")
    i.add_argument("files")
    i.add_argument("--extractor", required=True, help="a registered extractor")
    i.add_argument("--manifest", help="only the ids in this file")
    i.add_argument("--counter", default="whitespace")
    e = sub.add_parser("embed")
    e.add_argument("--encoder", default="digest")
    e.add_argument("--cache", help="a bucketed table of vectors by digest, made if it isn't there")
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("--fusion", default="rrf", choices=FUSIONS)
    s.add_argument("--top-k", type=int, default=5)
    s.add_argument("--compare", action="store_true")
    s.add_argument("--encoder", default="digest")
    s.add_argument("--scorer", default="word_overlap", help="a registered scorer")
    s.add_argument("--index", help="search the stored index in this folder; its dense arm reads the nearest cells alone")
    x = sub.add_parser("index", help="bring the stored index in a folder up to date with the tables, or make one")
    x.add_argument("path")
    b = sub.add_parser("bench-index")
    b.add_argument("path")
    b.add_argument("--cells", type=int, help="as the number of rows suggests, if not given")
    b.add_argument("--queries", type=int, default=benchmark.QUERIES)
    b.add_argument("--rebuild", action="store_true")
    b.add_argument("--encoder", default="digest")
    g = sub.add_parser("migrate")
    g.add_argument("folder")
    g.add_argument("--status", action="store_true")
    return parser


def _ingest(spark: SparkSession, args, config: RetrievalConfig) -> int:
    """0 unless nothing was ingested and nothing skipped. Chunks are committed before papers, so that an ingest that ends in between is done again; if another one changes papers meanwhile, this one starts anew."""
    tables.create(spark)
    for attempt in range(3):
        try:
            return _ingest_once(spark, args, config)
        except commits.Conflict:
            if attempt == 2:
                raise
    raise AssertionError


def _ingest_once(spark: SparkSession, args, config: RetrievalConfig) -> int:
    seen = tables.version(spark, "papers")
    papers = metadata.read_atom(spark, args.atom)
    if args.manifest:
        papers = papers.join(metadata.read_manifest(spark, args.manifest), "id", "left_semi")
    files = metadata.read_files(spark, args.files)
    corpus = metadata.corpus(papers, files)
    spans = pdf.extract_spans(files, registry.EXTRACTORS.get(args.extractor)).join(corpus.select("path", F.col("id").alias("paper_id")), "path").drop("path")
    done = ingest.ingest(corpus, spans, tables.read(spark, "papers"), tables.read(spark, "chunks"), config, registry.COUNTERS.get(args.counter))
    status = store.checkpoint(done.status)
    tables.append_new(done.chunks, "chunks", store.CHUNK_KEY)
    tables.replace(done.papers, "papers", seen)
    print(report(ingest.report(status), "ingest"))
    for r in status.where("status = 'failed'").orderBy("paper_id").limit(10).collect():
        print(f"    ! {r.paper_id}: {r.reason}")
    return 0 if status.where("status <> 'failed'").limit(1).count() else 1


def _embed(spark: SparkSession, args, config: RetrievalConfig) -> int:
    chunks, vectors, key = tables.read(spark, "chunks"), tables.read(spark, "embeddings"), config.chunking_sha256()
    plan = store.checkpoint(store.embed_plan(chunks, vectors, config.embedding_model, key))
    new = embedding.embed(chunks, vectors, config.embedding_model, registry.ENCODERS.get(args.encoder), key, VectorCache(spark, args.cache) if args.cache else None)
    written = tables.append_new(new, "embeddings", store.VECTOR_KEY)
    print(report(store.embed_report(plan).withColumns({"chunks_total": F.lit(plan.count()), "written": F.lit(written)}), "embed"))
    return 0


def _index(spark: SparkSession, args, config: RetrievalConfig) -> int:
    key = config.chunking_sha256()
    chunks = tables.read(spark, "chunks").where(F.col("chunk_config_sha256") == key)
    vectors = tables.read(spark, "embeddings").where((F.col("chunk_config_sha256") == key) & (F.col("model") == config.embedding_model))
    for name, module, rows in (("blocks", impacts, chunks), ("cells", cells, vectors)):
        path = f"{args.path}/{name}"
        if not tables.exists(spark, f"{path}/_log"):
            module.write_index(rows, path)
        index = module.read_index(spark, path).updated(rows)
        print(f"{name}: version {index.state.version}, {len(index.segments)} segments")
    return 0


def _search(spark: SparkSession, args, config: RetrievalConfig) -> int:
    config = replace(config, fusion=args.fusion, final_top_k=args.top_k)
    queries = embedding.encode_queries(spark.createDataFrame([(0, args.query)], "query_id long, query string"), registry.ENCODERS.get(args.encoder))
    key = config.chunking_sha256()
    scorer = registry.SCORERS.get(args.scorer)()
    chunks, papers = tables.read(spark, "chunks").where(F.col("chunk_config_sha256") == key), tables.read(spark, "papers")
    vectors = tables.read(spark, "embeddings").where((F.col("chunk_config_sha256") == key) & (F.col("model") == config.embedding_model))
    if args.compare:
        found = compare_modes(queries, chunks, vectors, replace(config, fusion="rrf"), scorer).join(chunks.select("chunk_id", "section_path"), "chunk_id")
        for r in found.orderBy("arm", "rank").collect():  # four times top-k rows
            print(f"{r.arm:13} {r['rank']}. [{r.chunk_id}] {r.section_path} was #{r.was}")
        return 0
    stored = {"index": impacts.read_index(spark, f"{args.index}/blocks"), "cells": cells.read_index(spark, f"{args.index}/cells"), "chunking": key} if args.index else {}
    hits = retrieve(queries, chunks, None if stored else vectors, config, scorer, **stored)
    rows = candidates(hits, chunks, papers).orderBy("rank").collect()  # top-k rows
    if rows and rows[0].reason:
        print(f"refused: {rows[0].reason}")
        return 0
    print("\n".join(listing(rows)) if rows else "nothing found")
    return 0


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    config = RetrievalConfig()
    if args.command == "health":
        found = tables.health(spark)
        print(json.dumps(found))
        return 0 if found["ok"] else 1
    if args.command == "migrate":
        if args.status:
            for version, name, applied in tables.status(spark, args.folder):
                print(f"{version:03d} {name} {'applied' if applied else 'pending'}")
        else:
            print("applied", *tables.migrate(spark, args.folder))
        return 0
    if args.command == "manifest":
        metadata.write_manifest(spark.read.table("papers"), args.path)
        return 0
    if args.command == "stats":
        chunks = spark.read.table("chunks")
        print(report(store.corpus_stats(spark.read.table("papers"), chunks), "corpus"))
        print(report(store.token_percentiles(chunks), "tokens"))
        return 0
    if args.command == "bench-index":
        key = config.chunking_sha256()
        chunks = spark.read.table("chunks").where(F.col("chunk_config_sha256") == key)
        vectors = spark.read.table("embeddings").where((F.col("chunk_config_sha256") == key) & (F.col("model") == config.embedding_model))
        queries = embedding.encode_queries(benchmark.sample_queries(chunks, args.queries), registry.ENCODERS.get(args.encoder))
        print("\n".join(benchmark.lines(benchmark.benchmark_index(spark, queries, vectors, args.path, args.cells, rebuild=args.rebuild))))
        return 0
    return {"ingest": _ingest, "embed": _embed, "index": _index, "search": _search}[args.command](spark, args, config)


if __name__ == "__main__":
    raise SystemExit(main())
