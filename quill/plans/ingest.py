"""Ingest: papers and the spans of their files become sections and chunks; what is unchanged is skipped, what can't be read is counted.

One lazy plan for all papers. A paper that fails is a row with its reason, never the end of the job.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quill.config import CHUNKING, RetrievalConfig
from quill.functions.tokens import TokenCounter, WhitespaceCounter
from quill.operators import chunking, layout, store


def parsed(spans: DataFrame) -> DataFrame:
    """(paper_id, text, body_font_size, pages, figure_only, two_columns, sections) of spans (paper_id and the columns of sources.pdf.SPANS).

    sections has those of layout.sections() with their texts, each paper's in one array.
    """
    sound = spans.where("text is not null and error is null")
    blocks = sound.groupBy("paper_id", "page", "block").agg(
        *[F.min(c).alias(c) for c in ("page_x0", "x0", "y0")], *[F.max(c).alias(c) for c in ("page_x1", "x1", "y1")]
    )
    places = layout.reading_order(blocks).select("paper_id", "page", "block", F.col("position").alias("block_position"), "two_columns")
    in_line = F.array_sort(F.collect_list(F.struct("span", "text")))
    lines = sound.groupBy("paper_id", "page", "block", "line").agg(
        F.array_join(F.transform(in_line, lambda x: x["text"]), "").alias("text"), F.max("size").alias("font_size"), F.bool_or(layout.is_bold(F.coalesce("flags", F.lit(0)), F.coalesce("font", F.lit("")))).alias("bold")
    )
    assembled = layout.assemble(lines.join(places, ["paper_id", "page", "block"]))
    page = assembled.groupBy("paper_id", "page").agg(F.min("char_start").cast("int").alias("char_start"), F.max("char_end").cast("int").alias("char_end"), F.max("two_columns").alias("two"))
    pages = page.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct(F.col("page").cast("int").alias("page"), "char_start", "char_end"))).alias("pages"), F.bool_or("two").alias("two_columns"))
    figures = layout.figure_only_pages(assembled).groupBy("paper_id").agg(F.array_sort(F.collect_list(F.col("page").cast("int"))).alias("figure_only"))
    sizes = layout.body_font_size(sound.withColumnRenamed("size", "font_size"))
    whole = layout.document_text(assembled).join(sizes, "paper_id").join(pages, "paper_id").join(figures, "paper_id", "left")
    heads = layout.headings(assembled.where("text <> ''").select("paper_id", F.col("char_start").alias("idx"), layout.T.strip(F.col("text")).alias("text"), "char_start", "char_end", "font_size", "bold"), whole)
    own = layout.sections(heads, whole).groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "path", "title", "char_start", "char_end", "is_references"))).alias("found"), F.max("used_fallback").alias("used_fallback"))
    with_text = F.transform("found", lambda s: F.struct(s["ordinal"].alias("ordinal"), s["path"].alias("path"), s["char_start"].cast("int").alias("char_start"), F.col("text").substr(s["char_start"] + 1, (s["char_end"] - s["char_start"]).cast("int")).alias("text"), s["is_references"].alias("is_references")))
    return whole.join(own, "paper_id").withColumn("sections", with_text).drop("found")


def chunks_of(documents: DataFrame, titles: DataFrame, config: RetrievalConfig, counter: Callable[[], TokenCounter] = WhitespaceCounter) -> DataFrame:
    """Chunks of parsed() documents under a configuration, with its identity; titles: paper_id, title."""
    rows = documents.join(titles, "paper_id", "left")
    kept = F.filter("sections", lambda s: ~s["is_references"]) if config.drop_references else F.col("sections")
    plain = F.transform(kept, lambda s: F.struct(s["ordinal"].alias("ordinal"), s["path"].alias("path"), s["char_start"].alias("char_start"), s["text"].alias("text")))
    rows = rows.withColumns({"sections": plain, "figure_only": F.col("figure_only") if config.drop_figure_only_pages else F.lit(None).cast("array<int>")})
    out = chunking.chunk_papers(rows, config.chunk_tokens, config.chunk_overlap_pct, config.contextual_headers, config.embedding_model, counter)
    return with_identity(out, config)


def with_identity(chunks: DataFrame, config: RetrievalConfig) -> DataFrame:
    """Adds chunk_config (JSON of what makes the chunking) and chunk_config_sha256."""
    own = {name: getattr(config, name) for name in CHUNKING}
    return chunks.withColumns({"chunk_config": F.lit(json.dumps(own, sort_keys=True)), "chunk_config_sha256": F.lit(config.chunking_sha256())})


@dataclass
class Ingest:
    """What an ingest adds: chunks (with ids after those stored), papers (all, as an upsert leaves them), and status, a row a paper."""

    chunks: DataFrame
    papers: DataFrame
    status: DataFrame


def ingest(corpus: DataFrame, spans: DataFrame, papers: DataFrame, chunks: DataFrame, config: RetrievalConfig = RetrievalConfig(), counter: Callable[[], TokenCounter] = WhitespaceCounter) -> Ingest:
    """Plan the ingest of a corpus (columns of papers with pdf_sha256, null without a file; see sources.metadata.corpus) with its files' spans into stored papers and chunks.

    status: paper_id, status (ingested, skipped or failed), reason (of a failure), chunks_inserted,
    used_fallback, two_columns. Skipped are papers whose file and chunking are there already.
    """
    key = config.chunking_sha256()
    same = store.unchanged(corpus.where("pdf_sha256 is not null"), papers, chunks, key).select(F.col("id").alias("paper_id"), F.lit(True).alias("_same"))
    errors = spans.groupBy("paper_id").agg(F.min("error").alias("_error"), F.count_if(F.col("text").isNotNull()).alias("_spans"))
    rows = corpus.withColumnRenamed("id", "paper_id").join(same, "paper_id", "left").join(errors, "paper_id", "left")
    reason = F.when(F.col("pdf_sha256").isNull(), "no file").when(F.col("_error").isNotNull(), F.col("_error")).when(F.coalesce("_spans", F.lit(0)) == 0, "no text")
    rows = rows.withColumn("status", F.when(F.col("_same"), "skipped").when(reason.isNotNull(), "failed").otherwise("ingested")).withColumn("reason", F.when(F.col("status") == "failed", reason))
    todo = rows.where("status = 'ingested'")
    documents = parsed(spans.join(todo.select("paper_id"), "paper_id", "left_semi"))
    made = chunks_of(documents, todo.select("paper_id", "title"), config, counter)
    new = store.insert_ignore(chunks.where(F.col("chunk_config_sha256") == key), made, store.CHUNK_KEY, ("ordinal",))
    last = chunks.agg(F.max("chunk_id")).first()[0] or 0
    new = store.with_chunk_ids(new, last)
    done = documents.select("paper_id", "used_fallback", "two_columns").join(new.groupBy("paper_id").agg(F.count(F.lit(1)).alias("chunks_inserted")), "paper_id", "left")
    status = rows.select("paper_id", "status", "reason").join(done, "paper_id", "left")
    status = status.select("paper_id", "status", "reason", F.coalesce("chunks_inserted", F.lit(0)).alias("chunks_inserted"), F.coalesce("used_fallback", F.lit(False)).alias("used_fallback"), F.coalesce("two_columns", F.lit(False)).alias("two_columns"))
    fresh = todo.select(F.col("paper_id").alias("id"), *[c for c in papers.columns if c in corpus.columns and c != "id"])
    fresh = fresh.withColumn("ingested_at", F.current_timestamp()) if "ingested_at" in papers.columns else fresh
    changed = tuple(c for c in fresh.columns if c not in ("id", "ingested_at"))
    both = store.upsert(papers, fresh, "id", changed)
    if "ingested_at" in papers.columns:
        both = both.withColumn("ingested_at", F.coalesce("ingested_at", F.current_timestamp()))
    return Ingest(new, both, status)


def report(status: DataFrame) -> DataFrame:
    """One row of counters over status rows."""
    n = lambda s: F.count_if(F.col("status") == s)
    done = F.col("status") == "ingested"
    return status.agg(
        F.count(F.lit(1)).alias("papers_seen"), n("ingested").alias("papers_ingested"), n("skipped").alias("papers_skipped_unchanged"), n("failed").alias("papers_failed"),
        F.coalesce(F.sum("chunks_inserted"), F.lit(0)).alias("chunks_inserted"), F.count_if(done & F.col("used_fallback")).alias("section_fallbacks"), F.count_if(done & F.col("two_columns")).alias("two_column_papers"),
    )


