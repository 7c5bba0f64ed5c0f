"""Greedy packing of sentences into overlapping, token-budgeted chunks.

A paper is a row with its sections, and its pages if they are known; its chunks are made in one
pass over an Arrow batch, so ordinals across a paper need no shuffle of chunks and no text is
copied more than a chunk needs.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quill.functions import sentences as S
from quill.functions.text import budget_for
from quill.functions.tokens import TokenCounter, WhitespaceCounter

SECTIONS = "array<struct<ordinal:int,path:string,char_start:int,text:string>>"
PAGES = "array<struct<page:int,char_start:int,char_end:int>>"
_COLUMNS = ("ordinal", "section_path", "content", "embed_input", "token_count", "page_start", "page_end", "char_start", "char_end")
#: Papers in one Arrow batch: texts are long.
BATCH = "500"


def chunk_papers(papers: DataFrame, chunk_tokens: int, overlap_pct: float, headers: bool = True, model: str = "", counter: Callable[[], TokenCounter] = WhitespaceCounter) -> DataFrame:
    """Chunks of papers (paper_id, title, sections, pages, figure_only): one row a chunk, ordinals from 0 across the paper.

    sections: their texts, and where in the paper they begin. pages (may be null): where each page
    begins and ends in the paper's text. figure_only (may be null): pages without prose, whose
    sentences are left out (one that reaches onto another page stays). Columns: paper_id, ordinal,
    section_path, content, embed_input, token_count (of embed_input), page_start, page_end (1, 1 of
    unknown pages), char_start, char_end, content_sha256, embed_input_sha256. Chunks never cross
    sections. Null text gives no chunk.
    """
    papers.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    kind = dict(papers.dtypes)["paper_id"]
    rows = papers.select("paper_id", "title", F.col("sections").cast(SECTIONS).alias("sections"), F.col("pages").cast(PAGES).alias("pages"), F.col("figure_only").cast("array<int>").alias("figure_only"))
    made: dict = {}

    def chunks_of(title: str | None, sections: list[dict], where: S.Pages):
        count = made["counter"].counts
        n = 0
        for s in sorted(sections, key=lambda s: s["ordinal"]):
            head = f"{title or ''} — {s['path']}\n\n" if headers else ""
            budget = budget_for(model, chunk_tokens, count([head])[0] if head else 0)
            text, base = s["text"] or "", s["char_start"]
            spans = [(a, b) for a, b in S.split(text) if not where.only_figures(base + a, base + b)]
            own = S.fitted(text, spans, budget, made["counter"])
            for first, last in S.pack([t for *_, t in own], budget, int(budget * overlap_pct)):
                content = " ".join(text[a:b] for a, b, _ in own[first : last + 1])
                start, end = base + own[first][0], base + own[last][1]
                yield (n, s["path"], content, head + content, 0, *where.range(start, end), start, end)
                n += 1

    def run(batches):
        made.setdefault("counter", counter())
        for batch in batches:
            at, out = [], []
            for i, (title, sections, pages, figures) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("title", "sections", "pages", "figure_only")), strict=True)):
                own = list(chunks_of(title, sections or [], S.Pages(pages, figures)))
                at += [i] * len(own)
                out += own
            columns = dict(zip(_COLUMNS, zip(*out, strict=True), strict=True)) if out else {c: () for c in _COLUMNS}
            columns["token_count"] = made["counter"].counts(list(columns["embed_input"]))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("paper_id").take(pa.array(at, pa.int64())), *(pa.array(columns[c], k) for c, k in zip(_COLUMNS, kinds, strict=True))], names=["paper_id", *_COLUMNS])

    out = rows.mapInArrow(run, f"paper_id {kind}, ordinal long, section_path string, content string, embed_input string, token_count long, page_start int, page_end int, char_start long, char_end long")
    return out.withColumns({"content_sha256": F.sha2("content", 256), "embed_input_sha256": F.sha2("embed_input", 256)})


def chunk_sections(sections: DataFrame, chunk_tokens: int, overlap_pct: float, headers: bool = True, model: str = "", drop_references: bool = True, counter: Callable[[], TokenCounter] = WhitespaceCounter) -> DataFrame:
    """chunk_papers() of sections as rows (paper_id, title, ordinal, path, text, char_start, is_references); a paper's sections meet in a row."""
    rows = sections.where(~F.col("is_references")) if drop_references else sections
    papers = rows.groupBy("paper_id").agg(F.max("title").alias("title"), F.collect_list(F.struct(F.col("ordinal").cast("int").alias("ordinal"), "path", F.col("char_start").cast("int").alias("char_start"), "text")).alias("sections"))
    return chunk_papers(papers.withColumns({"pages": F.lit(None).cast(PAGES), "figure_only": F.lit(None).cast("array<int>")}), chunk_tokens, overlap_pct, headers, model, counter)


def one_section(docs: DataFrame, text_col: str = "text", path: str = "Body") -> DataFrame:
    """docs (paper_id, title, text) as papers of one section, without pages."""
    body = F.array(F.struct(F.lit(0).alias("ordinal"), F.lit(path).alias("path"), F.lit(0).alias("char_start"), F.col(text_col).alias("text"))).cast(SECTIONS)
    return docs.select("paper_id", "title", body.alias("sections"), F.lit(None).cast(PAGES).alias("pages"), F.lit(None).cast("array<int>").alias("figure_only"))
