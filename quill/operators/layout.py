"""Page layout: reading order, text assembly, lines, headings, sections.

Inputs are tables of an extractor: raw_blocks (a row a block) and spans (a row a span).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quill.functions import text as T
from quill.operators.overlap import overlap_range

FULL_WIDTH, FIGURE_CHARS = 0.65, 280
HEADING_RATIO, HEADING_CHARS, HEADING_WORDS = 1.05, 100, 12
DOCUMENT_PAGE = ("paper_id", "page")


def is_bold(flags, font):
    """Whether a span is bold, by its flags or its font's name."""
    name = F.lower(font)
    return (flags.bitwiseAND(F.lit(16)) > 0) | name.contains("bold") | name.contains("-bd")


def reading_order(blocks: DataFrame) -> DataFrame:
    """blocks (paper_id, page, block, page_x0, page_x1, x0, y0, x1, y1, …) with position (from 0 in the page) and two_columns.

    A page with fewer than two blocks on either side is read from top to bottom. Else blocks
    wider than 0.65 of the page part it into bands; a band is read left, then right, then its
    separator. A block that begins beside a separator has no place and goes.
    """
    page = Window.partitionBy(*DOCUMENT_PAGE)
    width = F.col("page_x1") - F.col("page_x0")
    middle = F.col("page_x0") + width / 2
    wide = (F.col("x1") - F.col("x0")) > FULL_WIDTH * width
    left = (F.col("x0") + F.col("x1")) / 2 < middle
    rows = blocks.withColumns({"_wide": wide, "_left": left})
    two = (F.count_if(~F.col("_wide") & F.col("_left")).over(page) >= 2) & (F.count_if(~F.col("_wide") & ~F.col("_left")).over(page) >= 2)
    rows = rows.withColumn("two_columns", two)
    down = page.orderBy("y0", F.col("_wide").cast("int").desc(), "x0", "block")
    above = down.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"_band": F.coalesce(F.count_if("_wide").over(above), F.lit(0)), "_floor": F.max(F.when(F.col("_wide"), F.col("y1"))).over(above)})
    lost = F.col("two_columns") & ~F.col("_wide") & F.coalesce(F.col("y0") < F.col("_floor"), F.lit(False))
    side = F.when(F.col("_wide"), 2).when(F.col("_left"), 0).otherwise(1)
    band = F.when(F.col("two_columns"), F.col("_band")).otherwise(0)
    column = F.when(F.col("two_columns"), side).otherwise(0)
    order = page.orderBy("_b", "_c", "y0", "x0", "block")
    rows = rows.where(~lost).withColumns({"_b": band, "_c": column})
    return rows.withColumn("position", F.row_number().over(order) - 1).drop("_wide", "_left", "_band", "_floor", "_b", "_c")


def assemble(lines: DataFrame) -> DataFrame:
    """lines (paper_id, page, block_position, line, text, …) with char_start and char_end in the document's text, and sep (what stands before).

    Blocks are parted by a blank line, lines of a block by a space; a line that ends in a letter and
    a hyphen loses the hyphen and joins the next.
    """
    order = Window.partitionBy("paper_id").orderBy("page", "block_position", "line")
    before = lambda c: F.lag(c).over(order)
    same = (before("page") == F.col("page")) & (before("block_position") == F.col("block_position"))
    last = ~F.coalesce((F.lead("page").over(order) == F.col("page")) & (F.lead("block_position").over(order) == F.col("block_position")), F.lit(False))
    hyphen = F.col("text").rlike(r"\p{L}-$") & ~last
    rows = lines.withColumn("text", T.strip_controls(F.col("text"))).withColumn("_hyphen", hyphen)
    rows = rows.withColumn("text", F.when(F.col("_hyphen"), F.expr("substring(text, 1, length(text) - 1)")).otherwise(F.col("text")))
    sep = F.when(before("page").isNull(), "").when(~same, "\n\n").when(before("_hyphen"), "").otherwise(" ")
    rows = rows.withColumn("sep", sep)
    end = F.sum(F.length("sep") + F.length("text")).over(order)
    return rows.withColumn("char_end", end).withColumn("char_start", F.col("char_end") - F.length("text")).drop("_hyphen")


def document_text(assembled: DataFrame) -> DataFrame:
    """(paper_id, text) of assembled lines. A document's lines meet in one row."""
    whole = F.transform(F.array_sort(F.collect_list(F.struct("char_start", F.concat("sep", "text").alias("t")))), lambda x: x["t"])
    return assembled.groupBy("paper_id").agg(F.array_join(whole, "").alias("text"))


def figure_only_pages(assembled: DataFrame) -> DataFrame:
    """(paper_id, page) of pages that add fewer than 280 characters."""
    return assembled.groupBy("paper_id", "page").agg(F.sum(F.length("sep") + F.length("text")).alias("n")).where(F.col("n") < FIGURE_CHARS).select("paper_id", "page")


def body_font_size(spans: DataFrame) -> DataFrame:
    """(paper_id, body_font_size): the median of sizes, to 0.1, a span counting by its length (1 at least)."""
    size = F.percentile(F.bround("font_size", 1), F.lit(0.5), F.greatest(F.lit(1), F.length("text")).cast("long"))
    return spans.groupBy("paper_id").agg(size.alias("body_font_size"))


def page_range(intervals: DataFrame, spans: DataFrame) -> DataFrame:
    """intervals (paper_id, char_start, char_end, …) with page_start, page_end of the spans they overlap; 1, 1 if none. Equal rows come once."""
    found = overlap_range(intervals, spans, "paper_id", "char_start", "char_end", "page").select(
        F.col("paper_id").alias("_p"), F.col("char_start").alias("_s"), F.col("char_end").alias("_e"), "low", "high"
    )
    met = intervals.distinct().join(found, (intervals["paper_id"] == F.col("_p")) & (intervals["char_start"] == F.col("_s")) & (intervals["char_end"] == F.col("_e")), "left")
    kind = dict(spans.dtypes)["page"]
    return met.select(*intervals.columns, F.coalesce(F.col("low").cast(kind), F.lit(1)).alias("page_start"), F.coalesce(F.col("high").cast(kind), F.lit(1)).alias("page_end"))


def group_lines(spans: DataFrame) -> DataFrame:
    """(paper_id, idx, text, char_start, char_end, font_size, bold): runs of spans of one page, block and line; empty lines go."""
    order = Window.partitionBy("paper_id").orderBy("seq")
    fresh = F.coalesce(F.struct("page", "block", "line") != F.lag(F.struct("page", "block", "line")).over(order), F.lit(True))
    rows = spans.withColumn("idx", F.sum(fresh.cast("int")).over(order))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "")
    lines = rows.groupBy("paper_id", "idx").agg(T.strip(joined).alias("text"), F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"), F.max("font_size").alias("font_size"), F.bool_or("bold").alias("bold"))
    return lines.where("text <> ''")


def headings(lines: DataFrame, parsed: DataFrame) -> DataFrame:
    """Lines that are headings, with number (or null), depth, title. parsed: paper_id, body_font_size, …"""
    rows = lines.join(parsed.select("paper_id", "body_font_size"), "paper_id")
    looks = F.length("text").between(3, HEADING_CHARS) & (T.count_words(F.col("text")) <= HEADING_WORDS) & T.reads_like_title(F.col("text"))
    stands_out = F.col("bold") | (F.col("font_size") >= F.col("body_font_size") * HEADING_RATIO)
    number = T.heading_number(F.col("text"))
    depth = F.when(number.isNull(), 1).otherwise(F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1)
    return rows.where(looks & stands_out & T.is_heading(F.col("text"))).select("paper_id", "idx", "char_start", number.alias("number"), depth.alias("depth"), F.when(number.isNull(), T.strip(F.col("text"))).otherwise(F.col("text")).alias("title"))


def sections(heads: DataFrame, parsed: DataFrame) -> DataFrame:
    """(paper_id, ordinal, path, title, number, char_start, char_end, is_references, used_fallback), tiling each text.

    Under two headings a document is one section, Body. Text before the first heading is
    Frontmatter. A path has the titles of the headings that a heading stands under.
    """
    struct = F.struct("char_start", "idx", "number", "depth", "title")
    own = heads.groupBy("paper_id").agg(F.array_sort(F.collect_list(struct)).alias("hs"))
    rows = parsed.select("paper_id", F.length("text").alias("n")).join(own, "paper_id", "left")
    hs = F.coalesce("hs", F.array().cast(heads.groupBy().agg(F.collect_list(struct)).schema[0].dataType))
    kind = "struct<stack:array<string>,out:array<struct<path:string,title:string,number:string,char_start:int,is_references:boolean>>>"
    walked = F.aggregate(
        hs,
        F.struct(F.array().cast("array<string>").alias("stack"), F.array().cast("array<struct<path:string,title:string,number:string,char_start:int,is_references:boolean>>").alias("out")).cast(kind),
        lambda acc, h: F.transform(
            F.array(F.array_append(F.slice(acc["stack"], F.lit(1), F.least(h["depth"] - 1, F.size(acc["stack"]))), h["title"])),
            lambda s: F.struct(
                s.alias("stack"),
                F.array_append(acc["out"], F.struct(F.array_join(s, " > ").alias("path"), h["title"].alias("title"), h["number"].alias("number"), h["char_start"].cast("int").alias("char_start"), T.is_references(h["title"]).alias("is_references"))).alias("out"),
            ),
        )[0].cast(kind),
        lambda acc: acc["out"],
    )
    one = lambda name: F.array(F.struct(F.lit(name).alias("path"), F.lit(name).alias("title"), F.lit(None).cast("string").alias("number"), F.lit(0).alias("char_start"), F.lit(False).alias("is_references")))
    found = F.when(F.size(hs) < 2, one("Body")).when(F.element_at(hs, 1)["char_start"] > 0, F.concat(one("Frontmatter"), walked)).otherwise(walked)
    rows = rows.select("paper_id", "n", (F.size(hs) < 2).alias("used_fallback"), found.alias("found"))
    end = lambda: F.coalesce(F.get("found", F.col("ordinal") + 1)["char_start"], F.col("n"))
    out = rows.select("paper_id", "n", "used_fallback", "found", F.posexplode("found").alias("ordinal", "s"))
    return out.select("paper_id", "ordinal", "s.path", "s.title", "s.number", "s.char_start", end().alias("char_end"), "s.is_references", "used_fallback")
