"""Structural segmentation of clean pages into parts, chapters, articles, schedules and contents pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params
from ..functions.text import stripped, title_case
from ..plans.sizes import small
from ..plans.stages import stage
from .carry import carried


def toc_lines(text):
    """(lines that are not blank, how many of them look like entries of a table of contents) of a page."""
    lines = F.filter(F.transform(F.split(text, "\n", -1), stripped), lambda s: s != "")
    return lines, F.size(F.filter(lines, lambda s: s.rlike(params.TOC_LINE)))


def is_toc_page(text):
    """A contents marker near the top and three entries, or entries on more than half of the lines."""
    lines, hits = toc_lines(text)
    marked = F.substring(text, 1, 400).rlike(params.TOC_MARKER)
    return (F.size(lines) > 0) & ((marked & (hits >= 3)) | (F.lit(2) * hits > F.size(lines)))


def mark_lines(pages: DataFrame, books: DataFrame) -> DataFrame:
    """One row per event of a book in order (book_file, pdf_page, n): lines, header labels, contents pages.

    ``kind`` is header, toc, text (the empty segment after a contents page), part, title, chapter, schedule, article or
    line. Marker lines are told apart in books of kind ``constitution`` only.
    """
    p = pages.join(small(books.select(F.col("file").alias("book_file"), F.col("kind").alias("book_kind")), 100_000), "book_file")
    toc = is_toc_page(F.col("text"))
    lines = F.filter(F.transform(F.split("text", "\n", -1), stripped), lambda s: s != "")
    event = lambda kind, s: F.struct(F.lit(kind).alias("kind"), s.alias("s"))
    body = F.when(toc, F.array(event("toc", F.col("text")), event("text", F.lit("")))).otherwise(F.transform(lines, lambda s: event("line", s)))
    head = F.when(F.col("header_part").isNotNull(), F.array(event("header", F.col("header_part")))).otherwise(F.array().cast("array<struct<kind:string,s:string>>"))
    rows = p.select("book_file", "pdf_page", "printed_page", "book_kind", F.posexplode(F.concat(head, body)).alias("n", "e")).select("book_file", "pdf_page", "printed_page", "book_kind", "n", "e.kind", "e.s")
    s = F.col("s")
    marker = (
        F.when(s.rlike(params.PART) & (F.length(s) < 80), "part")
        .when(s.rlike(params.CHAPTER) & (F.length(s) < 90), "chapter")
        .when(s.rlike(params.SCHEDULE), "schedule")
        .when(s.rlike(params.ARTICLE), "article")
        .otherwise("line")
    )
    rows = rows.withColumn("kind", F.when((F.col("kind") == "line") & (F.col("book_kind") == "constitution"), marker).otherwise(F.col("kind")))
    bare = (F.col("kind") == "part") & (F.trim(F.coalesce(F.regexp_extract("s", params.PART, 2), F.lit(""))) == "")
    # Only line rows clear a pending title, so only they are looked back over.
    on_line = ~F.col("kind").isin("header", "toc", "text")
    rows = carried(stage(rows), {"pending": F.when(on_line, bare)}, before=True).withColumn("on_line", on_line)
    capital = (F.upper("s") == s) & (F.lower("s") != s) & (F.length(s) < 60)
    return rows.withColumn("kind", F.when(F.col("on_line") & F.coalesce("pending", F.lit(False)) & capital & (F.col("kind") != "part"), "title").otherwise(F.col("kind"))).drop("on_line", "pending")


def segment(pages: DataFrame, books: DataFrame) -> DataFrame:
    """(book_file, seg, pdf_page, printed_page, part, chapter, article, article_title, section_type, text).

    Segments begin at parts, schedules, articles and contents pages and keep the page on which they begin. Labels are
    carried forward within blocks of pages, then from block to block, so a large book is many tasks.
    """
    rows = stage(mark_lines(pages, books))
    kind, s = F.col("kind"), F.col("s")
    title = F.trim(F.coalesce(F.regexp_extract("s", params.PART, 2), F.lit("")))
    part = F.concat(F.lit("Part "), F.regexp_extract("s", params.PART, 1), F.when(title != "", F.concat(F.lit(" — "), title_case(title))).otherwise(""))
    base = F.when(kind == "header", s).when(kind == "part", part)
    rows = carried(rows, {"base": base})
    named = F.when(kind == "title", F.concat("base", F.lit(" — "), title_case(s)))
    chapter_title = F.trim(F.regexp_extract("s", params.CHAPTER, 2))
    chapter = F.concat(F.lit("Chapter "), F.upper(F.regexp_extract("s", params.CHAPTER, 1)), F.when(chapter_title != "", F.concat(F.lit(" — "), title_case(chapter_title))).otherwise(""))
    # A struct tells "reset to none" from "nothing happened".
    reset = F.when(kind == "chapter", F.struct(chapter.alias("v"))).when(kind == "part", F.struct(F.lit(None).cast("string").alias("v")))
    opens = kind.isin("toc", "text", "part", "schedule", "article")
    # What stands before the first opening event of a book is a segment, too.
    begin = rows.groupBy("book_file").agg(F.min(F.struct("pdf_page", "n")).alias("begin"))
    rows = rows.join(small(begin, 100_000), "book_file")
    head = opens | (F.struct("pdf_page", "n") == F.col("begin"))
    rows = carried(stage(rows), {"run_part": F.coalesce(base, named), "run_chapter": reset}, counts={"seg": head.cast("int")})
    rows = rows.withColumn("run_chapter", F.col("run_chapter.v")).withColumn("head", head)
    pick = lambda c: F.max(F.when(F.col("head"), c))
    schedule = F.concat(title_case(F.regexp_extract("s", params.SCHEDULE, 1)), F.lit(" Schedule"))
    own_part = F.when(kind == "schedule", schedule).otherwise(F.col("run_part"))
    kept = ~kind.isin("header", "part", "title", "chapter") & (s != "")
    lines = F.array_sort(F.collect_list(F.when(kept, F.struct("pdf_page", "n", "s"))))
    out = rows.groupBy("book_file", "seg").agg(
        pick(F.col("pdf_page")).alias("pdf_page"), pick(F.col("printed_page")).alias("printed_page"),
        F.coalesce(F.max(F.when(kind == "title", F.col("run_part"))), pick(own_part)).alias("part"),
        pick(F.when(kind == "schedule", None).otherwise(F.col("run_chapter"))).alias("chapter"),
        pick(F.when(kind == "article", F.upper(F.regexp_extract("s", params.ARTICLE, 1)))).alias("article"),
        pick(F.when(kind == "article", F.trim(F.regexp_extract("s", params.ARTICLE, 2)))).alias("article_title"),
        pick(F.when(kind.isin("toc", "schedule", "article"), kind).otherwise("text")).alias("section_type"),
        F.array_join(F.transform(lines, lambda x: x["s"]), "\n").alias("text"),
    )
    return out.withColumn("text", stripped(F.col("text"))).where("text <> ''")
