"""Page cleaning: running headers, repeating edge lines, page numbers, page filter.

Pages are ``(book_file, pdf_page, text)``. Lines stay in arrays inside their page, so cleaning needs no
shuffle but the count of edge lines; that one combines before it moves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params
from ..functions.text import line_key, mostly_devanagari, normalise, stripped, useful_chars
from ..plans.sizes import small
from ..plans.stages import stage

#: Books up to which a table with a row for each is broadcast.
FEW_BOOKS = 100_000


def _lines(text="text"):
    return F.split(F.col(text), "\n", -1)


def repeating_lines(pages: DataFrame, ratio: float = 0.3) -> DataFrame:
    """(book_file, key, n_pages): keys of four characters or more on the first or last three lines of many pages.

    Many is max(3, int(ratio x pages of the book)); every page given counts. Null texts have no lines.
    """
    lines = _lines()
    edge = F.concat(F.slice(lines, 1, 3), F.slice(lines, F.greatest(F.lit(1), F.size(lines) - 2), 3))
    keys = F.array_distinct(F.filter(F.transform(edge, line_key), lambda k: F.length(k) > 3))
    found = pages.select("book_file", F.explode(keys).alias("key")).groupBy("book_file", "key").agg(F.count("*").alias("n_pages"))
    size = pages.groupBy("book_file").agg(F.count("*").alias("pages"))
    enough = F.greatest(F.lit(3), F.floor(F.col("pages") * ratio))
    return found.join(size, "book_file").where(F.col("n_pages") >= enough).select("book_file", "key", "n_pages")


def clean_pages(pages: DataFrame, ratio: float = 0.3, header: str = params.HEADER, compat: bool = True) -> DataFrame:
    """(book_file, pdf_page, printed_page, header_part, text): every page without headers, repeating lines and page numbers.

    Lines are tested in this order: header (its part label is kept, the last on the page), repeating, lone number
    on the first or last three lines (the first that is not 0 is the printed page). Null texts give empty pages.
    """
    repeating = stage(repeating_lines(pages, ratio).groupBy("book_file").agg(F.collect_set("key").alias("repeating")))
    rows = pages.withColumn("text", F.coalesce("text", F.lit(""))).join(small(repeating, FEW_BOOKS), "book_file", "left")
    n = F.size("lines")
    line = lambda x, i: F.struct(x.alias("s"), i.alias("i"))
    rows = rows.withColumn("lines", F.transform(_lines(), stripped)).withColumn("all", F.transform("lines", line))
    is_header = lambda x: x["s"].rlike(header) & (F.length(x["s"]) < 140)
    is_repeated = lambda x: F.coalesce(F.array_contains("repeating", line_key(x["s"])), F.lit(False)) & (F.length(x["s"]) < 140) & (x["s"] != "")
    is_number = lambda x: x["s"].rlike(params.LONE_NUMBER) & ((x["i"] < 3) | (x["i"] >= n - 3))
    rows = rows.withColumn("headers", F.filter("all", lambda x: is_header(x) & x["s"].rlike(params.HEADER_PART)))
    rows = rows.withColumn("body", F.filter("all", lambda x: ~is_header(x) & ~is_repeated(x)))
    rows = rows.withColumn("numbers", F.filter(F.transform(F.filter("body", is_number), lambda x: F.regexp_extract(x["s"], params.LONE_NUMBER, 1).cast("int")), lambda v: v != 0))
    last = F.try_element_at("headers", F.lit(-1))["s"]
    label = F.concat(F.lit("Part "), F.upper(F.regexp_extract(last, params.HEADER_PART, 1)))
    title = F.regexp_extract(last, params.HEADER_PART, 2)
    named = F.regexp_replace(title, r"^[ .—-]+|[ .—-]+$", "")
    part = F.when(F.trim(title) != "", F.concat(label, F.lit(" — "), named)).otherwise(label)
    kept = F.array_join(F.transform(F.filter("body", lambda x: ~is_number(x)), lambda x: x["s"]), "\n")
    return rows.select(
        "book_file", "pdf_page", F.try_element_at("numbers", F.lit(1)).alias("printed_page"),
        F.when(last.isNotNull(), part).alias("header_part"), normalise(kept, compat).alias("text"),
    )


def page_filter(clean: DataFrame, least: int = 40) -> DataFrame:
    """Clean pages with ``useful``, ``devanagari`` and ``kept``: enough letters and not mostly Devanagari."""
    rows = clean.withColumn("useful", useful_chars(F.col("text"))).withColumn("devanagari", mostly_devanagari(F.col("text")))
    return rows.withColumn("kept", (F.col("useful") >= least) & ~F.col("devanagari"))


def preview(pages: DataFrame) -> DataFrame:
    """(book_file, pages, text): the first 800 characters of the first of a book's first three pages that is not blank."""
    text = stripped(F.col("text"))
    usable = (F.col("pdf_page") <= 3) & (text != "")
    return pages.groupBy("book_file").agg(F.count("*").alias("pages"), F.min_by(F.when(usable, F.substring(text, 1, 800)), F.when(usable, F.col("pdf_page"))).alias("text"))
