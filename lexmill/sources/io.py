"""Readers and writers of the jobs' tables and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import stripped
from ..operators.carry import numbered


def number_pages(raw: DataFrame, order: list[str]) -> DataFrame:
    """Raw page texts ``(book_file, text, …)`` numbered from 1 within each book by ``order``; all pages are kept."""
    rows = numbered(raw.select("book_file", "text", *order), "book_file", order, "pdf_page")
    return rows.select("book_file", F.col("pdf_page").cast("int").alias("pdf_page"), "text")


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """The registry, a JSON file with an array ``books``, as rows with their ``position``."""
    rows = spark.read.schema(f"books array<struct<{_struct(schemas.BOOK)}>>").json(path, multiLine=True)
    return rows.select(F.posexplode("books").alias("position", "b")).select("position", "b.*")


def _struct(ddl: str) -> str:
    return ",".join(":".join(f.strip().split(" ", 1)) for f in ddl.split(","))


def included_books(books: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(books to include that have pages, those that have none)."""
    present = pages.select(F.col("book_file").alias("file")).distinct()
    wanted = books.where("include")
    return wanted.join(present, "file", "left_semi"), wanted.join(present, "file", "left_anti")


def write_chunks(chunks: DataFrame, path: str) -> None:
    """JSON lines, a folder for each book."""
    chunks.write.partitionBy("book_file").json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines in the declared schema; blank lines are skipped."""
    return spark.read.schema(schemas.CHUNK).json(path).where("id is not null")


def write_article_index(index: DataFrame, path: str) -> None:
    """(article, ids) rows to one JSON object a line."""
    index.select(F.to_json(F.map_from_arrays(F.array("article"), F.array("ids"))).alias("value")).write.text(path)


def read_article_index(spark: SparkSession, path: str) -> DataFrame:
    """(article, chunk_id, pos) of JSON objects that map articles to ids."""
    rows = spark.read.text(path).select(F.from_json("value", "map<string,array<long>>").alias("m"))
    rows = rows.select(F.explode("m").alias("article", "ids"))
    return rows.select("article", F.posexplode("ids").alias("pos", "chunk_id")).select("article", "chunk_id", "pos")


def manifest(chunks: DataFrame, stats: DataFrame, model: str | None, dim: int) -> DataFrame:
    """One row: count, articles_indexed, embedding_model, dim, build_date, books."""
    indexed = chunks.select(F.explode("article_numbers").alias("a")).agg(F.countDistinct("a").cast("int").alias("articles_indexed"))
    top = chunks.agg(F.count("*").alias("count")).crossJoin(F.broadcast(indexed))
    books = stats.agg(F.array_sort(F.collect_list(F.struct(F.col("book_file").alias("file"), "pages", "pages_dropped", "chunks"))).alias("books"))
    row = top.crossJoin(F.broadcast(books)).withColumns({"embedding_model": F.lit(model if dim else None).cast("string"), "dim": F.lit(dim), "build_date": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")})
    return row.select("count", "articles_indexed", "embedding_model", "dim", "build_date", "books")


def read_eval_questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.EVAL_QUESTION).json(path, multiLine=True).select(F.monotonically_increasing_id().alias("query_id"), "*")


def validate_requests(requests: DataFrame, most: int = 500, turns: int = 6) -> DataFrame:
    """Requests ``(query_id, question, history)`` with the question stripped, well-formed turns only, and ``reason``.

    ``reason`` is null for good requests, else missing, empty or too long; rejected rows stay.
    """
    q = stripped(F.col("question"))
    reason = F.when(F.col("question").isNull(), "missing").when(q == "", "empty").when(F.length(q) > most, "too long")
    good = F.filter("history", lambda t: t["role"].isin("user", "assistant") & t["content"].isNotNull())
    kept = F.slice(good, F.greatest(F.lit(1), F.size(good) - turns + 1), turns)
    return requests.select("query_id", q.alias("question"), F.coalesce(kept, F.array().cast(schemas.TURN)).alias("history"), reason.alias("reason"))


def health(manifest_row: DataFrame, chunks: DataFrame, vectors: DataFrame | None = None, dim: int = 0) -> DataFrame:
    """One row: mode, chunks, articles and embeddings of an index; hybrid with as many vectors of the right length as chunks."""
    row = manifest_row.select(F.col("count").alias("chunks"), F.col("articles_indexed").alias("articles"))
    if vectors is None:
        return row.select(F.lit("bm25").alias("mode"), "chunks", "articles", F.lit(False).alias("embeddings"))
    have = vectors.agg(F.count("*").alias("vectors"), F.count_if(F.size("vector") == dim).alias("right"))
    full = (F.col("vectors") == F.col("chunks")) & (F.col("right") == F.col("chunks"))
    return row.crossJoin(F.broadcast(have)).select(F.when(full, "hybrid").otherwise("bm25").alias("mode"), "chunks", "articles", full.alias("embeddings"))


def answer_log(planned: DataFrame, selected: DataFrame, reports: DataFrame | None = None, calls: DataFrame | None = None) -> DataFrame:
    """(query_id, q, articles, confidence, mode, chunks, model, ms, kind, verified): one record for each question.

    ``calls(query_id, model, ms)`` holds what answered and how long it took, ``reports(query_id, verified)`` the checks.
    """
    ids = selected.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("n", "chunk_id"))).alias("c"))
    rows = planned.join(ids.select("query_id", F.transform("c", lambda x: x["chunk_id"]).alias("chunks")), "query_id", "left")
    if calls is None:
        calls = planned.select("query_id", F.lit(None).cast("string").alias("model"), F.lit(None).cast("long").alias("ms"))
    rows = rows.join(calls.select("query_id", "model", "ms"), "query_id", "left")
    model = F.when(F.col("kind") == "answer", F.col("model"))
    verified = F.lit(None).cast("boolean")
    if reports is not None:
        rows, verified = rows.join(reports.select("query_id", "verified"), "query_id", "left"), F.col("verified")
    return rows.select("query_id", F.substring("question", 1, 200).alias("q"), "articles", "confidence", "mode", F.coalesce("chunks", F.array().cast("array<long>")).alias("chunks"), model.alias("model"), "ms", "kind", verified.alias("verified"))
