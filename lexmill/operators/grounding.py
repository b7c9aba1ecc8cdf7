"""Checks of answers against the passages they cite: citations, quotes, article numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import quote_supports, stripped

# Citation markers, quotes and named articles in answers.
MARK = r"\[(\d{1,2})\]"
QUOTED = r"[\"“]([^\"”]{20,})[\"”]"
NAMED = r"(?i)\bArticles?\s+(\d{1,3}[A-Z]{0,3})\b"


def citations(answer, n):
    """(text without markers outside 1..n, invalid numbers in order with repeats)."""
    marks = F.transform(F.regexp_extract_all(answer, F.lit(MARK), F.lit(1)), lambda d: d.cast("int"))
    valid = lambda k: (k >= 1) & (k <= n)
    shown = F.transform(F.regexp_extract_all(answer, F.lit(MARK), F.lit(0)), lambda m: F.when(valid(F.regexp_extract(m, MARK, 1).cast("int")), m).otherwise(""))
    text = F.array_join(F.zip_with(F.split(answer, MARK, -1), shown, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")
    return text, F.filter(marks, lambda k: ~valid(k))


def quotes(answer):
    """Quoted spans of 20 characters or more, and all lines that begin with > as one quote."""
    spans = F.regexp_extract_all(answer, F.lit(QUOTED), F.lit(1))
    block = F.filter(F.split(answer, "\n", -1), lambda line: stripped(line).startswith(">"))
    block = F.array_join(F.transform(block, lambda line: stripped(F.regexp_replace(F.regexp_replace(line, r"^\s*>\s?", ""), r"\[\d+\]", ""))), " ")
    return F.concat(spans, F.when(F.length(block) >= 20, F.array(block)).otherwise(F.array().cast("array<string>")))


def unknown_articles(answer, known, context):
    """Distinct article numbers of an answer that are neither in ``known`` nor a word of the context."""
    named = F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(NAMED), F.lit(1)), F.upper))
    return F.filter(F.array_except(named, known), lambda a: ~F.rlike(context, F.concat(F.lit(r"(?i)\b"), a, F.lit(r"\b"))))


def context_of(selected: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, n_sources, context, known): the passages of each query in order and the articles they hold."""
    rows = selected.select("query_id", "n", F.col("chunk_id").alias("id")).join(chunks.select("id", "text", F.concat("article_numbers", "mentions").alias("arts")), "id")
    one = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("n", "text", "arts"))).alias("c"))
    return one.select("query_id", F.size("c").alias("n_sources"), F.array_join(F.transform("c", lambda x: x["text"]), "\n").alias("context"), F.array_distinct(F.flatten(F.transform("c", lambda x: x["arts"]))).alias("known"))


def check_grounding(answers: DataFrame, context: DataFrame, least: float = 0.9) -> DataFrame:
    """(query_id, text, verified, unverified_quotes, unknown_articles, invalid_citations) of ``answers(query_id, answer)``.

    Answers without any passage are checked against an empty context.
    """
    rows = answers.join(context, "query_id", "left")
    rows = rows.select("query_id", "answer", F.coalesce("n_sources", F.lit(0)).alias("n"), F.coalesce("context", F.lit("")).alias("context"), F.coalesce("known", F.array().cast("array<string>")).alias("known"))
    text, invalid = citations(F.col("answer"), F.col("n"))
    rows = rows.withColumn("text", text).withColumn("invalid_citations", invalid)
    rows = rows.withColumn("quotes", quotes(F.col("text"))).withColumn("supports", quote_supports(F.col("quotes"), F.col("context")))
    rows = rows.withColumn("unverified_quotes", F.filter("quotes", lambda q, i: F.get("supports", i) < least))
    rows = rows.withColumn("unknown_articles", unknown_articles(F.col("text"), F.col("known"), F.col("context")))
    fine = (F.size("unverified_quotes") == 0) & (F.size("unknown_articles") == 0) & (F.size("invalid_citations") == 0)
    return rows.select("query_id", "text", fine.alias("verified"), "unverified_quotes", "unknown_articles", "invalid_citations")


def needs_retry():
    return ~F.col("verified") & ((F.size("unverified_quotes") > 0) | (F.size("unknown_articles") > 0))


def choose_regenerated(first: DataFrame, second: DataFrame) -> DataFrame:
    """(query_id, text, verified, regenerated): the second report where the first asked for it and the second is verified."""
    again = second.select("query_id", F.col("text").alias("text2"), F.col("verified").alias("verified2"))
    rows = first.join(again, "query_id", "left")
    take = needs_retry() & F.coalesce("verified2", F.lit(False))
    return rows.select("query_id", F.when(take, F.col("text2")).otherwise(F.col("text")).alias("text"), (F.col("verified") | take).alias("verified"), take.alias("regenerated"))
