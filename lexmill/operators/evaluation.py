"""Evaluation of plans against expected outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def outcomes(expected: DataFrame, planned: DataFrame, context: DataFrame) -> DataFrame:
    """(query_id, positive, refused, ok) of ``expected(query_id, articles, keywords, refuse)``.

    Negatives pass if refused. Positives pass if not refused and an expected article is among those of the passages
    or a keyword is in their text.
    """
    rows = expected.join(planned.select("query_id", "kind"), "query_id").join(context, "query_id", "left")
    refused = F.col("kind") != "answer"
    negative = F.coalesce("refuse", F.lit(False))
    none = F.array().cast("array<string>")
    text = F.lower(F.coalesce("context", F.lit("")))
    hit = F.arrays_overlap(F.coalesce("articles", none), F.coalesce("known", none)) | F.exists(F.coalesce("keywords", none), lambda k: F.contains(text, F.lower(k)))
    return rows.select("query_id", (~negative).alias("positive"), refused.alias("refused"), F.when(negative, refused).otherwise(~refused & F.coalesce(hit, F.lit(False))).alias("ok"))


def metrics(results: DataFrame, reports: DataFrame | None = None) -> DataFrame:
    """One row: hit_rate and refusal_accuracy in percent, and flag_rate of answered positives if reports are given."""
    rate = lambda cond: F.round(100 * F.avg(F.when(cond, F.col("ok").cast("int"))), 1)
    out = results.agg(rate(F.col("positive")).alias("hit_rate"), rate(~F.col("positive")).alias("refusal_accuracy"))
    if reports is None:
        return out
    answered = results.where("positive and not refused").join(reports.select("query_id", "verified"), "query_id")
    flags = answered.agg(F.round(100 * F.count_if(~F.col("verified")) / F.greatest(F.lit(1), F.count("*")), 1).alias("flag_rate"))
    return out.crossJoin(F.broadcast(flags))


def report_lines(results: DataFrame, planned: DataFrame) -> DataFrame:
    """(query_id, line): PASS or FAIL, confidence and question."""
    rows = results.join(planned.select("query_id", "confidence", "question"), "query_id")
    verdict = F.when(F.col("ok"), "PASS").otherwise("FAIL")
    return rows.select("query_id", F.concat(verdict, F.lit("  ["), F.rpad("confidence", 6, " "), F.lit("] "), F.col("question")).alias("line"))
