"""The best rows of each query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best(rows: DataFrame, k: int, *order: Column | str, by: str = "query_id") -> DataFrame:
    """The first ``k`` rows of each ``by`` in an order, with ``rank`` from 0.

    The limit stands on the row number itself, so every task keeps only ``k`` rows of each key before the shuffle.
    """
    number = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("rank", number).where(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)
