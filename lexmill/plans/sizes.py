"""Broadcasts only behind a check of size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def small(df: DataFrame, most: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows, else as it is.

    The check stops after ``most`` + 1 rows.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
