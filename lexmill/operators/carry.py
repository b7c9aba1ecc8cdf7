"""Values carried forward over the rows of a book, block by block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.sizes import small
from ..plans.stages import stage

#: Numbered keys up to which their table is broadcast, so that the rows need not move.
FEW_KEYS = 200_000
#: Pages of a block.
BLOCK = 32


def carried(rows: DataFrame, values: dict[str, Column], before: bool = False, counts: dict[str, Column] | None = None) -> DataFrame:
    """Adds the last non-null value so far of each of ``values``, and the running sum of each of ``counts``, in order of page and line.

    With ``before`` the row itself does not count. Rows are ordered within blocks of pages; what a block hands on is
    ordered in one narrow row for each block, so no task sees more lines of a book than a block holds.
    """
    counts = counts or {}
    at = F.struct("pdf_page", "n")
    rows = rows.withColumn("_block", F.floor(F.col("pdf_page") / BLOCK)).withColumns({f"_v_{k}": v for k, v in values.items()} | {f"_c_{k}": v for k, v in counts.items()})
    last = [F.max_by(f"_v_{k}", F.when(F.col(f"_v_{k}").isNotNull(), at)).alias(f"_b_{k}") for k in values]
    total = [F.sum(f"_c_{k}").alias(f"_b_{k}") for k in counts]
    earlier = Window.partitionBy("book_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("book_file", "_block").agg(*last, *total)
    blocks = blocks.select("book_file", "_block", *[F.last(f"_b_{k}", True).over(earlier).alias(f"_b_{k}") for k in values], *[F.coalesce(F.sum(f"_b_{k}").over(earlier), F.lit(0)).alias(f"_b_{k}") for k in counts])
    inner = Window.partitionBy("book_file", "_block").orderBy("pdf_page", "n").rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    rows = rows.join(blocks, ["book_file", "_block"])
    found = {k: F.coalesce(F.last(f"_v_{k}", True).over(inner), F.col(f"_b_{k}")) for k in values} | {k: F.coalesce(F.sum(f"_c_{k}").over(inner), F.lit(0)) + F.col(f"_b_{k}") for k in counts}
    return rows.withColumns(found).drop("_block", *[c for k in values for c in (f"_v_{k}", f"_b_{k}")], *[c for k in counts for c in (f"_c_{k}", f"_b_{k}")])


def numbered(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """Adds ``name``: the place of each row within its ``key`` in ``order``, from 1; rows that tie have places in no set order.

    Only keys and order are dealt out by ranges: they are counted up within a range, and ranges hand on their sums, so a large
    key is many tasks and no other column moves for it. The rows meet their numbers afterwards.
    """
    keys = rows.groupBy(key, *order).agg(F.count("*").alias("_m"))
    dealt = stage(keys.repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id()))
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(key, "_part").agg(F.sum("_m").alias("_size"))
    sizes = sizes.select(F.col(key).alias("_key"), F.col("_part").alias("_p"), F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    within = F.coalesce(F.sum("_m").over(Window.partitionBy(key, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    met = dealt.join(sizes, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_p")))
    met = met.select(*[F.col(c).alias(f"_{c}") for c in (key, *order)], (within + F.col("_before") + 1).cast("long").alias(name))
    met = small(met, FEW_KEYS)
    on = F.lit(True)
    for c in (key, *order):
        on &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    out = rows.join(met, on).drop(*[f"_{c}" for c in (key, *order)])
    if not dealt.where("_m > 1").isEmpty():
        out = out.withColumn(name, F.col(name) + F.row_number().over(Window.partitionBy(key, *order).orderBy(F.lit(0))) - 1)
    return out
