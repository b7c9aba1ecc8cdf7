"""Builds of a corpus published whole: files of a build in a folder of its own, the manifest's row last.

A reader takes the latest row of the manifest and the folder it names, so a build that was broken off, or that the quality
gate stopped, is never seen, and the one before stays readable.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import quality as A
from . import io

MANIFEST = (
    "version int, build string, count bigint, articles_indexed int, embedding_model string, dim int, build_date string, "
    "books array<struct<file:string,pages:bigint,pages_dropped:bigint,chunks:bigint>>, quality struct<n_chunks:bigint,avg_chars:double,tagged_pct:double,n_junk:bigint,junk_share:double>"
)


def publish(chunks: DataFrame, filtered: DataFrame, root: str, model: str | None = None, dim: int = 0, most: float = 0.05) -> dict:
    """Write chunks and article index of a build, then its manifest; gives the manifest's row.

    ``filtered`` are the build's pages with ``kept``. The quality report is observed by the write of the chunks, which reads them
    once; where more than ``most`` of them look like junk the build is not published.
    """
    spark, build = chunks.sparkSession, uuid.uuid4().hex
    seen = Observation(f"quality-{build}")
    io.write_chunks(chunks.observe(seen, *A.report_columns()), f"{root}/{build}/chunks")
    report = seen.get
    A.gate(report, most)
    written = io.read_chunks(spark, f"{root}/{build}/chunks")
    io.write_article_index(A.article_index(written), f"{root}/{build}/articles")
    row = io.manifest(written, A.book_stats(filtered, written), model, dim)
    before = manifests(spark, root)
    last = before.agg(F.coalesce(F.max("version"), F.lit(0)).alias("last")) if before is not None else spark.range(1).select(F.lit(0).alias("last"))
    quality = F.struct(*[F.lit(report[k]).alias(k) for k in ("n_chunks", "avg_chars", "tagged_pct", "n_junk", "junk_share")])
    row = row.crossJoin(F.broadcast(last)).select((F.col("last") + 1).alias("version"), F.lit(build).alias("build"), *[c for c in row.columns], quality.alias("quality"))
    row.coalesce(1).write.mode("append").json(f"{root}/manifest")
    return current(spark, root)


def manifests(spark: SparkSession, root: str) -> DataFrame | None:
    """A row for each published build; None where there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(MANIFEST).json(f"{root}/manifest")


def current(spark: SparkSession, root: str) -> dict:
    """The manifest of the latest build."""
    rows = manifests(spark, root)
    row = rows.orderBy(F.desc("version")).first() if rows is not None else None
    if row is None:
        raise FileNotFoundError(f"nothing is published in {root}")
    return row.asDict(recursive=True)


def chunks_of(spark: SparkSession, root: str) -> DataFrame:
    """The chunks of the latest build."""
    return io.read_chunks(spark, f"{root}/{current(spark, root)['build']}/chunks")


def articles_of(spark: SparkSession, root: str) -> DataFrame:
    """(article, chunk_id, pos) of the latest build."""
    return io.read_article_index(spark, f"{root}/{current(spark, root)['build']}/articles")
