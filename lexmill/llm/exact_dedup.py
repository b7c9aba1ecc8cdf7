"""Exact duplicates by a persistent index of text digests, bucketed and sorted by digest.

The index is a Parquet table in a folder: a row for each digest that a load brought, with the greatest document id and
the number of documents that have it there. A load is grouped by digest, anti-joined with the index by sort and merge,
which needs no shuffle of the index, and appended. All of it is DataFrame and SQL functions.

The folder is all that has to last: a later session opens it again with ``open_index``, and a load that the index
has already is not added twice. ``compact`` writes one sorted file for each bucket and one row for each digest.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, pick, shared_dir

#: Digests that a bucket is meant for.
BUCKET_ROWS = 2_000_000
#: A digest with more than this share of all rows is resolved by a broadcast, of which there can be 1 / SHARE rows at most.
SHARE = 0.001
#: Copies of one row that are written out from one array.
COPIES = 65_536


def digest(text: Column) -> Column:
    """SHA-256 of a text in UTF-8, as binary; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def buckets_for(rows: int) -> int:
    """A power of two, 16 at least."""
    return 1 << max(4, (max(1, -(-rows // BUCKET_ROWS)) - 1).bit_length())


def _catalog(spark: SparkSession, path: str, buckets: int) -> str:
    """The name under which this session knows the bucketed table of a folder."""
    name = f"digest_index_{hashlib.md5(path.encode()).hexdigest()}"
    spark.sql(
        f"create table if not exists {name} (digest binary, keep_id bigint, n bigint, load string) using parquet "
        f"clustered by (digest) sorted by (digest) into {buckets} buckets location '{path}/rows-{buckets}'"
    )
    return name


def open_index(spark: SparkSession, path: str, rows: int = 0) -> str:
    """The index of a folder as a table's name; a new one is made for about ``rows`` digests where there is none."""
    try:
        buckets = spark.read.parquet(f"{path}/meta").agg(F.max("buckets")).first()[0]
    except AnalysisException:
        buckets = buckets_for(rows)
        spark.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.parquet(f"{path}/meta")
    return _catalog(spark, path, buckets)


def state(spark: SparkSession, index: str) -> DataFrame:
    """(digest, keep_id, n): a row for each digest of all loads."""
    return spark.table(index).groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))


def grouped(rows: DataFrame) -> DataFrame:
    """(digest, keep_id, n) of ``rows(digest, doc_id, m)``; partial groups are built before the shuffle."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.sum("m").alias("n"))


def unseen(groups: DataFrame, index: str) -> DataFrame:
    """The groups whose digest the index lacks."""
    return groups.join(groups.sparkSession.table(index).hint("merge"), "digest", "left_anti")


def add_load(rows: DataFrame, index: str, load: str) -> None:
    """Append ``rows(digest, doc_id, m)`` as a load: new digests, and what known ones gain in documents.

    One write, which is there whole or not at all; a load whose name the index has is not added again.
    """
    spark = rows.sparkSession
    if not spark.table(index).where(F.col("load") == load).isEmpty():
        return
    # Written first: the optimiser would push the joins below the grouping and shuffle every row of a hot digest.
    groups = materialize(grouped(rows), "groups")
    again = groups.join(spark.table(index).hint("merge"), "digest", "left_semi")
    _append(unseen(groups, index).unionByName(again), index, load)
    discard(groups)


def _append(groups: DataFrame, index: str, load: str) -> None:
    groups.select("digest", "keep_id", "n", F.lit(load).alias("load")).write.insertInto(index)
    groups.sparkSession.catalog.refreshTable(index)


def compact(spark: SparkSession, path: str, to: str, buckets: int | None = None) -> str:
    """A copy of an index with a row for each digest and a file for each bucket, ready for more loads."""
    index = open_index(spark, path)
    rows = state(spark, index)
    other = open_index(spark, to, rows.count() if buckets is None else buckets * BUCKET_ROWS)
    _append(rows, other, "compacted")
    return other


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(digest, doc_id, m): how often each document id comes with each text. Every text is read once."""
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest"))
    return rows.groupBy("digest", "doc_id").agg(F.count("*").alias("m"))


def resolve(rows: DataFrame, index: str) -> DataFrame:
    """Every document of ``rows`` with what the index says of its text: doc_id, keep_id, group_size, kept, text_sha256.

    Digests that more than ``SHARE`` of the rows have, 1 / SHARE at most, are looked up in a broadcast table; of the others
    none can fill a task, and they meet the index by sort and merge.
    """
    spark = rows.sparkSession
    total = rows.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    known = state(spark, index)
    hot = grouped(rows).where(F.col("n") > SHARE * total).select("digest")
    hot = materialize(known.join(F.broadcast(hot), "digest", "left_semi"), "hot")
    met = rows.join(F.broadcast(hot), "digest").unionByName(
        rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(known.hint("merge"), "digest")
    )
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(m - 1) div {COPIES}")))
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(COPIES), F.col("m") - F.col("block") * COPIES)))
    met = met.withColumn("block", blocks).withColumn("copy", copies)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("block") == 0) & (F.col("copy") == 1)
    return met.select("doc_id", "keep_id", F.col("n").alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, path: str | None = None, loads: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256.

    Documents come to the index of ``path`` (a new folder if none is given) in ``loads`` loads by hash of their id, so
    that all but the first are anti-joined with what came before. ``keep_id`` is the greatest id with the same text and
    ``group_size`` the number of documents with it, those of an index that was there before included; of equal texts only the row of
    the greatest id is kept.

    Null texts count as empty. Null ids are less than others: a text that only rows without an id have keeps one of them.
    Of rows that repeat id and text one is kept and all are returned. Texts of any length are hashed whole. Further
    columns are ignored, whatever their names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/digest-index-{uuid.uuid4().hex}"
    rows = materialize(digest_rows(docs, id_col, text_col), "digests")
    index = open_index(spark, path, rows.count())
    name = hashlib.md5(rows._scratch.encode()).hexdigest()
    for k in range(loads):
        add_load(rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(loads)) == k), index, f"{name}-{k}")
    return resolve(rows, index)
