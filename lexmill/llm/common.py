"""Helpers shared by the training-data operators: column picking, materialising, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns of ``df`` and nothing else.

    Columns are taken by exact name and position, so further columns whose names clash
    (also those that differ only in case) never make a reference ambiguous.
    """
    cols = df.columns
    missing = [n for n in names if n not in cols]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {cols}")
    flat = df.toDF(*[f"_c{i}" for i in range(len(cols))])
    return flat.select(*[F.col(f"_c{cols.index(n)}").alias(n) for n in names])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only in local mode, as in tests, a folder of our own is made and set where that is unset; elsewhere it must be set.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="lexmill-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def write_once(df: DataFrame, path: str) -> None:
    """Write ``df`` as Parquet and give up its shuffle files as soon as the write has ended."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(key, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    write_once(df, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote, where nothing will be computed from it any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bucket_of(col: Column, mod: int) -> Column:
    """crc32 of a column as text, modulo ``mod`` (null for null)."""
    return F.crc32(col.cast("string").cast("binary")) % F.lit(mod)


def unit_hash(*cols: Column, seed: int = 0) -> Column:
    """A pseudorandom number in [0, 1) that depends on the columns' values only."""
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def least_neighbours(edges: DataFrame) -> DataFrame:
    """(id, component) of the vertices of ``edges(u, v)``: the least neighbour of the least neighbour, themselves included.

    Vertices of one component only share a value; stars have one value. Partial minima are built before the
    shuffle, so a hub costs each task one row.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    least = materialize(least, "cc")
    jumped = least.join(least.toDF("m", "component"), "m").select(F.col("u").alias("id"), "component")
    jumped = materialize(jumped, "cc")
    discard(least)
    return jumped


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of ``edges(a, b)`` of longs as ``(id, component)``, component = least id.

    By contraction: in each round every vertex goes over to the least neighbour of its least neighbour, and edges
    are kept between what is left. Every step is a minimum with map-side combine or a join with unique keys on one
    side, whose other side may be split when skewed; each round is written to the shared folder. Vertices without an
    edge are not returned; self loops and repeated edges are ignored; an empty table gives an empty result.
    """
    e = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "cc")
    rounds: list[DataFrame] = []
    while not e.isEmpty():
        if len(rounds) == max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        labels = least_neighbours(e)
        rounds.append(labels)
        left = e.join(labels.toDF("u", "x"), "u").join(labels.toDF("v", "y"), "v").where("x <> y")
        after = materialize(left.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "cc")
        discard(e)
        e = after
    if not rounds:
        return e.toDF("id", "component")
    # Names of the first round's vertices, by way of what each later round, which has far fewer, made of them.
    whole = rounds.pop()
    while rounds:
        later = whole.toDF("component", "_end")
        whole = rounds.pop().join(later, "component", "left").select("id", F.coalesce("_end", "component").alias("component"))
        whole = materialize(whole, "cc")
    return whole
