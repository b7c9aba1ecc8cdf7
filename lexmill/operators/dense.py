"""Vectors: normal form, pooling, top-k by dot product."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params
from .ranking import best

#: Query vectors that one pass over the corpus takes with it.
QUERY_BLOCK = 4096


def l2_normalised(v):
    """A vector over its length; the zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.when(norm == 0, F.lit(1.0)).otherwise(norm))


def mean_pool(rows: DataFrame, dim: int) -> DataFrame:
    """(id, vector): the mean of the token vectors ``rows(id, vector)``; null where a length is not ``dim``."""
    # One partial sum for each place and id leaves a task, however many token vectors it has.
    means = [F.avg(F.get("vector", F.lit(i)).cast("double")).alias(f"x{i}") for i in range(dim)]
    pooled = rows.groupBy("id").agg(F.min(F.size("vector")).alias("lo"), F.max(F.size("vector")).alias("hi"), *means)
    ok = (F.col("lo") == dim) & (F.col("hi") == dim)
    return pooled.select("id", F.when(ok, F.array(*[f"x{i}" for i in range(dim)])).alias("vector"))


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int = params.POOL) -> DataFrame:
    """(query_id, chunk_id, score, rank) of ``queries(query_id, vector)`` against ``corpus(chunk_id, vector)``.

    The stated queries go to the tasks in blocks of up to QUERY_BLOCK; each batch of the corpus is one matrix
    product, of which every task keeps its best ``k`` for each query before anything is shuffled. Ties by chunk id.
    """
    spark, out = queries.sparkSession, None
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()
        if not rows:
            continue
        ids = np.array([r["query_id"] for r in rows], np.int64)
        q = spark.sparkContext.broadcast((ids, np.array([r["vector"] for r in rows], np.float64)))

        def run(batches, q=q):
            ids, m = q.value
            held: tuple | None = None
            for batch in batches:
                chunk = batch.column("chunk_id").to_numpy()
                x = np.array(batch.column("vector").to_pylist(), np.float64).reshape(len(chunk), -1)
                score = np.einsum("qd,cd->qc", m, x)
                where = np.broadcast_to(chunk, score.shape)
                if held is not None:
                    score, where = np.concatenate([held[0], score], 1), np.concatenate([held[1], where], 1)
                order = np.lexsort((where, -score), axis=1)[:, :k]
                held = (np.take_along_axis(score, order, 1), np.take_along_axis(where, order, 1))
            if held is not None:
                n = held[0].shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(held[1].ravel()), pa.array(held[0].ravel())], ["query_id", "chunk_id", "score"])

        found = corpus.select(F.col("chunk_id").cast("long"), "vector").where("vector is not null").mapInArrow(run, "query_id long, chunk_id long, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, chunk_id long, score double, rank int")
    return best(out, k, F.desc("score"), "chunk_id")


def usable_dim(vectors: DataFrame, n: int) -> int:
    """The length of chunk vectors if there are ``n`` of them and all have it, else 0: an index without vectors for all has none."""
    row = vectors.agg(F.count("vector").alias("n"), F.min(F.size("vector")).alias("lo"), F.max(F.size("vector")).alias("hi")).first()
    return row["hi"] if n and row["n"] == n and row["lo"] == row["hi"] and row["hi"] > 0 else 0


def attach_vectors(chunks: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """Chunks with ``vector`` and ``mode``: hybrid if there are as many vectors of the right length as chunks, else bm25 and none."""
    n = chunks.agg(F.count("*").alias("chunks"))
    m = vectors.agg(F.count("*").alias("vectors"), F.count_if(F.size("vector") == dim).alias("right"))
    mode = n.crossJoin(m).select(F.when((F.col("chunks") == F.col("vectors")) & (F.col("vectors") == F.col("right")), "hybrid").otherwise("bm25").alias("mode"))
    rows = chunks.join(vectors.select(F.col("chunk_id").alias("id"), "vector"), "id", "left").crossJoin(F.broadcast(mode))
    return rows.withColumn("vector", F.when(F.col("mode") == "hybrid", F.col("vector")))
