"""BM25 index and search as joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import params
from ..functions.text import tokens
from .ranking import best

#: Query-term rows up to which they are broadcast.
SMALL = 200_000


def postings_counted(chunks: DataFrame, text="text", compat: bool = False) -> DataFrame:
    """(term, chunk_id, tf, len) of ``chunks(id, text)``, by a group on chunk and term with partial counts before the shuffle."""
    rows = chunks.select(F.col("id").alias("chunk_id"), tokens(F.col(text), compat).alias("toks"))
    rows = rows.select("chunk_id", F.size("toks").alias("len"), F.explode("toks").alias("term"))
    return rows.groupBy("term", "chunk_id", "len").agg(F.count("*").cast("int").alias("tf")).select("term", "chunk_id", "tf", "len")


def index(chunks: DataFrame, text="text", compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """(postings, statistics) of ``postings_counted`` and ``corpus_stats``; every text is tokenised once, and both are stored."""
    from ..plans.stages import stage

    rows = stage(chunks.select(F.col("id").alias("chunk_id"), tokens(F.col(text), compat).alias("toks")))
    stats = rows.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.size("toks")), F.lit(0.0)).alias("avgdl"))
    terms = rows.select("chunk_id", F.size("toks").alias("len"), F.explode("toks").alias("term"))
    post = terms.groupBy("term", "chunk_id", "len").agg(F.count("*").cast("int").alias("tf")).select("term", "chunk_id", "tf", "len")
    return stage(post), stage(stats)


def corpus_stats(chunks: DataFrame, text="text", compat: bool = False) -> DataFrame:
    """One row (n, avgdl); chunks without tokens count."""
    return chunks.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.size(tokens(F.col(text), compat))), F.lit(0.0)).alias("avgdl"))


def document_frequency(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count("*").alias("df"))


def of_terms(post: DataFrame) -> DataFrame:
    """(term, df, max_tf, min_len): what bounds a term's weight in any chunk."""
    return post.groupBy("term").agg(F.count("*").alias("df"), F.max("tf").alias("max_tf"), F.min("len").alias("min_len"))


def idf(n, df):
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def query_terms(queries: DataFrame, text="question", compat: bool = False) -> DataFrame:
    """(query_id, term, tpos): distinct terms, with the place of their first occurrence."""
    toks = F.array_distinct(tokens(F.col(text), compat))
    return queries.select("query_id", F.posexplode(toks).alias("tpos", "term"))


def weighted_terms(terms: DataFrame, df: DataFrame, stats: DataFrame) -> DataFrame:
    """Query terms with idf; terms that the corpus lacks have document frequency 0."""
    return terms.join(df, "term", "left").crossJoin(F.broadcast(stats)).withColumn("idf", idf(F.col("n"), F.coalesce("df", F.lit(0))))


def search(queries: DataFrame, post: DataFrame, stats: DataFrame, k: int = params.POOL, k1: float = params.K1, b: float = params.B, text="question") -> DataFrame:
    """(query_id, chunk_id, score, rank): the best ``k`` chunks by BM25, rank from 0, ties by chunk id.

    ``stats`` is one row. Queries are broadcast only below a counted size; beyond it the join is by shuffle.
    """
    from ..plans.sizes import small

    asked = query_terms(queries, text)
    # Document frequencies are counted for the query's terms only.
    wanted = small(asked.select("term").distinct(), SMALL)
    terms = weighted_terms(asked, document_frequency(post.join(wanted, "term", "left_semi")), stats)
    return scored(terms, post, k, k1, b)


def weight(tf, length, k1: float = params.K1, b: float = params.B):
    """A term's weight in a chunk but for its idf; greater for more occurrences and for shorter chunks."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.col("avgdl")))


def summed(ws):
    """The sum of (tpos, w) in the order of the query's terms, so that scores do not depend on partitioning."""
    return F.aggregate(F.array_sort(ws), F.lit(0.0), lambda acc, x: acc + x["w"])


def scored(terms: DataFrame, post: DataFrame, k: int = params.POOL, k1: float = params.K1, b: float = params.B) -> DataFrame:
    """``search`` for weighted terms ``(query_id, term, tpos, idf, avgdl)``: every posting of theirs is scored."""
    from ..plans.sizes import small

    terms = small(terms.select("query_id", "term", "tpos", "idf", "avgdl"), SMALL)
    part = F.col("idf") * weight(F.col("tf"), F.col("len"), k1, b)
    hits = post.join(terms, "term").groupBy("query_id", "chunk_id").agg(F.collect_list(F.struct("tpos", part.alias("w"))).alias("ws"))
    hits = hits.select("query_id", "chunk_id", summed(F.col("ws")).alias("score")).where("score > 0")
    return best(hits, k, F.desc("score"), "chunk_id")


def bounded(terms: DataFrame, postings: Callable[[DataFrame], DataFrame], k: int = params.POOL, k1: float = params.K1, b: float = params.B, counts: dict | None = None) -> DataFrame:
    """The rows of ``scored`` with most postings of common terms left out, by the bounds of MaxScore.

    ``terms``: (query_id, term, tpos, idf, avgdl, df, max_tf, min_len); ``postings(terms)`` gives those of ``terms(term)``. A query's
    terms are ranked by the greatest weight they can have. Its first terms, scored alone, give a floor for the score of rank
    ``k``. Terms that even together with all lesser ones stay below the floor cannot bring a chunk in: they are looked up only for the chunks
    that the others found and whose bound still reaches the floor, by a join on term and chunk, which a common
    term's postings do not skew. ``counts``, if given, gets the numbers of postings scored and of all.
    """
    from ..plans.sizes import small
    from ..plans.stages import stage

    most = F.col("idf") * weight(F.col("max_tf"), F.col("min_len"), k1, b)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("most"), "tpos")
    terms = terms.where("df > 0").select("query_id", "term", "tpos", "idf", "avgdl", "df", most.alias("most"))
    terms = terms.withColumns({"before": F.coalesce(F.sum("df").over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "from_here": F.sum("most").over(ranked.rowsBetween(0, Window.unboundedFollowing))})
    terms = stage(terms)
    part = F.col("idf") * weight(F.col("tf"), F.col("len"), k1, b)

    def hits(some: DataFrame) -> DataFrame:
        return postings(some.select("term").distinct()).join(small(some.select("query_id", "term", "tpos", "idf", "avgdl"), SMALL), "term").select("query_id", "chunk_id", "tpos", part.alias("w"))

    # Sums in another order differ in the last places, which the margin covers.
    first = hits(terms.where(F.col("before") < 4 * k)).groupBy("query_id", "chunk_id").agg(F.sum("w").alias("s"))
    floor = best(first, k, F.desc("s"), "chunk_id").where(F.col("rank") == k - 1).select("query_id", (F.col("s") * (1 - 1e-9)).alias("floor"))
    terms = stage(terms.join(stage(floor), "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0))).withColumn("leading", F.col("from_here") >= F.col("floor")))
    leading, lesser = terms.where("leading"), terms.where("not leading")
    rest = small(terms.groupBy("query_id").agg(F.max("floor").alias("floor"), F.coalesce(F.sum(F.when(~F.col("leading"), F.col("most"))), F.lit(0.0)).alias("rest")), SMALL)
    found = hits(leading).groupBy("query_id", "chunk_id").agg(F.collect_list(F.struct("tpos", "w")).alias("ws"), F.sum("w").alias("s"))
    found = stage(found.join(rest, "query_id").where((F.col("s") + F.col("rest")) * (1 + 1e-9) >= F.col("floor")).select("query_id", "chunk_id", "ws"))
    asked = found.select("query_id", "chunk_id").join(small(lesser.select("query_id", "term", "tpos", "idf", "avgdl"), SMALL), "query_id")
    more = postings(lesser.select("term").distinct()).join(asked, ["term", "chunk_id"]).groupBy("query_id", "chunk_id").agg(F.collect_list(F.struct("tpos", part.alias("w"))).alias("more"))
    more = stage(more)
    if counts is not None:
        size = lambda df, c: df.agg(F.coalesce(F.sum(F.size(c)), F.lit(0))).first()[0]
        counts |= {"scored": hits(leading).count() + size(more, "more"), "all": terms.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]}
    whole = found.join(more, ["query_id", "chunk_id"], "left").select("query_id", "chunk_id", summed(F.concat("ws", F.coalesce("more", F.array().cast("array<struct<tpos:int,w:double>>")))).alias("score"))
    return best(whole.where("score > 0"), k, F.desc("score"), "chunk_id")


def ideal_score(queries: DataFrame, post: DataFrame, stats: DataFrame, k1: float = params.K1, text="question") -> DataFrame:
    """(query_id, ideal): half the greatest score that a query's distinct terms allow; 0 without tokens."""
    from ..plans.sizes import small

    asked = query_terms(queries, text)
    wanted = small(asked.select("term").distinct(), SMALL)
    terms = weighted_terms(asked, document_frequency(post.join(wanted, "term", "left_semi")), stats)
    return ideal(queries, terms, k1)


def ideal(queries: DataFrame, terms: DataFrame, k1: float = params.K1) -> DataFrame:
    """``ideal_score`` for weighted terms ``(query_id, tpos, idf)``."""
    parts = terms.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("tpos", (F.col("idf") * (k1 + 1) * 0.5).alias("w")))).alias("ws"))
    parts = parts.select("query_id", F.aggregate("ws", F.lit(0.0), lambda acc, x: acc + x["w"]).alias("ideal"))
    return queries.select("query_id").join(parts, "query_id", "left").select("query_id", F.coalesce("ideal", F.lit(0.0)).alias("ideal"))
