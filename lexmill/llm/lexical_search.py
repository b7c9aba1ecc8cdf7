"""The best documents for each query by an integer BM25, found by range maxima over posting lists.

A first pass keeps of each document its length and the frequencies of the terms asked for. Counts of documents and terms
then fix every posting's impact. A second pass takes the documents shard by shard: a shard's postings stand list by list in
document order, with a sparse table of the place of the greatest impact in every stretch of a power of two. A query begins with the
whole shard as one interval. The interval with the highest bound, the sum of its lists' greatest impacts, is split at the document
that has the greatest impact of all its lists; that document is scored whole, and what lies left and right of it
gets bounds of its own. What cannot reach the worst of the best so far, over all shards of a task, is given up.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, pick
from .hashing import slices, small_batches, span_hashes

#: Characters of the queries that one pass over the documents takes along.
BLOCK_CHARS = 2_000_000
#: Postings and documents of a shard.
SHARD_POSTINGS, SHARD_DOCS = 400_000, 1 << 16
#: Intervals of a query that are split at a time.
AT_ONCE = 32

_IS_TERM = np.zeros(256, bool)
_IS_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def terms_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all terms, first term of each text): maximal runs of letters, digits and what is not ASCII, A-Z lower-cased."""
    buffer = _LOWER[np.frombuffer(b" ".join([*texts, b""]) or b" ", np.uint8)]
    edge = np.diff(_IS_TERM[buffer].astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    limits = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return span_hashes(buffer, start, end) if len(start) else np.empty(0, np.uint64), np.searchsorted(start, limits)


class Queries:
    """The terms of a block of queries; ``terms`` are sorted hashes, ``lists`` and ``times`` hold each query's terms."""

    def __init__(self, texts: list[str | None]):
        found, first = terms_of([(t or "").encode() for t in texts])
        self.terms = np.unique(found)
        self.lists, self.times = [], []
        for a, b in zip(first, first[1:]):
            term, times = np.unique(np.searchsorted(self.terms, found[a:b]), return_counts=True)
            self.lists.append(term.astype(np.int64))
            self.times.append(times.astype(np.int64))


def _profile(queries):
    """(doc_id, n, terms, tfs) of the documents that hold a term at all; of terms only those asked for."""

    def run(batches):
        vocabulary = queries.value.terms
        size = np.int64(max(1, len(vocabulary)))
        for batch in small_batches(batches, "text"):
            texts = pc.fill_null(batch.column("text").cast(pa.binary()), b"").to_pylist()
            for a, b in slices([len(t) for t in texts]):
                found, first = terms_of(texts[a:b])
                n = np.diff(first)
                at = np.minimum(np.searchsorted(vocabulary, found), size - 1)
                hit = vocabulary[at] == found if len(vocabulary) else np.zeros(len(found), bool)
                doc = np.repeat(np.arange(b - a), n)
                key, tf = np.unique(doc[hit] * size + at[hit], return_counts=True)
                keep = np.flatnonzero(n > 0)
                cut = np.searchsorted(key, np.concatenate([keep, [b - a]]) * size).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a).take(pa.array(keep)), pa.array(n[keep]),
                        pa.ListArray.from_arrays(pa.array(cut), pa.array((key % size).astype(np.int32))), pa.ListArray.from_arrays(pa.array(cut), pa.array(tf.astype(np.int32))),
                    ],
                    ["doc_id", "n", "terms", "tfs"],
                )

    return run


class Shard:
    """Postings of some documents, list by list in order of documents, with range maxima."""

    def __init__(self, n_docs: int, lists: int, term: np.ndarray, doc: np.ndarray, impact: np.ndarray):
        order = np.lexsort((doc, term))
        self.doc, self.impact, self.docs = doc[order], impact[order], n_docs
        self.key = term[order] * np.int64(n_docs) + self.doc
        self.first = np.searchsorted(term[order], np.arange(lists + 1))
        place = np.arange(len(order), dtype=np.int32)
        self.table = [place]
        longest = int(np.diff(self.first).max(initial=0))
        while 2 << (len(self.table) - 1) <= longest:
            half = 1 << (len(self.table) - 1)
            left, right = self.table[-1][:-half], self.table[-1][half:]
            self.table.append(np.where(self.impact[right] > self.impact[left], right, left))
        # One array for all levels, so that many stretches are looked up at once.
        self.base = np.cumsum([0, *map(len, self.table[:-1])])
        self.table = np.concatenate(self.table)

    def peaks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and value of the first greatest impact in postings a .. b - 1; 0 where there are none."""
        size = b - a
        some = size > 0
        level = np.frexp(np.maximum(size, 1))[1] - 1
        left = self.table[self.base[level] + np.where(some, a, 0)]
        right = self.table[self.base[level] + np.where(some, b - (1 << level.astype(np.int64)), 0)]
        x, y = self.impact[left], self.impact[right]
        return np.where(y > x, right, left), np.where(some, np.maximum(x, y), 0)


class Best:
    """The best ``k`` documents of one query so far, as (score, order of the document)."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def add(self, rows: list[tuple]) -> None:
        """``rows``: (-score, whether the id is null, id)."""
        self.rows = sorted([*self.rows, *rows])[: self.k]

    def worst(self) -> tuple | None:
        return self.rows[-1] if len(self.rows) == self.k else None


def search_shard(shard: Shard, lists: np.ndarray, times: np.ndarray, ids: list[tuple], best: Best) -> int:
    """Best-first search of a shard for one query; ``ids`` order its documents. Gives the number of documents scored."""
    have = shard.first[lists + 1] > shard.first[lists]
    lists, times = lists[have], times[have]
    if not len(lists):
        return 0
    a, b = shard.first[lists][None, :], shard.first[lists + 1][None, :]
    bound, split = _bounds(shard, times, a, b)
    first = shard.doc[a].min(1)
    scored = 0
    while len(bound):
        worst = best.worst()
        if worst is not None:
            # An equal bound helps only where a document with a lesser id may be.
            low = bound < -worst[0]
            for i in np.flatnonzero(bound == -worst[0]).tolist():
                low[i] = ids[first[i]] >= worst[1:]
            if low.any():
                a, b, bound, split, first = a[~low], b[~low], bound[~low], split[~low], first[~low]
                if not len(bound):
                    break
        if len(bound) > AT_ONCE:
            take = np.zeros(len(bound), bool)
            take[np.lexsort((first, -bound))[:AT_ONCE]] = True
        else:
            take = np.ones(len(bound), bool)
        x, y, docs = a[take], b[take], split[take]
        # Where the split document is, or would be, in each list.
        at = np.clip(np.searchsorted(shard.key, lists[None, :] * np.int64(shard.docs) + docs[:, None]), x, y)
        inside = at < y
        held = inside & (shard.doc[np.where(inside, at, 0)] == docs[:, None])
        score = (np.where(held, shard.impact[np.where(inside, at, 0)], 0) * times).sum(1)
        scored += len(docs)
        best.add([(-s, *ids[d]) for s, d in zip(score.tolist(), docs.tolist()) if s > 0])
        x, y = np.concatenate([x, at + held]), np.concatenate([at, y])
        new, place = _bounds(shard, times, x, y)
        alive = new > 0
        x, y, new, place = x[alive], y[alive], new[alive], place[alive]
        head = np.where(y > x, shard.doc[np.minimum(x, len(shard.doc) - 1)], shard.docs).min(1) if len(x) else np.empty(0, np.int64)
        a, b, bound = np.concatenate([a[~take], x]), np.concatenate([b[~take], y]), np.concatenate([bound[~take], new])
        split, first = np.concatenate([split[~take], place]), np.concatenate([first[~take], head])
    return scored


def _bounds(shard: Shard, times: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For intervals as rows of stretches of lists: the sum of greatest impacts, and the document to split at."""
    place, peak = shard.peaks(a, b)
    peak = peak * times
    top = peak.argmax(1)
    return peak.sum(1), shard.doc[place[np.arange(len(a)), top]] if len(a) else np.empty(0, np.int64)


def _best(queries, weights: np.ndarray, n_docs: int, n_terms: int, k: int):
    """The best of a task's documents for each query."""

    def run(batches):
        q = queries.value
        best = [Best(k) for _ in q.lists]

        def search(held):
            ids = [(i is None, i or 0) for b in held for i in b.column("doc_id").to_pylist()]
            order = sorted(range(len(ids)), key=ids.__getitem__)
            rank = np.empty(len(ids), np.int64)
            rank[order] = np.arange(len(ids))
            join = lambda name: np.concatenate([b.column(name).flatten().to_numpy() for b in held]).astype(np.int64)
            size = np.concatenate([pc.list_value_length(b.column("terms")).to_numpy() for b in held])
            n = np.concatenate([b.column("n").to_numpy() for b in held])
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            term, tf = join("terms"), join("tfs")
            impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, size)))
            shard = Shard(len(ids), len(q.terms), term, np.repeat(rank, size), impact)
            ids = [ids[i] for i in order]
            for lists, times, found in zip(q.lists, q.times, best):
                search_shard(shard, lists, times, ids, found)

        held, many, docs = [], 0, 0
        for batch in batches:
            for a, b in slices(pc.list_value_length(batch.column("terms")).to_pylist(), SHARD_POSTINGS // 8):
                part = batch.slice(a, b - a)
                held.append(part)
                many += len(part.column("terms").flatten())
                docs += part.num_rows
                if many >= SHARD_POSTINGS or docs >= SHARD_DOCS:
                    search(held)
                    held, many, docs = [], 0, 0
        if held:
            search(held)
        rows = [(i, None if null else d, -s) for i, found in enumerate(best) for s, null, d in found.rows]
        cols = list(zip(*rows)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query", "doc_id", "score"])

    return run


def query_blocks(queries: DataFrame, id_col: str, text_col: str):
    """Queries in blocks of about ``BLOCK_CHARS`` characters, each collected in its turn: lists of (id, text)."""
    rows = pick(queries, id_col, text_col).toDF("id", "text").select(F.col("id").cast("long").alias("id"), "text").where("length(text) > 0")
    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total // BLOCK_CHARS))
    for k in range(blocks):
        yield [(r["id"], r["text"]) for r in rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).distinct().collect()]


def ranked(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each query with a score above 0, equal ones by id.

    A term weighs floor(1000 ln((2N + 2) / (2df + 1))) by the N documents that hold any term; its impact on a document with
    tf occurrences among n terms is the weight times 10**9 tf div (1000 tf + 8m), m = 25 + 75 n N div L, L being all terms of
    all documents. Terms that a query repeats count as often.

    Null and empty texts hold nothing and do not count in N; queries without a term, or whose terms occur nowhere, have no
    rows. A null document id ranks behind all others of its score. Repeated documents each have a place; a query given
    twice with one id and text counts once, with a null id it has rows with a null id. Texts are read whole; further
    columns are ignored, whatever their names; empty tables give an empty result.
    """
    spark = docs.sparkSession
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for number, block in enumerate(query_blocks(queries, query_id, query_text)):
        asked = spark.sparkContext.broadcast(Queries([t for _, t in block]))
        profile = materialize(rows.mapInArrow(_profile(asked), "doc_id long, n long, terms array<int>, tfs array<int>"), "profile")
        size = profile.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        # A row for each term of the block's queries at most.
        held = {r["term"]: r["df"] for r in profile.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}
        weights = np.array([math.floor(1000 * math.log((2 * size["docs"] + 2) / (2 * held.get(i, 0) + 1))) for i in range(len(asked.value.terms))], np.int64)
        some = profile.where(F.size("terms") > 0)
        best = some.mapInArrow(_best(asked, weights, size["docs"], max(1, size["terms"]), k), "query long, doc_id long, score long")
        names = spark.createDataFrame([(i, d) for i, (d, _) in enumerate(block)], "query long, item_id long")
        best = best.join(F.broadcast(names), "query").withColumn("block", F.lit(number))
        out = best if out is None else out.unionByName(best)
    # An id may be null or stand for two texts, so ranks go by the query's number in its block.
    order = Window.partitionBy("item_id", "block", "query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
