"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Features are single words and word pairs, once as they are written and once by shape (letters to
x or X, digits to 9, runs shortened, other signs as they are), pairs of equal words, and the
text's length by powers of two; all are hashed to ``2 ** BITS`` slots and each kind is weighted to unit
length. A score is the logistic function of a sparse dot product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, pick, unit_hash
from .hashing import mix, slices, small_batches, span_hashes, word_spans

BITS = 18
_SHAPE = np.full(256, ord("x"), np.uint8)
_SHAPE[:128] = np.arange(128)
_SHAPE[ord("A") : ord("Z") + 1] = ord("X")
_SHAPE[ord("a") : ord("z") + 1] = ord("x")
_SHAPE[ord("0") : ord("9") + 1] = ord("9")
_RUNS = np.isin(_SHAPE, np.frombuffer(b"xX9", np.uint8))


def _words(joined: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts and the number of words of each."""
    buffer, starts, ends, first = word_spans(joined)
    return span_hashes(buffer, starts, ends) if len(starts) else np.empty(0, np.uint64), np.diff(first)


def _shape(text: bytes) -> bytes:
    given = np.frombuffer(text, np.uint8)
    b = _SHAPE[given]
    keep = np.ones(len(b), bool)
    keep[1:] = (b[1:] != b[:-1]) | ~_RUNS[given[1:]]
    return b[keep].tobytes()


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots, values, first): the features of text i are those from first[i] to first[i + 1]; slots of a text differ."""
    joined = [b" ".join(t.encode("utf-8", "surrogatepass").split()) if t else b"" for t in texts]
    plain, n = _words(joined)
    shape, m = _words([_shape(x) for x in joined])
    doc, docs = np.repeat(np.arange(len(texts)), n), np.repeat(np.arange(len(texts)), m)
    kinds = [(plain, doc), (shape, docs)]
    for h, d in ((plain, doc), (shape, docs)):
        same = d[1:] == d[:-1]
        kinds.append((mix(h[1:] * np.uint64(3) + h[:-1])[same], d[1:][same]))
    twin = (doc[1:] == doc[:-1]) & (plain[1:] == plain[:-1])
    kinds.append((np.full(int(twin.sum()), 1, np.uint64), doc[1:][twin]))
    length = np.floor(np.log2(n + 1)).astype(np.uint64)
    kinds.append((length, np.arange(len(texts))))
    slots, values, owner = [], [], []
    for k, (h, d) in enumerate(kinds):
        key = (d.astype(np.uint64) << np.uint64(BITS)) | (mix(h + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(64 - BITS))
        key, count = np.unique(key, return_counts=True)
        d = (key >> np.uint64(BITS)).astype(np.int64)
        value = np.sqrt(count.astype(np.float64))
        norm = np.sqrt(np.bincount(d, count, len(texts)))
        slots.append((key & np.uint64((1 << BITS) - 1)).astype(np.int64))
        values.append(value * (np.sqrt(count / np.maximum(n[d], 1)) if k == 4 else 1 / norm[d]))
        owner.append(d)
    slots, values, owner = map(np.concatenate, (slots, values, owner))
    # two kinds may meet in one slot
    key, inverse = np.unique(owner << BITS | slots, return_inverse=True)
    return key & ((1 << BITS) - 1), np.bincount(inverse, values, len(key)), np.searchsorted(key, np.arange(len(texts) + 1) << BITS)


def ftrl(rows, weights: np.ndarray, epochs: int, alpha: float = 0.15, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5) -> np.ndarray:
    """Weights after per-coordinate FTRL-proximal updates over ``rows`` of (slots, values, label); the last slot is the bias."""
    z, s = -weights * (beta / alpha + l2), np.zeros_like(weights)
    z -= np.sign(weights) * l1
    for _ in range(epochs):
        for slots, values, label in rows:
            zi, si = z[slots], s[slots]
            w = np.where(np.abs(zi) <= l1, 0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(si)) / alpha + l2))
            g = (1 / (1 + np.exp(-np.clip(w @ values, -35, 35))) - label) * values
            more = si + g * g
            z[slots] = zi + g - (np.sqrt(more) - np.sqrt(si)) / alpha * w
            s[slots] = more
    return np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(s)) / alpha + l2))


def train(docs: DataFrame, labels: DataFrame, max_train_docs: int = 12000, shards: int = 4, epochs: int = 4) -> np.ndarray:
    """Weights learned from ``docs(id, text)`` and ``labels(id, label)``.

    About ``max_train_docs`` labelled documents at most are used, chosen by a hash of their id. They are
    dealt to ``shards`` tasks, each of which trains on its own; the mean of the weights is the
    model. Ids with contradicting labels are left out. Without labels all weights are zero.
    """
    sure = labels.where("id is not null and label is not null").groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most")
    n = sure.count()
    zero = np.zeros((1 << BITS) + 1)
    if not n:
        return zero
    chosen = sure.where(unit_hash(F.col("id")) < F.lit(min(1.0, max_train_docs / n))).select("id", "label")
    some = docs.join(F.broadcast(chosen), "id").select("id", "text", "label")

    def fit(key, table):
        table = table.sort_by([("id", "ascending"), ("text", "ascending")])
        rng = np.random.default_rng(0)
        rows, texts, label = [], table["text"].to_pylist(), table["label"].to_pylist()
        for a, b in slices([len(t) if t else 0 for t in texts]):
            slots, values, first = features(texts[a:b])
            rows += [(np.append(slots[i:j], 1 << BITS), np.append(values[i:j], 1.0).astype(np.float32), y) for i, j, y in zip(first[:-1], first[1:], label[a:b])]
        rows = [rows[i] for i in rng.permutation(len(rows))]
        return pa.table({"weights": [ftrl(rows, zero.copy(), epochs).astype(np.float32).tobytes()]})

    dealt = some.withColumn("shard", F.pmod(F.xxhash64("id", F.lit("shard")), F.lit(shards)))
    found = dealt.groupBy("shard").applyInArrow(fit, "weights binary").collect()
    return np.mean([np.frombuffer(r["weights"], np.float32) for r in found], axis=0) if found else zero


def _score(weights, threshold: float):
    def run(batches):
        w = weights.value
        for batch in small_batches(batches, "text"):
            texts = batch.column("text").to_pylist()
            for a, b in slices([len(t) if t else 0 for t in texts]):
                slots, values, first = features(texts[a:b])
                total = np.bincount(np.repeat(np.arange(b - a), np.diff(first)), w[slots] * values, b - a)
                score = 1 / (1 + np.exp(-np.clip(total + w[-1], -35, 35)))
                keep = batch.slice(a, b - a).select(["doc_id", "held_out"])
                yield pa.RecordBatch.from_arrays(keep.columns + [pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, learn_mod: int = 5, hold_out: int = 0, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per input row: (doc_id, held_out, score, predicted).

    Learned from labelled rows whose crc32 of the id is not ``hold_out`` modulo ``learn_mod``; only the text
    enters a score. Null and empty texts are scored by their length alone; rows with a null id are scored
    and count as not held out; equal texts have equal scores; repeated rows are returned as often
    as given. Further columns are ignored; an empty table gives an empty result.
    """
    given = pick(docs, id_col, text_col).toDF("id", "text").select(F.col("id").cast("long"), "text")
    held = F.coalesce(bucket_of(F.col("id"), learn_mod) == hold_out, F.lit(False))
    known = pick(labels, id_col, label_col).toDF("id", "label").select(F.col("id").cast("long"), F.col("label").cast("double"))
    weights = given.sparkSession.sparkContext.broadcast(train(given, known.where(~held)).astype(np.float64))
    rows = given.select(F.col("id").alias("doc_id"), "text", held.alias("held_out"))
    return rows.mapInArrow(_score(weights, threshold), "doc_id long, held_out boolean, score double, predicted int")
