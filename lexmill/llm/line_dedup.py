"""Line deduplication with a bound on edits, by a deletion-neighbourhood join.

A line is its sequence of words (runs of other than white space, lower case). Two lines are near when
one word replaced, added or left out makes one the other and both have ``MIN_WORDS`` words or more;
shorter lines are near only when equal. Each line emits the hashes of what is left when any one word
is deleted; lines that differ by a replaced word share a variant and its place, and a line that lacks a
word of another equals one of that line's variants. So the earliest partner of every line is a
minimum by group: no pairs are made, however large a group of copies is. The partner found is verified by
edit distance.

Only lines that can have a partner emit variants: of two near lines, the first or the last half
of the shorter one's words agrees, so a line whose halves no other line has is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, pick
from .hashing import mix, slices, small_batches, span_hashes

MIN_WORDS = 5


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _lines_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, line, first, word hashes): of line k that has a word, its text and number there, and the place of its first word."""
    raw = [(t or "").lower().encode("utf-8", "surrogatepass") + b"\n" for t in texts]
    buffer = np.frombuffer(b"".join(raw) or b"\n", np.uint8)
    word = ~_BLANK[buffer]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if word[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[::2], edge[1::2]
    feeds = np.flatnonzero(buffer == 10)
    line = np.searchsorted(feeds, starts)
    first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.empty(0, np.int64)
    line = line[first]
    begin = np.cumsum([0] + [len(r) for r in raw])
    text = np.searchsorted(begin, starts[first], "right") - 1
    h = span_hashes(buffer, starts, ends) if len(starts) else np.empty(0, np.uint64)
    return text, line - np.searchsorted(feeds, begin[text]), np.append(first, len(starts)), h


_PLACE = [mix(np.arange(1, 4097, dtype=np.uint64))]


def _places(n: int) -> np.ndarray:
    if n > len(_PLACE[0]):
        _PLACE[0] = mix(np.arange(1, 2 * n + 1, dtype=np.uint64))
    return _PLACE[0][:n]


def _variants(h: np.ndarray) -> np.ndarray:
    """Hashes of the sequence without each of its words, by place."""
    n = len(h)
    here, next_ = mix(h[:-1] ^ _places(n - 1)), mix(h[1:] ^ _places(n - 1))
    before = np.concatenate([[np.uint64(0)], np.cumsum(here, dtype=np.uint64)])
    after = np.concatenate([[np.uint64(0)], np.cumsum(next_[::-1], dtype=np.uint64)])[::-1]
    return (before + after).view(np.int64)


def _sums(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)])
    return (total[b] - total[a]).view(np.int64)


def _line_hashes(first: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each line, halves, line of each half) at once.

    Halves are the hashes of the first and last words of a line, half as many as it or a line one word
    shorter has; last words are told from first ones by the complement.
    """
    a, b = first[:-1], first[1:]
    n = b - a
    at = np.arange(len(h)) - np.repeat(a, n)
    width = np.repeat(n, n)
    places = _places(int(n.max(initial=0)) + 1)
    lead = mix(h ^ places[at])
    halves, owner = [], []
    long = np.flatnonzero(n >= MIN_WORDS)
    for less in (0, 1):
        use = long if not less else long[n[long] % 2 == 0]
        half = (n - less) // 2
        tail = at - (width - np.repeat(half, n))
        last = mix(h ^ places[np.maximum(tail, 0)])
        last[tail < 0] = 0
        halves += [_sums(lead, a[use], a[use] + half[use]), ~_sums(last, a[use], b[use])]
        owner += [use, use]
    return _sums(lead, a, b), np.concatenate(halves), np.concatenate(owner)


def _lines(batches):
    """A row (doc, row hash, line number, line hash, halves) for each line with a word."""
    for batch in small_batches(batches, "text"):
        texts = batch.column("text").to_pylist()
        for a, b in slices([len(t) if t else 0 for t in texts]):
            text, line, first, h = _lines_of(texts[a:b])
            whole, halves, owner = _line_hashes(first, h)
            order = np.argsort(owner, kind="stable")
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner[order], np.arange(len(whole) + 1)).astype(np.int32)), pa.array(halves[order]))
            take = pa.array(text + a)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("row").take(take), pa.array(line.astype(np.int32)), pa.array(whole), lists], ["id", "row", "line", "h", "halves"])


def _deletions(batches):
    """Variants of the lines asked for: (variant, place or -1, line hash); the words go with the line itself."""
    for batch in small_batches(batches, "text"):
        texts, wanted = batch.column("text").to_pylist(), batch.column("lines").to_pylist()
        for a, b in slices([len(t) if t else 0 for t in texts], 200_000):
            out = ([], [], [], [])
            lines = [{x["line"]: x["h"] for x in w} for w in wanted[a:b]]
            text, line, first, words = _lines_of(texts[a:b])
            for t, k, i, j in zip(text.tolist(), line.tolist(), first[:-1].tolist(), first[1:].tolist()):
                if k not in lines[t]:
                    continue
                h = words[i:j]
                v = _variants(h).tolist()
                out[0].extend([*v, lines[t][k]])
                out[1].extend([*range(len(v)), -1])
                out[2].extend([lines[t][k]] * (len(v) + 1))
                out[3].extend([*[None] * len(v), h.tobytes()])
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.binary()))], ["variant", "place", "h", "words"])


def within_one(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether one edit of a word, or none, makes x into y."""
    if abs(len(x) - len(y)) > 1:
        return False
    n = min(len(x), len(y))
    same = x[:n] == y[:n]
    lead = n if same.all() else int(same.argmin())
    same = x[len(x) - n :][::-1] == y[len(y) - n :][::-1]
    tail = n if same.all() else int(same.argmin())
    return lead + tail >= max(len(x), len(y)) - 1


def _confirm(batches):
    for batch in batches:
        keep = [within_one(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch.column("words").to_pylist(), batch.column("other_words").to_pylist())]
        yield batch.select(["h"]).filter(pa.array(keep, pa.bool_()))


def _without(batches):
    for batch in small_batches(batches, "text"):
        texts, gone, count = [], batch.column("gone").to_pylist(), []
        for text, drop in zip(batch.column("text").to_pylist(), gone):
            drop = set(drop or ())
            lines = text.split("\n") if text is not None else []
            texts.append(None if text is None else text if not drop else "\n".join(x for k, x in enumerate(lines) if k not in drop))
            count.append((len(lines), len(drop)))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string()), pa.array([a for a, _ in count], pa.int64()), pa.array([b for _, b in count], pa.int64())], ["doc_id", "text", "n_lines", "n_dropped"])


def deduplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (doc_id, text, n_lines, n_dropped).

    Lines are what stands between line feeds. In the order of document id and line number, a line is dropped if
    an equal or near line comes before it, whether or not that one is dropped itself; blank lines
    stay. Null texts stay null with no lines; an empty text has one blank line. Rows with a null id come before
    all others. Repeated rows (same id and text) are one document and give equal results. Further
    columns are ignored; an empty table gives an empty result.
    """
    given = pick(docs, id_col, text_col).toDF("id", "text").select(F.col("id").cast("long").alias("id"), "text", F.xxhash64("text").alias("row"))
    lines = materialize(given.mapInArrow(_lines, "id long, row long, line int, h long, halves array<long>"), "lines")
    place = F.struct(F.coalesce("id", F.lit(-(1 << 63))).alias("id"), F.col("row").alias("row"), F.col("line").alias("line"))
    first = materialize(lines.groupBy("h").agg(F.min(place).alias("first")), "first")

    halves = lines.select("h", F.explode("halves").alias("half"))
    shared = materialize(halves.groupBy("half").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("half"), "halves")
    able = materialize(halves.join(shared, "half").select("h").distinct(), "able")
    asked = first.join(able, "h").select("first.*", "h").groupBy("id", "row").agg(F.collect_list(F.struct("line", "h")).alias("lines"))
    asked = materialize(asked.toDF("doc", "text_hash", "lines"), "asked")
    met = given.join(asked.hint("merge"), (F.coalesce("id", F.lit(-(1 << 63))) == F.col("doc")) & (F.col("row") == F.col("text_hash")))
    variants = materialize(met.select("text", "lines").mapInArrow(_deletions, "variant long, place int, h long, words binary"), "variants")
    order = materialize(first.select("h", "first").join(able, "h").withColumnRenamed("first", "rank"), "order")
    ranked = variants.drop("words").join(order, "h")
    ranked = materialize(ranked.select("variant", "place", F.struct("rank", "h").alias("who")).distinct(), "ranked")
    # Earliest with this variant and place; earliest with it by deleting a word; the line that it is.
    deleted = ranked.where("place >= 0")
    by_place = materialize(deleted.groupBy("variant", "place").agg(F.min("who").alias("best"), F.count("*").alias("c")).where("c > 1").drop("c"), "best")
    whole = ranked.where("place < 0").select("variant", F.col("who").alias("entire"))
    by_variant = materialize(deleted.groupBy("variant").agg(F.min("who").alias("best")).join(whole, "variant"), "best")
    near = deleted.join(by_place, ["variant", "place"]).select("who", "best")
    near = near.unionByName(deleted.select("variant", "who").join(by_variant, "variant").select("who", F.col("entire").alias("best")))
    near = near.unionByName(by_variant.select(F.col("entire").alias("who"), "best"))
    near = near.where("best.rank < who.rank").groupBy("who.h").agg(F.min("best").alias("best"))
    words = materialize(variants.where("place < 0").select("h", "words").groupBy("h").agg(F.first("words").alias("words")), "words")
    near = near.select("h", F.col("best.h").alias("other")).join(words, "h").join(words.toDF("other", "other_words"), "other")
    near = near.select("h", "words", "other_words").mapInArrow(_confirm, "h long").withColumn("near", F.lit(True))

    verdict = materialize(first.select("h", "first").join(near, "h", "left").select("h", "first", F.coalesce("near", F.lit(False)).alias("near")), "verdict")
    gone = lines.drop("halves").withColumn("here", place).join(verdict, "h").where(F.col("near") | (F.col("here") != F.col("first")))
    gone = gone.select("here.id", "row", "line").groupBy("id", "row").agg(F.collect_set("line").alias("gone"))
    gone = materialize(gone.toDF("doc", "text_hash", "gone"), "gone")
    discard(lines, first, shared, able, asked, variants, order, ranked, by_place, by_variant, words, verdict)
    out = given.join(gone.hint("merge"), (F.coalesce("id", F.lit(-(1 << 63))) == F.col("doc")) & (F.col("row") == F.col("text_hash")), "left")
    return out.select("id", "text", "gone").mapInArrow(_without, "doc_id long, text string, n_lines long, n_dropped long")
