"""Mixing sources to target weights by fixed-length blocks.

The words of a source, its documents in a fixed order, are packed into blocks of ``block`` words. The
mix is a row of slots, ``shard_slots`` to an output shard. For every shard the number of slots of each
source is drawn from a multinomial with the target shares; draws beyond a source's share of all
slots pass, in order of the shards, to the sources that were drawn too seldom, so that totals are met
exactly. The j-th slot of a source takes block ``permutation(j mod n)`` of its n blocks, under a keyed
pseudorandom permutation for each pass over the source; slots and blocks then meet in a join by
index. Every draw and permutation is a function of the seed, so reruns agree.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import materialize, pick
from .hashing import mix, small_batches

#: Documents of a part of a source, about; each part is ordered and summed on its own.
PART_DOCS = 1000
#: Sources up to which their table (five numbers and the name a row) is broadcast.
FEW_SOURCES = 10_000
#: Shards that one row of the slot plan stands for when running totals are built.
SPAN = 256
WEIGHTS = (5.0, 2.0, 1.0)
REPEATS = 3
BLANK = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[float], weights: list[float], repeats: float = REPEATS) -> list[float]:
    """Shares of the sum of sizes by weight; what exceeds ``repeats`` times a size goes to the others by weight."""
    total, out = float(sum(sizes)), [0.0] * len(sizes)
    open_, left = {i for i, s in enumerate(sizes) if s > 0}, total
    while open_:
        share = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if share * weights[i] > repeats * sizes[i]}
        for i in full or open_:
            out[i] = repeats * sizes[i] if full else share * weights[i]
        left -= sum(out[i] for i in full)
        if not full:
            break
        open_ -= full
    return out


def permuted(i: np.ndarray, n: np.ndarray, key: np.ndarray, back: bool = False) -> np.ndarray:
    """A keyed pseudorandom permutation of 0..n-1 applied to i, or its inverse: a Feistel network with cycle walking."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2).astype(float)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, todo = i.astype(np.uint64), np.ones(len(i), bool)
    while todo.any():
        left, right, m, k = x[todo] >> half[todo], x[todo] & mask[todo], mask[todo], key[todo]
        for turn in range(4):
            if back:
                left, right = right ^ (mix(left * np.uint64(4) + np.uint64(3 - turn) + k) & m), left
            else:
                left, right = right, left ^ (mix(right * np.uint64(4) + np.uint64(turn) + k) & m)
        x[todo] = (left << half[todo]) | right
        todo[todo] = x[todo] >= n.astype(np.uint64)[todo]
    return x.astype(np.int64)


def _key(seed: int, source: np.ndarray, turn: np.ndarray) -> np.ndarray:
    return mix((np.uint64(seed % (1 << 32)) << np.uint64(32)) ^ mix(source.astype(np.uint64) * np.uint64(64) + turn.astype(np.uint64)))


def plan_source(number: int, size: int, target: float, block: int, seed: int) -> tuple[int, int, int]:
    """(blocks n, slots K, words of the last slot's block) with which a source's taken words are its rounded target."""
    n, want = -(-size // block), min(int(round(target)), REPEATS * size)
    if not want:
        return n, 0, 0
    turn, words = (want - 1) // size, (want - 1) % size + 1  # whole passes before the last one, words of the last
    tail = size - (n - 1) * block
    # the slot of this pass that takes the last, shorter block
    short = int(permuted(np.array([n - 1]), np.array([n]), _key(seed, np.array([number]), np.array([turn])), back=True)[0])
    upto = lambda k: k * block - (block - tail if k > short else 0)
    k = -(-words // block)
    if words > upto(k):
        k = -(-(words + block - tail) // block)
    return n, turn * n + k, words - upto(k - 1)


def _draw(shares: list[float], slots: int, shard_slots: int, seed: int):
    """(span, shard, source, drawn) for each shard and source that was drawn."""

    def run(batches):
        for batch in batches:
            out = ([], [], [], [])
            for shard in batch.column(0).to_pylist():
                rng = np.random.default_rng([seed, shard])
                drawn = rng.multinomial(min(shard_slots, slots - shard * shard_slots), shares)
                for s in np.flatnonzero(drawn):
                    for x, v in zip(out, (shard // SPAN, shard, s, drawn[s])):
                        x.append(int(v))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["span", "shard", "src", "drawn"])

    return run


def _running(df: DataFrame, keys: list[str], part: str, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the exclusive running total of ``value`` by ``keys`` in order of ``part`` and then ``order``.

    Parts are summed first, so no task sees more than one part, or the totals of the parts.
    """
    before = [Window.unboundedPreceding, -1]
    parts = df.groupBy(*keys, part).agg(F.sum(value).alias("_t"))
    parts = parts.withColumn("_b", F.coalesce(F.sum("_t").over(Window.partitionBy(*keys).orderBy(part).rowsBetween(*before)), F.lit(0))).drop("_t")
    inner = F.coalesce(F.sum(value).over(Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(*before)), F.lit(0))
    return df.withColumn("_i", inner).join(materialize(parts, "parts"), [*keys, part]).withColumn(name, F.col("_b") + F.col("_i")).drop("_b", "_i")


def _slots(plan: list[tuple], shard_slots: int):
    """Ranges (src, shard, k0, k1) to slots (src, shard, pass, block index, words): at most a shard's slots a row."""
    n = np.array([p[0] for p in plan], np.int64)
    most = np.array([p[1] for p in plan], np.int64)
    last = np.array([p[2] for p in plan], np.int64)
    size = np.array([p[3] for p in plan], np.int64)
    block, seed = plan[0][4], plan[0][5]

    def run(batches):
        for batch in batches:
            src, shard, a, b = (batch.column(c).to_numpy() for c in ("src", "shard", "k0", "k1"))
            for i in range(0, len(src), 256):
                count = b[i : i + 256] - a[i : i + 256]
                s, g = np.repeat(src[i : i + 256], count), np.repeat(shard[i : i + 256], count)
                k = np.arange(len(s)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(a[i : i + 256], count)
                turn = k // n[s]
                at = permuted(k % n[s], n[s], _key(seed, s, turn)) if len(s) else k
                words = np.minimum(block, size[s] - at * block)
                words = np.where(k == most[s] - 1, np.minimum(words, last[s]), words)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (s, g, turn, at, words)], ["src", "shard", "turn", "block", "words"])

    return run


def _few(sources: DataFrame, n: int) -> DataFrame:
    return F.broadcast(sources) if n <= FEW_SOURCES else sources


def _source_hash(source):
    return F.xxhash64(source, source.isNull())


def mix_plan(docs: DataFrame, block: int = 128, shard_slots: int = 2048, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, sources, takes) of the mix; see ``mix_sources``.

    ``documents``: id, text hash, source hash, copies, copy, source number, size, first (its first word's index in
    the source). ``sources``: src, source, source_size, target, slots, parts. ``takes``: id, h, hs, src, copies, copy, turn (pass
    over the source), shard, word_from and word_to within the document: the parts that the mix takes.

    One row for each source comes to the driver, where targets are shared out.
    """
    spark = docs.sparkSession
    given = pick(docs, id_col, text_col, source_col).toDF("id", "text", "source")
    size = F.coalesce(F.regexp_count("text", F.lit(BLANK)), F.lit(0)).cast("long")
    sized = given.select(F.col("id").cast("long").alias("id"), "source", size.alias("size"), F.xxhash64("text").alias("h"), _source_hash(F.col("source")).alias("hs"))
    sized = materialize(sized, "sized")
    totals = [(r["source"], r["size"], r["n"]) for r in sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()]
    totals.sort(key=lambda r: (r[0] is None, r[0] or ""))
    weights = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(totals))]
    goal = targets([t for _, t, _ in totals], weights)
    plan = [(*plan_source(i, t, g, block, seed), t, block, seed) if t else (1, 0, 0, 0, block, seed) for i, ((_, t, _), g) in enumerate(zip(totals, goal))]
    rows = [(i, s, t, float(g), p[1], n // PART_DOCS + 1) for i, ((s, t, n), g, p) in enumerate(zip(totals, goal, plan))]
    sources = spark.createDataFrame(rows, "src long, source string, source_size long, target double, slots long, parts long")

    # Copies of a row (same id, text and source) are numbered, so that each has a place of its own.
    named = sources.select("src", F.col("source").alias("named"), "parts")
    numbered = sized.join(_few(named, len(rows)), F.col("source").eqNullSafe(F.col("named"))).select("id", "h", "hs", "size", "src", "parts")
    counted = numbered.groupBy("src", "id", "h", "hs", "size", "parts").agg(F.count("*").alias("copies"))
    single = counted.select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    single = single.withColumn("part", F.pmod(F.xxhash64("id", "h", "copy"), F.col("parts"))).drop("parts")
    placed = materialize(_running(materialize(single, "docs"), ["src"], "part", ["id", "h", "copy"], "size", "first").drop("part"), "placed")

    slots = sum(p[1] for p in plan)
    shards = math.ceil(slots / shard_slots)
    if not slots:
        return placed, sources, spark.createDataFrame([], "id long, h long, hs long, src long, copies long, copy int, turn long, shard long, word_from long, word_to long")
    drawn = spark.range(shards).mapInArrow(_draw([p[1] / slots for p in plan], slots, shard_slots, seed), "span long, shard long, src long, drawn long")
    drawn = _running(materialize(drawn, "drawn"), ["src"], "span", ["shard"], "drawn", "k0")
    drawn = materialize(drawn.select("span", "shard", "src", "k0", (F.col("k0") + F.col("drawn")).alias("k1")), "drawn")
    # What was drawn beyond a source's slots goes, in order, to the sources that lack some.
    drawn = drawn.join(_few(sources.select("src", F.col("slots").alias("need")), len(rows)), "src")
    need = F.col("need")
    got = {r["src"]: r["n"] for r in drawn.groupBy("src").agg(F.max("k1").alias("n")).collect()}
    lack, gaps = 0, []
    for i, p in enumerate(plan):
        if p[1] > got.get(i, 0):
            gaps.append((i, got.get(i, 0), lack, lack + p[1] - got.get(i, 0)))
            lack = gaps[-1][3]
    ranges = drawn.select("src", "shard", "k0", F.least("k1", need).alias("k1")).where("k1 > k0")
    if gaps:
        over = drawn.select("span", "shard", "src", (F.col("k1") - F.greatest("k0", need)).alias("n")).where("n > 0").withColumn("all", F.lit(0))
        over = _running(materialize(over, "over"), ["all"], "span", ["shard", "src"], "n", "g0").select("shard", "g0", (F.col("g0") + F.col("n")).alias("g1"))
        gap = spark.createDataFrame(gaps, "src long, base long, a long, b long")
        met = over.join(F.broadcast(gap), (F.col("g0") < F.col("b")) & (F.col("g1") > F.col("a")))  # a row of three numbers for each source at most
        low, high = F.greatest("g0", "a"), F.least("g1", "b")
        ranges = ranges.unionByName(met.select("src", "shard", (F.col("base") + low - F.col("a")).alias("k0"), (F.col("base") + high - F.col("a")).alias("k1")))
    taken = materialize(ranges.mapInArrow(_slots(plan, shard_slots), "src long, shard long, turn long, block long, words long"), "slots")

    # Documents by the blocks they lie in, joined with the slots by index.
    end = F.col("first") + F.col("size")
    inside = placed.where("size > 0").select("*", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor((end - 1) / block))).alias("block"))
    start = F.col("block") * block
    met = inside.join(taken, ["src", "block"])
    a, b = F.greatest(F.col("first"), start), F.least(end, start + F.col("words"))
    takes = met.select("id", "h", "hs", "src", "copies", "copy", "turn", "shard", (a - F.col("first")).alias("word_from"), (b - F.col("first")).alias("word_to")).where("word_to > word_from")
    return placed, sources, takes


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """One row per input row: (doc_id, size, source_size, target, taken).

    Sizes are numbers of words ``[^\\x20\\x09-\\x0D]+`` (null texts: 0). Sources, by code point with null
    last, weigh 5, 2, 1 and so on again, and share the sum of all sizes; a target stops at three times
    its source's size. The words taken from a source sum to its target, rounded; no word is taken more than
    three times. Documents without words and sources without words take none; repeated rows have
    a place each; rows with a null id are documents like others. Further columns are ignored; an empty
    table gives an empty result.
    """
    placed, sources, takes = mix_plan(docs, **options)
    sums = takes.groupBy("src", "id", "h", "copy").agg(F.sum(F.col("word_to") - F.col("word_from")).alias("taken"))
    sums = sums.toDF("src_", "id_", "h_", "copy_", "taken")
    met = (F.col("src") == F.col("src_")) & F.col("id").eqNullSafe(F.col("id_")) & (F.col("h") == F.col("h_")) & (F.col("copy") == F.col("copy_"))
    out = placed.join(sums, met, "left").select("id", "src", "size", "taken")
    out = out.join(F.broadcast(sources) if sources.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES else sources, "src")
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def _cut(text_at: int, chars_at: int | None, width: int):
    """Rows of ``width`` columns and the parts taken, to the row with only the words taken of its text, parts in order."""
    import re

    words = re.compile(rb"[^\x20\x09-\x0D]+")

    def some(text: str, parts: list[dict]) -> str:
        raw = text.encode("utf-8", "surrogatepass")
        spans, joined = [m.span() for m in words.finditer(raw)], []
        for a, b in sorted((p["word_from"], p["word_to"]) for p in parts):
            if joined and a == joined[-1][1]:
                joined[-1][1] = b
            else:
                joined.append([a, b])
        if joined == [[0, len(spans)]]:
            return text
        return "\n".join(raw[spans[a][0] : spans[b - 1][1]].decode("utf-8", "surrogatepass") for a, b in joined)

    def run(batches):
        for batch in small_batches(batches, f"_c{text_at}"):
            texts = [some(t, p) for t, p in zip(batch.column(text_at).to_pylist(), batch.column(width).to_pylist())]
            columns = list(batch.columns[:width])
            columns[text_at] = pa.array(texts, pa.string())
            if chars_at is not None:
                columns[chars_at] = pa.array([len(t) for t in texts], columns[chars_at].type)
            yield pa.RecordBatch.from_arrays(columns, [f"_c{i}" for i in range(width)])

    return run


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str = "n_chars", **options) -> DataFrame:
    """The mix as documents: the parts taken of a row, a row for each pass over it, with all columns of ``docs``.

    A document that the mix takes whole keeps its text; of others the parts taken are joined by line ends, and
    ``n_chars``, where there is such a column, is counted anew. Rows that the mix does not take, such as null and blank
    texts, are not in it. Repeated rows each have parts of their own; rows with a null id or source are documents
    like others; an empty table gives an empty result.
    """
    placed, _, takes = mix_plan(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    key = ["_id", "_h", "_hs"]
    parts = takes.groupBy("id", "h", "hs", "copies", "copy", "turn").agg(F.collect_list(F.struct("word_from", "word_to")).alias("_parts"))
    parts = materialize(parts, "takes").toDF(*key, "_copies", "_copy", "_turn", "_parts")
    names, kinds = docs.columns, docs.schema
    flat = [f"_c{i}" for i in range(len(names))]
    at = {c: F.col(flat[names.index(c)]) for c in (id_col, text_col, source_col)}
    rows = docs.toDF(*flat).select("*", at[id_col].cast("long").alias("i"), F.xxhash64(at[text_col]).alias("h"), _source_hash(at[source_col]).alias("hs"))
    same = F.col("i").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")) & (F.col("hs") == F.col("_hs"))
    met = rows.join(parts.where("_copies = 1").hint("merge"), same).select(*flat, "_parts")
    repeated = placed.where("copies > 1").select("id", "h", "hs").distinct().toDF(*key)
    if not repeated.isEmpty():
        again = rows.join(repeated, same, "left_semi")
        again = again.withColumn("copy", F.row_number().over(Window.partitionBy("i", "h", "hs").orderBy("i")))
        met = met.unionByName(again.join(parts.where("_copies > 1"), same & (F.col("copy") == F.col("_copy"))).select(*flat, "_parts"))
    chars_at = names.index(chars_col) if chars_col in names else None
    out = met.mapInArrow(_cut(names.index(text_col), chars_at, len(names)), StructType([StructField(f, k.dataType) for f, k in zip(flat, kinds)]))
    return out.toDF(*names)
