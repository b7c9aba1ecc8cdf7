"""Tokens of two tokenizers aligned by bytes, with corpus-wide counts of linked id pairs behind a minimal perfect hash.

First pass: every text is encoded twice and aligned; tasks add up their links and hand on a row for each distinct pair.
The distinct pairs are dealt into buckets by hash, and each bucket gets a minimal perfect hash: bit arrays in levels, where a key has
the first bit that it alone of the keys left falls on, and its slot is the number of bits before it. Counts of a group of tasks are
one dense vector by slot; vectors of a bucket are summed up a tree. Second pass: texts are aligned again and every pair
looks up its count by hash, verified by the key kept in its slot.

Both tokenizers treat a stretch of text that ends before a single space between two other signs on its own, so
stretches are encoded and aligned once in a task; where a tokenizer's file does not promise that, the text is one stretch.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, pick
from .hashing import mix, slices, small_batches
from .token_store import _UNEVEN

#: Pairs that a bucket is meant for; a vector of it has so many slots.
BUCKET_PAIRS = 1 << 18
#: Rows of one leaf of the tree, and vectors that one node adds up.
LEAF_ROWS, FAN = 1 << 20, 16
#: Pairs that tasks look up by hash. Where there are more, the most frequent are, and the others by a join.
LOOKUP_PAIRS = 4_000_000
#: Distinct pairs that a task holds before it hands them on.
HELD_PAIRS = 2_000_000
#: Bytes of text that are split and looked up together.
BATCH = 3_000_000
#: Bits of a level for each key left.
GAMMA = 2
_SEED = 0x9E3779B97F4A7C15
_STATE: dict = {}

RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_table() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable bytes for themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in shown}
    return table | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}


_L, _S = "A-Za-zÀ-ÖØ-öø-ɏ", r"!-&(-/:-@\[-`{-~"
#: A stretch of Latin letters; one of letters, digits, signs other than the apostrophe, and single line feeds inside; its runs.
LETTERS = re.compile(f"[{_L}]+")
RUNS = re.compile(f"[{_L}0-9{_S}]+(?:\n[{_L}0-9{_S}]+)*")
RUN = re.compile(f"[{_L}]+|[0-9]+|[{_S}]+|\n")
EDGE = re.compile(r"\s|.*\s\Z", re.S).match


class Stretches:
    """What each stretch of text comes to under both tokenizers, end to end in flat arrays.

    Short stretches are found again by their text. All are forgotten once there are ``most``, or eight times as many links.
    """

    SPLIT = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, a_path: str, b_path: str, most: int = 600_000, longest: int = 48):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True  # their strings are plain text
        self.most, self.longest = most, longest
        spec, at = json.loads(self.a.to_str()), byte_table()
        names = self.a.get_vocab()
        self.a_bytes = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.a_bytes[i] = bytes(at[c] for c in name) if all(c in at for c in name) else name.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        split = spec.get("pre_tokenizer") or {}
        usual = spec.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and spec["model"].get("type") == "BPE"
        inner = any("▁" in p.lstrip("▁") for p in pieces)
        # B must keep white space and signs as they are, or stretches could not be told apart beforehand.
        kept = b"".join(self.b_bytes[i] for i in self.b.encode("x Ⅳ  y ")) == " x Ⅳ  y ".encode()
        self.by_stretch = bool(usual) and not inner and kept
        self.model, self.pieces, self.shown = self.a.model, {}, {b: ord(c) for c, b in at.items()}
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.names: list[str] = []
        #: Whether both give the text back, tokens of A and B, groups: four numbers for each stretch.
        self.numbers, self.flat, self.end = array("q"), array("q"), array("q", [0])

    def full(self) -> bool:
        return len(self.end) > self.most or len(self.flat) > 8 * self.most

    def table(self) -> np.ndarray:
        return np.frombuffer(self.numbers, np.int64).reshape(-1, 4) if self.numbers else np.empty((0, 4), np.int64)

    def pairs_of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of stretches, end to end, and how many each has."""
        flat, end = np.frombuffer(self.flat, np.int64) if self.flat else np.empty(0, np.int64), np.frombuffer(self.end, np.int64)
        size = end[codes + 1] - end[codes]
        upto = np.cumsum(size)
        return flat[np.repeat(end[codes + 1] - upto, size) + np.arange(upto[-1] if len(upto) else 0)], size

    def split(self, texts: pa.Array) -> pa.ListArray:
        """The stretches of each text; null and empty texts have none."""
        texts = pc.fill_null(texts, "")
        if not self.by_stretch:
            return pa.array([[t] if t else [] for t in texts.to_pylist()], pa.list_(pa.string()))
        odd = pc.or_(pc.match_substring_regex(texts, _UNEVEN), pc.equal(texts, ""))
        out = pc.split_pattern(texts, " ")
        if pc.any(odd).as_py():
            at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
            lists = pa.array([self.SPLIT.split(t) if t else [] for t in texts.take(pa.array(at)).to_pylist()], out.type)
            order = np.arange(len(out))
            order[at] = len(out) + np.arange(len(at))
            out = pa.concat_arrays([out, lists]).take(pa.array(order))
        return out

    def __call__(self, texts: pa.Array, groups: bool) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all stretches, first one of each text); numbers hold until ``clear``."""
        lists = self.split(texts)
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        found = list(map(self.code.get, words))
        new = [i for i, n in enumerate(found) if n is None]
        if new:
            first = len(self.end) - 1
            self._align([words[i] for i in new], groups)
            for n, i in enumerate(new, first):
                found[i] = n
            self.code |= {words[i]: found[i] for i in new if len(words[i]) <= self.longest}
        code = np.array(found, np.int64)[coded.indices.to_numpy()] if words else np.empty(0, np.int64)
        return code, np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])

    def _a_ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of the texts with a space before each. Runs of letters, of digits and of signs are single pieces to the tokenizer."""
        if not self.by_stretch:
            return [e.ids for e in self.a.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)]
        out, other, tokenize, pieces = [], [], self.model.tokenize, self.pieces
        for i, t in enumerate(texts):
            if LETTERS.fullmatch(t):
                name = "Ġ" + t if t.isascii() else "Ġ" + t.encode().decode("latin-1").translate(self.shown)
                out.append([x.id for x in tokenize(name)])
            elif RUNS.fullmatch(t):
                ids, before = [], "Ġ"
                for run in RUN.findall(t):
                    name = before + (run if run.isascii() and run != "\n" else run.encode().decode("latin-1").translate(self.shown))
                    got = pieces.get(name)
                    if got is None:
                        got = [x.id for x in tokenize(name)]
                        if len(name) < 5 and len(pieces) < 100_000:
                            pieces[name] = got
                    ids += got
                    before = ""
                out.append(ids)
            else:
                other.append(i)
                out.append([])
        for i, e in zip(other, self.a.encode_batch_fast([f" {texts[i]}" for i in other], add_special_tokens=False)):
            out[i] = e.ids
        return out

    def _same(self, table: list[bytes], ids: list[int], text: str) -> bool:
        return b"".join(map(table.__getitem__, ids)) == text.encode()

    def _align(self, new: list[str], groups: bool) -> None:
        """Rows and pairs of new stretches, all aligned at once."""
        by_a, ids_a, ids_b, good = self._a_ids(new), [], [], np.ones(len(new), bool)
        for x, y in slices([len(t) for t in new], 20_000):
            part = new[x:y]
            one, flat = " ".join(part), list(chain.from_iterable(by_a[x:y]))
            # B may take neighbours at once, but for white space at an end, which only the ends of a text have.
            whole = self.b.encode(one) if self.by_stretch and not any(map(EDGE, part)) else None
            if whole is not None and self._same(self.a_bytes, flat, " " + one) and self._same(self.b_bytes, whole, " " + one):
                ids_a += flat
                ids_b += whole
                continue
            for i, t in enumerate(part, x):
                ids = self.b.encode(t)
                good[i] = self._same(self.a_bytes, by_a[i], " " + t) and self._same(self.b_bytes, ids, " " + t)
                if good[i]:
                    ids_a += by_a[i]
                    ids_b += ids
        flat_a, flat_b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        end_a, end_b = np.cumsum(self.a_size[flat_a]), np.cumsum(self.b_size[flat_b])
        upto = np.cumsum(np.where(good, pc.binary_length(pa.array(new, pa.string())).to_numpy() + 1, 0))
        # What lies between two neighbouring ends of either kind is in one token of each: these are the links.
        ends = np.sort(np.concatenate([end_a, end_b]))
        first = np.diff(ends, prepend=0) > 0
        both = ends[~first]
        ends = ends[first]
        link_a, link_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        self.flat.frombytes((flat_a[link_a] << 32 | flat_b[link_b]).tobytes())
        self.end.frombytes((self.end[-1] + np.searchsorted(ends, upto, "right")).tobytes())
        per = [np.diff(np.searchsorted(e, upto, "right"), prepend=0) for e in (end_a, end_b, both)]
        self.numbers.frombytes(np.column_stack([good.astype(np.int64), *per]).tobytes())
        if groups:
            lists = []
            for flat, end in ((flat_a, end_a), (flat_b, end_b)):
                cut = np.concatenate([[0], np.searchsorted(end, both, "right")]).astype(np.int32)
                lists.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(cut), pa.array(flat).cast(pa.string())), ","))
            cut = np.concatenate([[0], np.cumsum(per[2])]).astype(np.int32)
            joined = pa.ListArray.from_arrays(pa.array(cut), pc.binary_join_element_wise(*lists, "|"))
            self.names += pc.binary_join(joined, ";").to_pylist()


def stretches(a_path: str, b_path: str) -> Stretches:
    """One for each worker, empty."""
    if (a_path, b_path) not in _STATE:
        _STATE[a_path, b_path] = Stretches(a_path, b_path)
    _STATE[a_path, b_path].clear()
    return _STATE[a_path, b_path]


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, at = np.unique(keys, return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, at, n)
    return distinct, total


def _count(a_path: str, b_path: str):
    """First pass: (part, pair, n), the links of a task by pair."""

    def run(batches):
        s, part = stretches(a_path, b_path), TaskContext.get().partitionId()
        keys, n = np.empty(0, np.int64), np.empty(0, np.int64)
        times = np.zeros(0, np.int64)

        def rows(k, v):
            for a, b in slices([1] * len(k), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, part, np.int64)), pa.array(k[a:b]), pa.array(v[a:b])], ["part", "pair", "n"])

        def more():
            """The pairs so far and those of the stretches met."""
            used = np.flatnonzero(times)
            k, size = s.pairs_of(used)
            return _summed(np.concatenate([keys, k]), np.concatenate([n, np.repeat(times[used], size)]))

        for batch in small_batches(batches, "text", BATCH):
            code, first = s(batch.column("text"), False)
            bad = s.table()[code, 0] == 0
            if bad.any():  # such texts have no tokens at all
                text_of = np.repeat(np.arange(batch.num_rows), np.diff(first))
                code = code[~np.isin(text_of, text_of[bad])]
            met = np.bincount(code, minlength=len(s.end) - 1)
            met[: len(times)] += times
            times = met
            if s.full():
                keys, n = more()
                s.clear()
                times = times[:0]
                if len(keys) > HELD_PAIRS:
                    yield from rows(keys, n)
                    keys, n = keys[:0], n[:0]
        yield from rows(*more())

    return run


def seed(level: int) -> np.uint64:
    return np.uint64(_SEED * (level + 1) % (1 << 64))


def place(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words in each level, bits of all levels, slot of each key) of distinct keys."""
    left, at = keys.astype(np.uint64), np.arange(len(keys))
    sizes, levels, hits, base = [], [], np.zeros(len(keys), np.int64), 0
    while len(left):
        words = -(-GAMMA * len(left) // 64)
        pos = (mix(left + seed(len(sizes))) % np.uint64(words * 64)).astype(np.int64)
        alone = np.bincount(pos, minlength=words * 64)[pos] == 1
        bits = np.zeros(words * 64, np.uint8)
        bits[pos[alone]] = 1
        hits[at[alone]] = base + pos[alone]
        levels.append(np.packbits(bits, bitorder="little").view("<u8"))
        sizes.append(words)
        base += words * 64
        left, at = left[~alone], at[~alone]
    bits = np.concatenate(levels) if levels else np.empty(0, "<u8")
    slot = np.empty(len(keys), np.int64)
    slot[np.argsort(hits)] = np.arange(len(keys))
    return np.array(sizes, np.int64), bits, slot


class PairHash:
    """Minimal perfect hash of the keys of all buckets given: slots are numbered through, bucket by bucket."""

    def __init__(self, buckets: int, rows: list[tuple[int, bytes, bytes]]):
        """``rows``: (bucket, words in each level, bits of all levels)."""
        self.buckets, rows = buckets, sorted(rows)
        sizes = [np.frombuffer(r[1], np.int64) for r in rows]
        deep = max([len(s) for s in sizes], default=0)
        self.words, self.start = np.zeros((deep, buckets), np.int64), np.zeros((deep, buckets), np.int64)
        base = 0
        for (bucket, *_), s in zip(rows, sizes):
            self.words[: len(s), bucket] = s
            self.start[: len(s), bucket] = base + np.cumsum(s) - s
            base += int(s.sum())
        self.bits = np.concatenate([np.frombuffer(r[2], "<u8") for r in rows]) if rows else np.empty(0, "<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.bits).astype(np.int64))])

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Slots; -1 for some keys that are not in it, others must be told by the key kept in the slot."""
        out = np.full(len(keys), -1, np.int64)
        at, key, bucket = np.arange(len(keys)), keys.astype(np.uint64), bucket_of(keys, self.buckets)
        for level, (words, start) in enumerate(zip(self.words, self.start)):
            m = words[bucket]
            ok = m > 0
            at, key, bucket, m = at[ok], key[ok], bucket[ok], m[ok]
            pos = (mix(key + seed(level)) % (m * 64).astype(np.uint64)).astype(np.int64)
            word, bit = start[bucket] + pos // 64, (pos % 64).astype(np.uint64)
            held = self.bits[word] >> bit
            hit = (held & np.uint64(1)).astype(bool)
            below = self.bits[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[at[hit]] = self.before[word[hit]] + np.bitwise_count(below)
            at, key, bucket = at[~hit], key[~hit], bucket[~hit]
        return out


def bucket_of(pair, buckets: int):
    """The bucket of a pair, of a column as well as of an array."""
    if isinstance(pair, np.ndarray):
        return ((pair >> 32) * 1_000_003 + (pair & 0xFFFFFFFF) * 8191) % buckets
    return F.pmod(F.shiftright(pair, 32) * 1_000_003 + pair.bitwiseAND(F.lit(0xFFFFFFFF)) * 8191, F.lit(buckets))


def _binary(x: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes()], pa.binary())


def hashed(pairs: DataFrame, buckets: int, *values: str) -> DataFrame:
    """(bucket, words, bits, pairs, …): the perfect hash of each bucket of distinct pairs, with pairs and long ``values`` in order of slots."""

    def build(t: pa.Table) -> pa.Table:
        keys = t["pair"].to_numpy()
        words, bits, slot = place(keys)
        order = np.argsort(slot)
        cols = [_binary(t[c].to_numpy().astype(np.int64)[order]) for c in ("pair", *values)]
        return pa.table([t["bucket"].slice(0, 1).combine_chunks(), _binary(words), _binary(bits), *cols], ["bucket", "words", "bits", "pairs", *values])

    dealt = pairs.select(bucket_of(F.col("pair"), buckets).alias("bucket"), "pair", *values)
    kind = "bucket long, words binary, bits binary, pairs binary" + "".join(f", {v} binary" for v in values)
    return dealt.groupBy("bucket").applyInArrow(build, kind)


def _vector(counts: pa.Table, table: pa.Table) -> pa.Table:
    """The counts of one group of tasks as a dense vector by slot of their bucket's hash."""
    if not counts.num_rows or not table.num_rows:
        return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.binary())], ["bucket", "node", "vector"])
    bucket = table["bucket"][0].as_py()
    keys = np.frombuffer(table["pairs"][0].as_py(), np.int64)
    index = PairHash(1, [(0, table["words"][0].as_py(), table["bits"][0].as_py())])
    slot, pair = index(counts["pair"].to_numpy()), counts["pair"].to_numpy()
    if not np.array_equal(keys[slot], pair):
        raise RuntimeError("a pair is not in its slot")
    vector = np.zeros(len(keys), np.int64)
    np.add.at(vector, slot, counts["n"].to_numpy())
    return pa.table([pa.array([bucket]), pa.array([counts["node"][0].as_py()]), _binary(vector)], ["bucket", "node", "vector"])


def _added(t: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(v, np.int64) for v in t["vector"].to_pylist())
    return pa.table([t["bucket"].slice(0, 1).combine_chunks(), t["node"].slice(0, 1).combine_chunks(), _binary(total)], ["bucket", "node", "vector"])


def _spread(batches):
    """(pair, n) of whole vectors."""
    for batch in batches:
        for keys, vector in zip(batch.column("pairs").to_pylist(), batch.column("vector").to_pylist()):
            k, v = np.frombuffer(keys, np.int64), np.frombuffer(vector, np.int64)
            for a, b in slices([1] * len(k), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(k[a:b]), pa.array(v[a:b])], ["pair", "n"])


def pair_counts(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(pair, n) with pair = A id * 2**32 + B id: how many links of the corpus hold it. Written to the shared folder."""
    text = pick(docs, text_col).toDF("text")
    partial = materialize(text.mapInArrow(_count(a_path, b_path), "part long, pair long, n long"), "links")
    size = partial.agg(F.count("*").alias("rows"), F.approx_count_distinct("pair", 0.02).alias("pairs")).first()
    buckets = max(1, -(-size["pairs"] // BUCKET_PAIRS))
    nodes = max(1, -(-size["rows"] // (buckets * LEAF_ROWS)))
    index = materialize(hashed(partial.select("pair").distinct(), buckets), "hash")
    leaves = partial.select(bucket_of(F.col("pair"), buckets).alias("bucket"), F.pmod("part", F.lit(nodes)).alias("node"), "pair", "n")
    every = index.withColumn("node", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nodes - 1).cast("long"))))
    shape = "bucket long, node long, vector binary"
    tree = leaves.groupBy("bucket", "node").cogroup(every.groupBy("bucket", "node")).applyInArrow(_vector, shape)
    while nodes > 1:
        nodes = -(-nodes // FAN)
        tree = tree.withColumn("node", F.expr(f"node div {FAN}")).groupBy("bucket", "node").applyInArrow(_added, shape)
    whole = index.select("bucket", "pairs").join(tree.select("bucket", "vector").hint("merge"), "bucket")
    found = materialize(whole.select("pairs", "vector").mapInArrow(_spread, "pair long, n long"), "pairs")
    discard(partial, index)
    return found


class Lookup:
    """Count and mark of each pair kept, by perfect hash with verified keys."""

    def __init__(self, buckets: int, rows: list):
        rows = sorted(rows, key=lambda r: r["bucket"])
        whole = lambda name: np.concatenate([np.frombuffer(r[name], np.int64) for r in rows] or [np.empty(0, np.int64)])
        self.slot = PairHash(buckets, [(r["bucket"], bytes(r["words"]), bytes(r["bits"])) for r in rows])
        self.keys, self.n, self.best = whole("pairs"), whole("n"), whole("best").astype(bool)

    def __call__(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whether kept, count, whether the count is the greatest of its B id)."""
        slot = self.slot(pairs)
        at = np.maximum(slot, 0)
        known = (slot >= 0) & (self.keys[at] == pairs) if len(self.keys) else np.zeros(len(pairs), bool)
        return (known, np.where(known, self.n[at], 0), known & self.best[at]) if len(self.keys) else (known, np.zeros(len(pairs), np.int64), known)


def _second(a_path: str, b_path: str, lookup):
    """Second pass: a row for each document, with the pairs that are not looked up by hash, repeats included."""

    def run(batches):
        s, find = stretches(a_path, b_path), lookup.value
        found, known = np.empty((0, 3), np.int64), np.empty(0, bool)
        for batch in small_batches(batches, "text", BATCH):
            if s.full():
                s.clear()
                found, known = found[:0], known[:0]
            code, first = s(batch.column("text"), True)
            # Links, best ones and counts of stretches that are new since the last batch.
            pairs, size = s.pairs_of(np.arange(len(found), len(s.end) - 1))
            have, n, best = find(pairs)
            ends = np.concatenate([[0], np.cumsum(size)])
            total = [np.diff(np.concatenate([[0], np.cumsum(x.astype(np.int64))])[ends]) for x in (best, n)]
            found, known = np.concatenate([found, np.column_stack([size, *total])]), np.concatenate([known, have])
            cols = np.column_stack([s.table(), found])
            sums = np.stack([np.diff(np.concatenate([[0], np.cumsum(cols[code, k])])[first]) for k in range(7)])
            good = sums[0] == np.diff(first)
            sums[:, ~good] = 0
            marks, others, names, codes = [], [], s.names, code.tolist()
            for a, b, ok in zip(first[:-1].tolist(), first[1:].tolist(), good.tolist()):
                marks.append(hashlib.sha256(";".join(map(names.__getitem__, codes[a:b])).encode()).hexdigest() if ok and b > a else "")
                if known.all() or not ok:
                    others.append(None)
                else:
                    at, size = s.pairs_of(code[a:b])
                    start = np.frombuffer(s.end, np.int64)[code[a:b]]
                    place = np.repeat(start - np.cumsum(size) + size, size) + np.arange(len(at))
                    others.append(at[~known[place]].tolist())
            data = [pa.array(sums[k]) for k in range(1, 7)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *data, pa.array(marks, pa.string()), pa.array(others, pa.list_(pa.int64()))], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "others"])

    return run


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A is a byte-level BPE file of ``tokenizers``, B a ``sentencepiece`` model; A encodes a space and the text, B the text, to
    which it adds the space. Groups end where tokens of both end. A link is an A and a B token that share a byte; a
    pair's count is the number of links of the whole corpus with these two ids, ``n_best`` the number of links whose count is
    the highest of their B id, ``count_sum`` the sum over all links, and ``groups_sha256`` the digest of the groups' ids.

    Null and empty texts and those that either tokenizer does not give back byte for byte have zeros and an empty digest, and count
    nowhere. Texts of any length are encoded whole. Null ids and repeated rows are documents of their own; further
    columns are ignored, whatever their names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = pair_counts(rows, a_path, b_path)
    # A row for each B id: as many as its vocabulary has at most.
    of_b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    most = counts.groupBy(of_b.alias("b")).agg(F.max("n").alias("most"))
    counts = counts.withColumn("b", of_b).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    scale = {r["k"]: r["c"] for r in counts.groupBy(F.floor(F.log2("n")).alias("k")).agg(F.count("*").alias("c")).collect()}
    least, total = 0, sum(scale.values())
    while total > LOOKUP_PAIRS:
        total -= scale.get(least, 0)
        least += 1
    buckets = max(1, -(-total // BUCKET_PAIRS))
    hot = counts.where(F.floor(F.log2("n")) >= least)
    lookup = spark.sparkContext.broadcast(Lookup(buckets, hashed(hot, buckets, "n", "best").collect()))
    found = rows.mapInArrow(_second(a_path, b_path, lookup), f"{RESULT}, others array<long>")
    if not least:
        return found.drop("others")
    found = materialize(found.withColumn("row", F.monotonically_increasing_id()), "aligned")
    rare = found.select("row", F.explode("others").alias("pair")).groupBy("row", "pair").agg(F.count("*").alias("times"))
    rare = rare.join(counts.where(F.floor(F.log2("n")) < least).hint("merge"), "pair")
    rare = rare.groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    met = found.join(rare, "row", "left")
    more = lambda name, other: (F.col(name) + F.coalesce(other, F.lit(0))).alias(name)
    return met.select("doc_id", "n_a", "n_b", "n_groups", "n_links", more("n_best", "more_best"), more("count_sum", "more_sum"), "groups_sha256")
