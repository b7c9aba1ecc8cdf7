"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Documents and benchmark items are normalised (lower case, every run of other than letters and digits
is one space). An item with u q-grams that stand in it once, and that occurs with at most k edits, shares at least
``u - q k`` of these with the place, all on k + 1 neighbouring diagonals. Shared q-grams are
counted in bands of diagonals that overlap by half, so that some band holds them all; bands
that meet the bound are verified by an alignment kept to the band. q is chosen for each item so that the bound is
well above zero. Where an item repeats itself so much that there is no such q, stretches of a text that consist of its q-grams
are counted instead and aligned in blocks of diagonals. Items too short for an edit must stand as whole words. The
benchmark is the stated query set: it goes to the tasks in blocks of bounded size, and every document meets every block.
"""

from __future__ import annotations

from bisect import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import pick
from .hashing import mix, slices, small_batches

#: Lengths of q-grams, the first that leaves an item a bound of ``LEAST`` is taken.
QS = (8, 6, 5, 4, 3)
LEAST = 6
#: Edits allowed as a share of an item's normalised length.
RATE = 0.1
#: Characters of the benchmark that one block holds at most, about.
BLOCK_CHARS = 4_000_000
#: Diagonals of a block that are aligned at once, cells of a table of counts, and postings read at once.
DIAGONALS, CELLS, POSTINGS = 4096, 1 << 22, 1 << 21
_BITS = 22
_LETTER: list[np.ndarray] = []


def normalise(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, their places, starts): text i is the code points from starts[i] to starts[i + 1] - 1.

    After each text comes a 0. Places are those in the text given.
    """
    if not _LETTER:
        _LETTER.append(np.array([chr(c).isalnum() for c in range(0x110000)]))
    clean = [(t or "").replace("\0", " ").replace("İ", "i").lower() for t in texts]
    codes = np.frombuffer(("\0".join(clean) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.flatnonzero(codes == 0)
    blank = ~_LETTER[0][codes] & (codes != 0)
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    out = np.where(blank, 32, codes).astype(np.uint64)[keep]
    begin = np.concatenate([[0], ends[:-1] + 1])
    place = np.flatnonzero(keep) - np.repeat(begin, np.diff(np.concatenate([[0], np.cumsum(keep)[ends]])))
    starts = np.concatenate([[0], np.flatnonzero(out == 0) + 1])
    return out, place, starts


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    n = max(0, len(codes) - q + 1)
    h = np.zeros(n, np.uint64)
    for k in range(q):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n] + np.uint64(1)
    return mix(h)


class _Index:
    """The q-grams that stand once in their item, of the items of one q."""

    def __init__(self, q: int, items: list[tuple[int, np.ndarray, int]]):
        self.q, self.which = q, np.array([i for i, _, _ in items], np.int64)
        self.length, self.edits = (np.array([f(x) for x in items], np.int64) for f in (lambda x: len(x[1]), lambda x: x[2]))
        grams, owner, place, least = [], [], [], []
        for n, (_, codes, k) in enumerate(items):
            h, at = _once(codes, q)
            grams.append(h)
            owner.append(np.full(len(h), n))
            place.append(at)
            least.append(len(h) - q * k)
        h, owner, place = map(np.concatenate, (grams, owner, place))
        order = np.argsort(h, kind="stable")
        self.least, self.owner, self.place = np.array(least, np.int64), owner[order], place[order]
        self.keys, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.filter = np.zeros(1 << _BITS, bool)
        self.filter[(self.keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def _postings(self, at: np.ndarray, k: np.ndarray, starts: np.ndarray):
        """(place in the codes, text, posting) of shared q-grams, a bounded number at a time."""
        n = self.count[k]
        upto = np.cumsum(n)
        cuts = [0, *(np.searchsorted(upto, np.arange(POSTINGS, upto[-1], POSTINGS)) + 1), len(n)] if len(n) else [0]
        for a, b in zip(cuts[:-1], cuts[1:]):
            m = n[a:b]
            post = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(self.first[k[a:b]], m)
            where = np.repeat(at[a:b], m)
            yield where, np.searchsorted(starts, where, "right") - 1, post

    def bands(self, codes: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, least and greatest diagonal) of the bands that meet the bound."""
        h = _grams(codes, self.q)
        at = np.flatnonzero(self.filter[(h >> np.uint64(64 - _BITS)).astype(np.int64)]) if len(h) else np.empty(0, np.int64)
        k = np.searchsorted(self.keys, h[at])
        k[k == len(self.keys)] = 0
        same = self.keys[k] == h[at]
        at, k = at[same], k[same]
        # Texts with too few shared q-grams for an item in all are done with.
        shared = np.zeros((len(starts) - 1) * len(self.which), np.int32)
        for _, text, post in self._postings(at, k, starts):
            key, n = np.unique(text * len(self.which) + self.owner[post], return_counts=True)
            shared[key] += n.astype(np.int32)
        enough = shared >= np.tile(self.least, len(starts) - 1)
        if not enough.any():
            return []
        kept = []
        for where, text, post in self._postings(at, k, starts):
            keep = enough[text * len(self.which) + self.owner[post]]
            kept.append((where[keep], text[keep], post[keep]))
        at, text, post = map(np.concatenate, zip(*kept))
        item, j = self.owner[post], self.place[post]
        diagonal = at - starts[text] - j + self.length[item]
        width = self.edits[item] + 1
        band, j = np.concatenate([diagonal // width, diagonal // width - 1]), np.tile(j, 2)
        text, item = np.tile(text, 2), np.tile(item, 2)
        order = np.lexsort((j, band, item, text))
        row = np.stack([text, item, band], 1)[order]
        # each q-gram of the item counts once in a band
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]).any(1)
        fresh = new.copy()
        fresh[1:] |= j[order][1:] != j[order][:-1]
        n = np.add.reduceat(fresh.astype(np.int64), np.flatnonzero(new))
        row = row[new]
        text, item, band = row[n >= self.least[row[:, 1]]].T
        low = band * (self.edits[item] + 1) - self.length[item]
        return list(zip(text.tolist(), self.which[item].tolist(), low.tolist(), (low + 2 * (self.edits[item] + 1)).tolist()))


def _once(codes: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the q-grams that stand once in the codes, and their places."""
    h, at, n = np.unique(_grams(codes, q), return_index=True, return_counts=True)
    return h[n == 1], at[n == 1]


class Items:
    """The index of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        self.ids, self.codes, self.edits = [], [], []
        by_q: dict[int, list] = {}
        #: length to items without edits; items that repeat themselves, with q, their q-grams and the least number of them.
        self.words, self.plain = {}, []
        for i, text in items:
            codes, _, _ = normalise([text])
            at = np.flatnonzero(codes[:-1] != 32)
            if not len(at):
                continue
            codes = codes[at[0] : at[-1] + 1]
            n, k = len(self.ids), int(len(codes) * rate)
            self.ids.append(i)
            self.codes.append(codes)
            self.edits.append(k)
            bounds = {q: len(_once(codes, q)[0]) - q * k for q in QS}
            if not k:
                self.words.setdefault(len(codes), []).append(n)
            elif max(bounds.values()) >= LEAST // 2:
                q = next((q for q in QS if bounds[q] >= LEAST), max(QS, key=bounds.get))
                by_q.setdefault(q, []).append((n, codes, k))
            else:
                q = next((q for q in QS if len(codes) - q + 1 - q * k >= LEAST), QS[-1])
                self.plain.append((n, q, np.unique(_grams(codes, q)), max(1, len(codes) - q + 1 - q * k)))
        self.by_q = [_Index(q, x) for q, x in sorted(by_q.items())]
        for m, numbers in self.words.items():
            h = np.array([_grams(self.codes[n], m)[0] for n in numbers], np.uint64)
            order = np.argsort(h, kind="stable")
            self.words[m] = h[order], np.array(numbers)[order]

    def find(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, start, end, edits) of every place where an item occurs within its edits."""
        if not self.ids:
            return []
        if len(texts) > 1 and len(texts) * len(self.ids) > CELLS:
            half = len(texts) // 2
            return self.find(texts[:half]) + [(t + half, *rest) for t, *rest in self.find(texts[half:])]
        codes, place, starts = normalise(texts)
        bands = [b for index in self.by_q for b in index.bands(codes, starts)]
        for plain in self.plain:
            bands += self._stretches(codes, starts, *plain)
        found = []
        for t, i, low, high in bands:
            hit = align(self.codes[i], codes[starts[t] : starts[t + 1] - 1], low, high, self.edits[i])
            if hit:
                found.append((t, i, *hit))
        for m, (keys, numbers) in self.words.items():
            h = _grams(codes, m)
            a = np.searchsorted(keys, h)
            a[a == len(keys)] = 0
            at = np.flatnonzero(keys[a] == h) if len(h) else np.empty(0, np.int64)
            at = at[np.isin(codes[at - 1], (0, 32)) & np.isin(codes[at + m], (0, 32))]  # the last code is 0
            left, right = np.searchsorted(keys, h[at]), np.searchsorted(keys, h[at], "right")
            text = np.searchsorted(starts, at, "right") - 1
            for p, t, x, y in zip(at.tolist(), text.tolist(), left.tolist(), right.tolist()):
                found += [(t, int(n), int(p - starts[t]), int(p - starts[t] + m), 0) for n in numbers[x:y]]
        # Of hits of one item that overlap the one with the fewest edits stays, the first of equal ones.
        out, last = [], {}
        for t, i, a, b, d in sorted(found, key=lambda x: (x[0], x[1], x[4], x[2], x[3])):
            taken = last.setdefault((t, i), [])
            k = bisect(taken, (a, b))
            if (k and taken[k - 1][1] > a) or (k < len(taken) and taken[k][0] < b):
                continue
            taken.insert(k, (a, b))
            out.append((t, self.ids[i], int(place[starts[t] + a]), int(place[starts[t] + b - 1]) + 1, d))
        return sorted(out)

    def _stretches(self, codes: np.ndarray, starts: np.ndarray, n: int, q: int, grams: np.ndarray, least: int) -> list[tuple[int, int, int, int]]:
        """Blocks of diagonals where enough of the text's q-grams are the item's."""
        h, m, k = _grams(codes, q), len(self.codes[n]), self.edits[n]
        hit = np.flatnonzero(np.isin(h, grams))
        # as many hits as needed within the greatest length of an occurrence
        first = np.flatnonzero(hit[least - 1 :] - hit[: len(hit) - least + 1] <= m + k - q)
        low = hit[first] - (m + k)
        text = np.searchsorted(starts, hit[first], "right") - 1
        block = {(t, d // DIAGONALS) for t, a in zip(text.tolist(), (low - starts[text]).tolist()) for d in (a, a + m + 2 * k)}
        return [(t, n, d * DIAGONALS, (d + 1) * DIAGONALS - 1) for t, d in sorted(block)]


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the best place of ``item`` in ``text`` on diagonals low - most .. high + most, or None.

    Edit distance with a free beginning and end in the text; of equal ends the first is taken.
    """
    low, high = low - most, high + most
    width, far = high - low + 1, len(item) + len(text) + 1
    step = np.arange(width)
    a, b = max(0, low), max(0, min(len(text), high + len(item)))
    p = text[a:b].tobytes().find(item.tobytes())
    if p >= 0 and p % 8 == 0:
        return a + p // 8, a + p // 8 + len(item), 0
    padded = np.full(len(item) + width + 2, 1 << 40, np.uint64)
    a, b = max(0, low), min(len(text), low + len(padded))
    if b > a:
        padded[a - low : b - low] = text[a:b]
    i0 = low + step  # text position before the first item character
    cost = np.where((i0 >= 0) & (i0 <= len(text)), 0, far)
    begin = i0.copy()
    inner = low >= 0 and high + len(item) <= len(text)
    shifted, moved = np.empty_like(cost), np.empty_like(begin)
    shifted[-1], moved[-1] = far, 0
    for j in range(1, len(item) + 1):
        match = cost + (padded[j - 1 : j - 1 + width] != item[j - 1])
        if not inner:
            match[i0 + j < 1] = far
        shifted[:-1], moved[:-1] = cost[1:], begin[1:]
        gap = shifted + 1
        take = gap < match
        new, origin = np.where(take, gap, match), np.where(take, moved, begin)
        if not inner:
            new[(i0 + j < 0) | (i0 + j > len(text))] = far
        slope = new - step
        run = np.minimum.accumulate(slope)
        cost = run + step
        if cost.min() > most:
            return None
        begin = origin[np.maximum.accumulate(np.where(slope == run, step, 0))]
    k = int(cost.argmin())
    if cost[k] > most or int(i0[k]) + len(item) <= int(begin[k]):
        return None
    return max(0, int(begin[k])), int(i0[k]) + len(item), int(cost[k])


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_chars: int = BLOCK_CHARS):
    """The benchmark's items in blocks of about ``block_chars`` characters, each collected in its turn."""
    items = pick(benchmark, id_col, text_col).toDF("id", "text").where("id is not null and text is not null")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total // block_chars))
    for k in range(blocks):
        some = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).distinct().collect()
        yield sorted((r["id"], r["text"]) for r in some)


def _hits(index):
    def run(batches):
        for batch in small_batches(batches, "text"):
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for a, b in slices([len(t) if t else 0 for t in texts]):
                found = index.value.find(texts[a:b])
                cols = list(zip(*[(ids[a + t], i, s, e, d) for t, i, s, e, d in found])) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "start", "end", "edits"])

    return run


def _without(index, text: str):
    def run(batches):
        for batch in small_batches(batches, text):
            texts = batch.column(text).to_pylist()
            keep = np.ones(len(texts), bool)
            for a, b in slices([len(t) if t else 0 for t in texts]):
                keep[[a + t for t, *_ in index.value.find(texts[a:b])]] = False
            yield batch.filter(pa.array(keep))

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row for each place where a document holds a benchmark item: (doc_id, item_id, start, end, edits).

    ``start`` and ``end`` are code points of the text. Whole texts are searched, for items of every length with edits
    up to ``rate`` of it, rounded down; items too short for one edit must stand as whole words. Null and empty
    texts hold nothing, items without a letter or digit are nowhere. A document with a null id gives rows with a null id, an item
    with a null id is left out. Repeated rows give repeated results; equal items each give their own; of places of
    one item that overlap the one with the fewest edits counts, then the first. Further columns are ignored;
    an empty table on either side gives an empty result.
    """
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    out = None
    for block in item_blocks(benchmark):
        index = docs.sparkSession.sparkContext.broadcast(Items(block, **options))
        found = rows.mapInArrow(_hits(index), "doc_id long, item_id long, start long, end long, edits long")
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns; see ``contaminated``.

    Null and empty texts stay, as do all documents where the benchmark is empty; repeated rows stay as often as given.
    """
    names = docs.columns
    flat = [f"_c{i}" for i in range(len(names))]
    text_at = names.index(text_col)
    kind = StructType([StructField(f, k.dataType) for f, k in zip(flat, docs.schema)])
    docs = docs.toDF(*flat)
    for block in item_blocks(benchmark):
        index = docs.sparkSession.sparkContext.broadcast(Items(block, **options))
        docs = docs.mapInArrow(_without(index, flat[text_at]), kind)
    return docs.toDF(*names)
