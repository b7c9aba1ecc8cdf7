"""Language identification with interpolated Kneser-Ney character models.

One model for each language, over the letters of words with a boundary on either side. The model
of a language is, for each order, a sorted array of 64-bit n-gram hashes with log probabilities and
back-off weights; the arrays of all languages are merged, so that one binary search serves all. A text
is in the language with the lowest cross-entropy per symbol. It is rejected where no language explains its words: where the
cross-entropy of its distinct words, each by its own best language, lies ``DEVIATIONS`` standard deviations above the mean
of held-back texts of its language. Whatever the distribution, at most one in 1 + DEVIATIONS ** 2 texts of
a learned language lies so far out (Cantelli's inequality). Scores of words are kept while a task runs.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import bucket_of, discard, materialize, pick, unit_hash
from .hashing import mix, slices, small_batches

ORDER = 5
#: A false-rejection rate of 1 in 101 at most; texts of a language by a model of another lie more than 15 out.
DEVIATIONS = 10
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+").findall
_MULT = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Runs of letters, in lower case."""
    found = _LETTERS(text.lower()) if text else []
    # The pattern lets numeric signs such as superscripts through, too.
    return found if all(map(str.isalpha, found)) else ["".join(filter(str.isalpha, w)) for w in found if any(map(str.isalpha, w))]


def _symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, each with a boundary (32) before and after, and where each word begins."""
    joined = " " + "  ".join(words) + " "
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words])
    return codes, np.concatenate([[0], np.cumsum(lengths)[:-1]])


def _grams(codes: np.ndarray, place: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams that end at each symbol which has n - 1 before it in its word, and those symbols."""
    at = np.flatnonzero(place >= n - 1)
    h = np.zeros(len(at), np.uint64)
    for k in range(n - 1, -1, -1):
        h = h * _MULT + codes[at - k] + np.uint64(1)
    return mix(h + np.uint64(n)), at


def _places(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    place = np.arange(len(codes))
    return place - np.repeat(first, np.diff(np.concatenate([first, [len(codes)]])))


def train_language(texts: list[str], order: int = ORDER) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(n, sorted hashes, log probabilities, log back-off weights) for n = 1..order.

    Interpolated Kneser-Ney: counts for the highest order, numbers of distinct left
    neighbours below it (counts too for n-grams that begin a word), one discount for each order. The
    back-off weight of an n-gram is that of the context it makes for order n + 1.
    """
    words = [w for t in texts for w in words_of(t)]
    if not words:
        return []
    codes, first = _symbols(words)
    place = _places(codes, first)
    count, gram, context, lower, starts = {}, {}, {}, {}, {}
    for n in range(1, order + 1):
        h, at = _grams(codes, place, n)
        if n == 1:  # the first boundary is given, not predicted
            h, at = h[place[at] > 0], at[place[at] > 0]
        gram[n], where, count[n] = np.unique(h, return_index=True, return_counts=True)
        end = at[where]
        # the same symbols without the last and without the first
        context[n] = _hash_before(codes, end, n)
        lower[n] = _hash_tail(codes, end, n)
        starts[n] = place[end] == n - 1
    use = {}
    for n in range(1, order + 1):
        use[n] = count[n].astype(float)
        if n < order:
            left, seen = np.unique(lower[n + 1], return_counts=True)
            i = np.searchsorted(left, gram[n])
            i[i == len(left)] = 0
            kinds = np.where(left[i] == gram[n], seen[i], 0)
            use[n] = np.where(starts[n] & (n > 1), use[n], np.maximum(kinds, 1)).astype(float)
    out, below = [], None
    for n in range(1, order + 1):
        ones, twos = (use[n] == 1).sum(), (use[n] == 2).sum()
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        ctx, inverse = np.unique(context[n], return_inverse=True)
        total = np.bincount(inverse, use[n])
        kinds = np.bincount(inverse)
        weight = discount * kinds / total
        if n == 1:
            prob = np.maximum(use[n] - discount, 0) / total[inverse] + weight[inverse] / (len(gram[n]) + 1000.0)
            out.append([n, gram[n], np.log(prob), None])
            base = float(np.log(weight[0] / (len(gram[n]) + 1000.0)))
        else:
            i = np.searchsorted(gram[n - 1], lower[n])
            prob = np.maximum(use[n] - discount, 0) / total[inverse] + weight[inverse] * np.exp(below[i])
            out.append([n, gram[n], np.log(prob), None])
            # back-off weights belong to the context's own n-gram; the initial boundary is one without a probability
            back = np.zeros(len(gram[n - 1]))
            i = np.searchsorted(gram[n - 1], ctx)
            i[i == len(gram[n - 1])] = 0
            hit = gram[n - 1][i] == ctx
            back[i[hit]] = np.log(weight[hit])
            out[-2][3] = back
        below = out[-1][2]
    out[-1][3] = np.zeros(len(gram[order]))
    out.append([0, np.zeros(1, np.uint64), np.array([base]), np.zeros(1)])
    return [tuple(x) for x in out]


def _hash_before(codes: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n - 1 symbols before ``end`` as an (n-1)-gram; 0 for the empty one."""
    if n == 1:
        return np.zeros(len(end), np.uint64)
    h = np.zeros(len(end), np.uint64)
    for k in range(n - 1, 0, -1):
        h = h * _MULT + codes[end - k] + np.uint64(1)
    return mix(h + np.uint64(n - 1))


def _hash_tail(codes: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Hash of the last n - 1 symbols, ``end`` included."""
    if n == 1:
        return np.zeros(len(end), np.uint64)
    h = np.zeros(len(end), np.uint64)
    for k in range(n - 2, -1, -1):
        h = h * _MULT + codes[end - k] + np.uint64(1)
    return mix(h + np.uint64(n - 1))


class Models:
    """The merged models: for each order sorted hashes, log probabilities and back-off weights by language.

    A language without an n-gram of the merged table has there what its interpolation gives.
    """

    def __init__(self, trained: dict[str, list]):
        self.languages = sorted(trained)
        self.order = max((n for m in trained.values() for n, *_ in m), default=0)
        self.base = np.array([next(p[0] for n, _, p, _ in trained[x] if n == 0) for x in self.languages], np.float32)
        self.keys, self.prob, self.back, self.has = {}, {}, {}, {}
        for n in range(1, self.order + 1):
            part = {x: next(m for m in trained[x] if m[0] == n) for x in self.languages}
            keys = np.unique(np.concatenate([m[1] for m in part.values()]))
            prob = np.full((len(keys), len(part)), np.nan, np.float32)
            back = np.zeros((len(keys), len(part)), np.float32)
            for j, x in enumerate(self.languages):
                i = np.searchsorted(keys, part[x][1])
                prob[i, j], back[i, j] = part[x][2], part[x][3]
            self.keys[n], self.prob[n], self.back[n] = keys, prob, back
        # Mean of held-back texts, variance between texts and variance of one symbol, by language.
        self.mean, self.between, self.within = (np.full(len(self.languages), v) for v in (0.0, np.inf, 0.0))
        self._codes: dict[str, int] = {}
        self._table = np.empty((0, len(self.languages)), np.float32)
        self._size = np.empty(0, np.float32)

    def _find(self, n: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self.keys[n]
        i = np.searchsorted(keys, h)
        i[i == len(keys)] = 0
        return i, keys[i] == h

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each word and its end, by language."""
        codes, first = _symbols(words)
        place = _places(codes, first)
        score = np.tile(self.base, (len(codes), 1))
        for n in range(1, self.order + 1):
            h, at = _grams(codes, place, n)
            if n > 1:
                i, hit = self._find(n - 1, _hash_before(codes, at, n))
                score[at[hit]] += self.back[n - 1][i[hit]]
            i, hit = self._find(n, h)
            p, at = self.prob[n][i[hit]], at[hit]
            score[at] = np.where(np.isnan(p), score[at], p)
        score[first] = 0  # the first boundary is given
        return np.add.reduceat(score, first)

    def entropies(self, texts: list[str | None], most: int = 150_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy per symbol of each text by language, and the number of symbols of its distinct words (0: no
        letter) with their cross-entropy where each is scored by its own best language.
        """
        if len(self._codes) > most:
            self._codes, self._table = {}, self._table[:0]
        code = self._codes
        known = len(code)
        rows = [[code.setdefault(w, len(code)) for w in words_of(t)] for t in texts]
        new = list(code)[known:]
        if new:
            fresh = [self.word_scores(new[a:b]) for a, b in slices([len(w) + 2 for w in new], 400_000)]
            size = np.array([len(w) + 1 for w in new], np.float32)
            fresh = np.concatenate(fresh)
            self._table = np.concatenate([self._table, fresh])
            self._size = np.concatenate([self._size[:known], size])
        total = np.zeros((len(texts), len(self.languages)))
        n, m, best = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts))
        for k, r in enumerate(rows):
            if r:
                each, count = np.unique(np.array(r), return_counts=True)
                words, size = self._table[each].astype(np.float64), self._size[each].astype(np.float64)
                total[k], n[k] = count @ words, count @ size
                best[k], m[k] = words.max(1).sum(), size.sum()
        return -total / np.maximum(n, 1)[:, None], m, -best / np.maximum(m, 1)

    def rejected(self, language: np.ndarray, n: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Whether texts of these languages, symbols and cross-entropies are unlike any; without a letter they are."""
        spread = self.between[language] + self.within[language] / np.maximum(n, 1)
        return (n == 0) | (low - self.mean[language] > DEVIATIONS * np.sqrt(spread))

    def __getstate__(self):
        return self.__dict__ | {"_codes": {}, "_table": self._table[:0]}


def train(docs: DataFrame, docs_per_language: int = 400, hold: int = 5) -> Models | None:
    """Models learned from ``docs(id, text, lang)``, rows without a language or an id left out.

    Bounds: about ``docs_per_language`` documents of each language are learned from, chosen by a
    hash of id and text; one in ``hold`` of them is held back to calibrate rejection, of which two numbers each come to
    the driver. A row for each language comes to the driver, so ``lang`` must name languages.
    """
    known = docs.where("lang is not null and text is not null and id is not null")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return None
    share = F.create_map(*[F.lit(v) for x, c in sizes.items() for v in (x, min(1.0, docs_per_language / c))])
    some = known.where(unit_hash(F.col("id"), F.col("text")) < share[F.col("lang")])
    some = materialize(some.select("lang", "text", (unit_hash(F.col("id"), F.col("text"), seed=1) * hold < 1).alias("back")), "learn")

    def fit(key, table):
        learn = table.filter(pc.invert(table["back"]))
        out = train_language(sorted((learn if learn.num_rows else table)["text"].to_pylist()))
        columns = {"lang": [key[0].as_py()] * len(out), "n": [x[0] for x in out], "keys": [x[1].tobytes() for x in out], "prob": [x[2].tobytes() for x in out], "back": [x[3].tobytes() for x in out]}
        kinds = {"lang": pa.string(), "n": pa.int64(), "keys": pa.binary(), "prob": pa.binary(), "back": pa.binary()}
        return pa.table({k: pa.array(v, kinds[k]) for k, v in columns.items()})

    rows = some.groupBy("lang").applyInArrow(fit, "lang string, n long, keys binary, prob binary, back binary").collect()
    trained: dict[str, list] = {}
    for r in rows:
        trained.setdefault(r["lang"], []).append((r["n"], np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["prob"]), np.frombuffer(r["back"])))
    if not trained:
        discard(some)
        return None
    models = Models(trained)
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def score(batches):
        for batch in small_batches(batches, "text"):
            _, n, low = shared.value.entropies(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(n), pa.array(low)], ["lang", "n", "low"])

    held = some.where("back").select("lang", "text").mapInArrow(score, "lang string, n double, low double").collect()
    for j, x in enumerate(models.languages):
        n, low = np.array([(r["n"], r["low"]) for r in held if r["lang"] == x and r["n"] >= 20]).reshape(-1, 2).T
        if len(n) >= 5:
            off = (low - low.mean()) ** 2
            models.mean[j], models.between[j] = low.mean(), off.mean()
            models.within[j] = (off * n)[n <= np.median(n)].mean()
    discard(some)
    return models


def _predict(models, sharpness: float):
    def run(batches):
        m = models.value
        for batch in small_batches(batches, "text"):
            texts = batch.column("text").to_pylist()
            for a, b in slices([len(t) if t else 0 for t in texts]):
                if m is None:
                    lang, score, reject = [UNKNOWN] * (b - a), [0.0] * (b - a), [True] * (b - a)
                else:
                    h, n, low = m.entropies(texts[a:b])
                    best = h.argmin(1)
                    odds = np.exp(-sharpness * (h - h.min(1)[:, None]))
                    none = n == 0  # no letter
                    lang = [UNKNOWN if z else m.languages[k] for z, k in zip(none, best)]
                    score = np.where(none, 0.0, 1 / odds.sum(1))
                    reject = m.rejected(best, n, low)
                keep = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(keep.columns + [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(reject, pa.bool_())], [*keep.schema.names, "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, learn_mod: int = 4, hold_out: int = 2, sharpness: float = 8.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: (doc_id, text, lang, held_out, lang_pred, score, rejected).

    Learned from rows with text and language whose crc32 of the id is not ``hold_out`` modulo
    ``learn_mod``. ``lang_pred`` is a learned language, or ``und`` where the text is null or has no
    letter or nothing could be learned; ``score`` is the winner's share in [0, 1] (0 for ``und``);
    ``rejected`` marks ``und`` and texts too unlike their language. Whole texts are scored; copies,
    repeated rows and equal scores give equal results (ties go to the first language by name). Rows with
    a null id are predicted too and count as not held out. Texts of any length are scored whole. Further columns are ignored; an
    empty table gives an empty result.
    """
    given = pick(docs, id_col, text_col, lang_col).toDF("id", "text", "lang")
    held = F.coalesce(bucket_of(F.col("id"), learn_mod) == hold_out, F.lit(False))
    models = given.sparkSession.sparkContext.broadcast(train(given.where(~held)))
    rows = given.select(F.col("id").cast("long").alias("doc_id"), "text", "lang", held.alias("held_out"))
    return rows.mapInArrow(_predict(models, sharpness), "doc_id long, text string, lang string, held_out boolean, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, learn_mod: int = 4, hold_out: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents that ``identify`` does not reject, with all their columns, in one pass over the texts.

    Null texts and those without a letter go; repeated rows stay as often as given, rows with a null id are judged like
    others; where nothing could be learned all go; an empty table gives an empty result.
    """
    given = pick(docs, id_col, text_col, lang_col).toDF("id", "text", "lang")
    held = F.coalesce(bucket_of(F.col("id"), learn_mod) == hold_out, F.lit(False))
    models = docs.sparkSession.sparkContext.broadcast(train(given.where(~held)))
    names = docs.columns
    flat = [f"_c{i}" for i in range(len(names))]
    at = names.index(text_col)

    def run(batches):
        for batch in small_batches(batches, flat[at]):
            texts = pa.RecordBatch.from_arrays([batch.column(at)], ["text"])
            keep = [not v for part in _predict(models, 8.0)([texts]) for v in part.column("rejected").to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    kept = StructType([StructField(f, k.dataType) for f, k in zip(flat, docs.schema)])
    return docs.toDF(*flat).mapInArrow(run, kept).toDF(*names)
