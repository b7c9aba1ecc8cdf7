"""Ranked search against scoring every document, on ties, copies, odd tables, and range maxima."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lexmill.llm import lexical_search as X

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def model(docs, queries, k=10):
    rows = [(d, Counter(t), len(t)) for d, t in ((d, terms(t)) for d, t in docs) if t]
    n_docs, n_terms = len(rows), sum(n for *_, n in rows)
    df = Counter(t for _, c, _ in rows for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * f + 1))) for t, f in df.items()}
    out = []
    for item, text in dict.fromkeys(queries):
        asked, found = Counter(terms(text)), []
        for d, c, n in rows:
            m = 25 + 75 * n * n_docs // n_terms
            score = sum(r * weight[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, r in asked.items() if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, i, None if null else d, -s) for i, (s, null, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def collected(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def corpus(seed):
    rng = random.Random(seed)
    voc = ["the", "The", "of", "Ä", "ä", "it's", "x-ray", "naïve", "３", "日本"] + [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(voc, [1 / (k + 1) for k in range(len(voc))], k=rng.randrange(60)))) for i in range(300)]
    docs += [(1000 + i, "the copy of a w1 text w2 w3") for i in range(200)] + [(None, "w1 w2 null id"), (5, docs[5][1]), (5, docs[5][1]), (900, None), (901, ""), (902, " .,; "), (903, "the " * 30_000)]
    rng.shuffle(docs)
    queries = [(i, " ".join(rng.choices(voc, k=rng.randrange(1, 12)))) for i in range(25)]
    queries += [(90, "copy of w1 text"), (91, "nowhere"), (92, ""), (93, None), (94, "?!"), (None, "w1 w2"), (95, "the the the"), (95, "the the the"), (96, "w4"), (96, "w5")]
    return docs, queries


@pytest.mark.parametrize(("seed", "tiny"), [(1, False), (2, True)])
def test_against_all_documents(spark, monkeypatch, seed, tiny):
    if tiny:  # many shards, one interval at a time, many blocks of queries
        for name, n in {"SHARD_POSTINGS": 300, "AT_ONCE": 1, "BLOCK_CHARS": 200}.items():
            monkeypatch.setattr(X, name, n)
    docs, queries = corpus(seed)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).selectExpr("doc_id", "text", "1 as n", "'x' as score", "0 as `Doc_ID`")
    q = spark.createDataFrame(queries, "item_id long, text string").selectExpr("item_id", "text", "2 as rank", "'q' as query")
    assert collected(X.ranked(d, q)) == model(docs, queries)


def test_empty(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert X.ranked(none, items).collect() == []
    assert X.ranked(one, items.limit(0)).collect() == []
    assert collected(X.ranked(one, items)) == model([(1, "a b")], [(1, "a")])


def test_range_maxima_and_few_documents_scored():
    rng = np.random.default_rng(3)
    term, doc = np.divmod(rng.choice(8 * 4000, 6000, replace=False), 4000)
    impact = (rng.pareto(1.2, len(term)) * 1000).astype(np.int64) + 1
    shard = X.Shard(4000, 8, term, doc, impact)
    a = rng.integers(0, len(term), 500)
    b = np.minimum(len(term), a + rng.integers(0, int(np.diff(shard.first).max()), 500))
    place, peak = shard.peaks(a, b)
    for i, j, p, v in zip(a, b, place, peak):
        part = shard.impact[i:j]
        assert v == (part.max() if j > i else 0) and (j == i or p == i + part.argmax())
    best = X.Best(10)
    scored = X.search_shard(shard, np.arange(8), np.ones(8, np.int64), [(False, i) for i in range(4000)], best)
    total = np.bincount(doc, impact, 4000)
    assert [-s for s, *_ in best.rows] == sorted(total.astype(int).tolist(), reverse=True)[:10] and scored < 1000
