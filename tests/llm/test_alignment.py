"""Aligned tokens against an alignment of each text on its own, counts in memory, and the perfect hash."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from lexmill.llm import alignment as X

A, B = str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model"))
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def model(rows):
    """Every text encoded whole; links by walking over both lists of spans."""
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    name, at = {i: n for n, i in a.get_vocab().items()}, X.byte_table()

    def spans(parts):
        end = np.cumsum([0, *map(len, parts)]).tolist()
        return list(zip(end, end[1:]))

    counts, found = Counter(), []
    for _, text in rows:
        x, y, raw = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or ""), (" " + (text or "")).encode()
        p = [bytes(at[c] for c in name[i]) for i in x]
        q = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if not text or b"".join(p) != raw or b"".join(q) != raw:
            found.append(None)
            continue
        links, i, j = [], 0, 0
        p, q = spans(p), spans(q)
        while i < len(x) and j < len(y):
            links.append((x[i], y[j]))
            last = p[i][1], q[j][1]
            i, j = i + (last[0] <= last[1]), j + (last[1] <= last[0])
        counts.update(links)
        groups, i, j = [], 0, 0
        for end in sorted({e for _, e in p} & {e for _, e in q}):
            k, m = [e for _, e in p].index(end) + 1, [e for _, e in q].index(end) + 1
            groups.append(",".join(map(str, x[i:k])) + "|" + ",".join(map(str, y[j:m])))
            i, j = k, m
        found.append((len(x), len(y), groups, links))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for (doc, _), f in zip(rows, found):
        if f is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
        else:
            x, y, groups, links = f
            digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
            out.append((doc, x, y, len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), digest))
    return sorted(out, key=str)


def texts():
    rng = random.Random(4)
    voc = ["The", "the", "parliament", "étaient", "über", "x1y2", "don't", "I'll", "(a)", "...", "foo_bar", "Ⅳ", "日本語", "नमस्ते", "😀", "3,14", "<|endoftext|>", "</s>", "<0x41>", "a\nb", "end.\nStart", "q\n\nr", "ß", "ﬁ", " ", "naïve."]
    seps = [" "] * 12 + ["\n", "  ", "\t", "   ", " \n", "\n "]
    out = ["".join(rng.choice(voc) + rng.choice(seps) for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    out += [None, "", " ", "\n", "   lead", "trail  ", "no ▁ here", "ok ▁", "a", "\x00 nul", "\r\n x", "é", "long" * 4000, "word " * 3000, out[0], out[0]]
    return out


@pytest.mark.parametrize("scarce", [False, True])
def test_against_whole_texts(spark, monkeypatch, scarce):
    if scarce:  # most pairs by the join, many buckets, a deep tree
        for name, n in {"LOOKUP_PAIRS": 40, "BUCKET_PAIRS": 30, "LEAF_ROWS": 20, "FAN": 2, "HELD_PAIRS": 50}.items():
            monkeypatch.setattr(X, name, n)
    rows = [(None if i % 9 == 5 else i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).selectExpr("doc_id", "text", "1 as n", "'p' as pair", "0 as part", "'x' as `Text`", "0 as row")
    got = X.aligned(df, A, B)
    assert got.columns == COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=str) == model(rows)


def test_small_cache_gives_the_same(monkeypatch):
    import pyarrow as pa

    one, many = X.Stretches(A, B, most=5), X.Stretches(A, B)
    for t in texts():
        if one.full():
            one.clear()
        for s in (one, many):
            s.got = [s.table()[code].tolist() + s.pairs_of(code)[0].tolist() for code, _ in [s(pa.array([t], pa.string()), True)]]
        assert one.got == many.got


def test_empty(spark):
    assert X.aligned(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 5000):
        keys = np.unique(rng.integers(0, 1 << 47, 2 * n))[:n]
        rng.shuffle(keys)
        buckets, rows, order = 3, [], []
        for b in range(buckets):
            part = keys[X.bucket_of(keys, buckets) == b]
            if len(part):
                words, bits, slot = X.place(part)
                assert sorted(slot.tolist()) == list(range(len(part)))
                rows.append((b, words.tobytes(), bits.tobytes()))
                order.append(part[np.argsort(slot)])
        index = X.PairHash(buckets, rows)
        kept = np.concatenate(order) if order else keys
        if n:
            assert np.array_equal(kept[index(keys)], keys)
            other = np.setdiff1d(rng.integers(0, 1 << 47, 1000), keys)
            slot = index(other)
            assert ((slot == -1) | (kept[np.maximum(slot, 0)] != other)).all()
