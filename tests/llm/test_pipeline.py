"""The pipeline stage by stage against plain Python."""

import random
import re

import pytest

from lexmill.llm import mixing

pytest.importorskip("public_tokenizers")

SOUNDS = {"en": ["th", "he", "in", "er", "a"], "de": ["sch", "ei", "en", "ge", "ü"]}


def talk(rng, sounds, n):
    return " ".join("".join(rng.choice(sounds) for _ in range(rng.randrange(2, 6))) for _ in range(n))


def shingles(text, k=5):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    items = [talk(rng, SOUNDS["en"], 25) for _ in range(3)]
    rows = [(i, talk(rng, SOUNDS[x], rng.choice([30, 60, 120])), x, rng.choice(["s1", "s2", None])) for i, x in enumerate(rng.choice(list(SOUNDS)) for _ in range(120))]
    for i in range(0, 30, 3):  # near copies
        w = rows[i][1].split()
        w[-1] = "changed"
        rows.append((200 + i, " ".join(w), rows[i][2], rows[i][3]))
    rows += [(300 + i, rows[i][1][:150] + "\n" + items[i] + "\n" + rows[i][1][150:300], "en", "s1") for i in range(3)]
    rows += [(400, "12345 !!! ???", "en", "s1"), (401, None, "en", "s1"), (402, "", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as long) as n_chars")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {i: t for i, t, *_ in rows}

    def go(name, df):
        out = stages[name](spark, df, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    docs = go("language identification", docs)
    kept = {i: t for i, t in kept.items() if t and re.search(r"[^\W\d_]", t)}
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == kept and docs.columns == df.columns

    docs = go("n-gram Jaccard join", docs)
    sets, low = {i: shingles(t) for i, t in kept.items()}, {}
    for i in sorted(sets):
        near = [low[j] for j in low if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
        low[i] = min([i, *near])
    kept = {i: t for i, t in kept.items() if low[i] == i}
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == kept and docs.columns == df.columns

    docs = go("benchmark decontamination", docs)
    kept = {i: t for i, t in kept.items() if not any(x in t for x in items)}
    assert {r["doc_id"] for r in docs.collect()} == set(kept) and docs.columns == df.columns

    docs = go("source mixing", docs)
    assert docs.columns == df.columns
    source, names = {i: s for i, _, _, s in rows}, ["s1", "s2", None]
    goal = mixing.targets([sum(len(t.split()) for i, t in kept.items() if source[i] == n) for n in names], [5, 2, 1])
    for n, g in zip(names, goal):
        assert sum(len(r["text"].split()) for r in docs.collect() if r["source"] == n) == round(g)

    out = go("token output", docs)
    got = sorted(out.collect(), key=lambda r: r["start"])
    assert [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:k]) for k in range(len(got))]
    assert sorted(r["doc_id"] for r in docs.collect()) == [r["doc_id"] for r in got]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(got)


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls in every column, blank and long texts, repeated rows, clashing column names and empty tables, through each stage."""
    import corpus_pipeline

    rng = random.Random(2)
    rows = [(i, talk(rng, SOUNDS["en"], 30), "en", "s1", 1) for i in range(30)]
    rows += [(50, rows[0][1] + " more", None, None, None), (51, rows[3][1], "en", "s2", 1), (51, rows[3][1], "en", "s2", 1), (None, talk(rng, SOUNDS["en"], 30), "en", "s1", 1), (None, None, None, None, None)]
    rows += [(60, "", "en", "s1", 0), (61, "word " * 20000, "en", "s1", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, "an item that no text holds at all"), (None, "x"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    plain = spark.createDataFrame(rows, schema)
    odd = plain.selectExpr("*", "doc_id as DOC_ID", "lang as Lang", "'kept' as note")
    names = odd.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, str(tmp_path))
        assert out.columns == names, name
        got = [tuple(r) for r in out.collect()]
        assert got and all(r[5] == r[0] and r[6] == r[2] and r[7] == "kept" for r in got), name
        assert stage(spark, odd.limit(0), str(tmp_path)).count() == 0, name
        if name == "language identification":
            assert sorted((r[0] for r in got), key=str) == sorted((i for i, t, *_ in rows if t), key=str)
        if name == "n-gram Jaccard join":
            assert sorted((r[0] for r in got), key=str) == sorted({i for i, *_ in rows if i not in (None, 50, 51)} | {None}, key=str) + [None]
        if name == "benchmark decontamination":
            assert len(got) == len(rows)
    out = corpus_pipeline.STAGES[-1][1](spark, odd, str(tmp_path))
    assert out.count() == len(rows) and corpus_pipeline.STAGES[-1][1](spark, odd.limit(0), str(tmp_path)).count() == 0
