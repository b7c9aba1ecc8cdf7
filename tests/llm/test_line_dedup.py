"""Line deduplication against a quadratic model."""

import random

import pytest

from lexmill.llm.line_dedup import MIN_WORDS, deduplicate_lines


def near(x, y):
    """Word edit distance of at most one, by dynamic programming."""
    if x == y:
        return True
    if min(len(x), len(y)) < MIN_WORDS:
        return False
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        new = [i]
        for j, b in enumerate(y, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return row[-1] <= 1


def model(docs):
    lines = sorted((float("-inf") if d is None else d, t, k, tuple(x.lower().split())) for d, t in set(docs) if t is not None for k, x in enumerate(t.split("\n")))
    lines = [x for x in lines if x[3]]
    gone = {}
    for i, (d, t, k, w) in enumerate(lines):
        if any((e, v) != (d, t) and e != d and near(w, u) or (e, v) == (d, t) and near(w, u) for e, v, _, u in lines[:i]):
            gone.setdefault((d, t), set()).add(k)
    out = []
    for d, t in docs:
        drop = gone.get((float("-inf") if d is None else d, t), set())
        out.append((d, t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop), 0 if t is None else t.count("\n") + 1, len(drop)))
    return out


def test_against_model(spark):
    rng = random.Random(11)
    voc = [f"w{i}" for i in range(30)]
    base = [[rng.choice(voc) for _ in range(rng.choice([1, 2, 4, 5, 6, 9, 20, 60]))] for _ in range(40)]
    docs = []
    for i in range(120):
        lines = []
        for _ in range(rng.randrange(5)):
            x = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                how, p = rng.random(), rng.randrange(len(x))
                if how < 0.4:
                    x[p] = rng.choice(voc)
                elif how < 0.7 and len(x) > 1:
                    del x[p]
                else:
                    x.insert(p, rng.choice(voc))
            lines.append(" ".join(x) if rng.random() < 0.8 else "  " + "\t".join(x).upper())
        docs.append((i, "\n".join(lines)))
    docs += [(None, " ".join(base[7])), (500, None), (501, ""), (502, "\n \n"), (3, docs[3][1])]
    rng.shuffle(docs)
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, TEXT string")
    got = sorted((tuple(r) for r in deduplicate_lines(df).collect()), key=str)
    assert got == sorted(model(docs), key=str)
    assert any(r[3] for r in got)


def test_empty_table(spark):
    assert deduplicate_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("n", [4096, 5000])
def test_very_long_lines(spark, n):
    x = [f"a{i}" for i in range(n)]
    y = [*x[:1000], "other", *x[1001:]]
    df = spark.createDataFrame([(1, " ".join(x)), (2, " ".join(y))], "doc_id long, text string")
    assert [r["n_dropped"] for r in deduplicate_lines(df).orderBy("doc_id").collect()] == [0, 1]
