"""Support of quotes by the word index of a context against plain containment."""

import random

from pyspark.sql import functions as F

from lexmill.functions import text as X


def plain(q, c):
    w = q.split(" ")
    grams = [q] if len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    return 1.0 if q == "" or q in c else sum(g in c for g in grams) / len(grams)


def test_supports_equal_containment():
    rng = random.Random(1)
    for _ in range(5000):
        words = lambda n: " ".join("".join(rng.choices("ab", k=rng.randrange(1, 4))) for _ in range(n))
        c, qs = words(rng.randrange(20)), [words(rng.randrange(6)) for _ in range(3)]
        assert X.supports(qs, c) == [plain(q, c) for q in qs]


def test_long_context_is_indexed_once():
    rng = random.Random(2)
    voc = [f"w{i}" for i in range(3000)]
    c = " ".join(rng.choices(voc, k=200_000))
    q = " ".join(rng.choices(voc, k=20_000))
    assert X.supports([q, "not there", c[1000:3000]], c)[1:] == [0.0, 1.0]


def test_arrays_of_quotes(spark):
    df = spark.createDataFrame([(["A “B” c", "x", None], "a b, C d"), ([], None), (None, "x"), (["q w e r"], None)], "q array<string>, c string")
    assert [r[0] for r in df.select(X.quote_supports(F.col("q"), F.col("c"))).collect()][:2] == [[1.0, 0.0, None], []]
