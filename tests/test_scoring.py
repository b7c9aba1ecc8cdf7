"""Questions scored over blocks of a stored index against a row for each posting; what the index stores."""

import random

import pytest
from pyspark.sql import functions as F

from lexmill import schemas
from lexmill.functions import text as X
from lexmill.functions.fast_tokens import Vocabulary
from lexmill.operators import index as I
from lexmill.operators import lexical as L
from lexmill.operators import retrieval as R
from lexmill.operators import scoring

WORDS = "harbour ferries captain lantern mooring tides sailor voyaging council chart bay quay berths master ordered the of 21a".split()


def make(spark, rows):
    full = [(i, "b", "Book", 1, None, "Part I", None, [], "Title", ["7", "21A"], "text", text, f"Part I\n{text}") for i, text in rows]
    return spark.createDataFrame(full, schemas.CHUNK)


@pytest.fixture()
def index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "BLOCK_TOKENS", 400)
    monkeypatch.setattr(I, "BATCH_POSTINGS", 50)
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randrange(1, 60)))) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(50)]
    first = I.write_index(make(spark, rows), str(tmp_path / "index"))
    return first, I.merge(first, make(spark, [(i, "harbour " + t) for i, t in rows[:40]] + rows[40:] + [(900, "rare harbour")]), removed=spark.createDataFrame([(311,)], "chunk_id long"))


def test_blocks_score_as_postings_do(spark, index, monkeypatch):
    rng = random.Random(8)
    questions = [" ".join(rng.choices(WORDS, k=rng.randrange(1, 12))) for _ in range(40)] + ["harbour", "unseen", "the", "rare"]
    terms = L.query_terms(spark.createDataFrame(list(enumerate(questions)), "query_id long, question string"))
    for at in index:
        weighted = L.weighted_terms(terms, at.frequencies(terms.select("term").distinct()), at.stats)
        want = sorted(tuple(r) for r in L.scored(weighted, at.postings(), k=7).select("query_id", "chunk_id", "score", "rank").collect())
        for rows, postings in ((2_000_000, 5_000_000), (60, 200)):
            monkeypatch.setattr(scoring, "TERM_ROWS", rows)
            monkeypatch.setattr(scoring, "SHARD_POSTINGS", postings)
            got = sorted(tuple(r) for r in scoring.scored(weighted, at, k=7).select("query_id", "chunk_id", "score", "rank").collect())
            assert got == want  # to the last place
    assert scoring.scored(weighted.where("false"), at).count() == 0


def test_questions_make_no_row_for_each_posting(spark, index):
    """Postings are stored, dealt and scored in rows of arrays; a row for each that a question meets filled the disk."""
    first, _ = index
    rows, postings = first._rows("postings").count(), first.postings().count()
    assert rows < postings / 2
    got = first._rows("postings").groupBy("block").agg(F.count("*")).count()
    assert got > 3
    planned, selected = R.retrieve(spark.createDataFrame([(q, "harbour captain council") for q in range(20)], "query_id long, question string"), first)
    assert planned.count() == 20 and {r["n"] for r in selected.groupBy("query_id").agg(F.count("*").alias("n")).collect()} <= {7, *range(1, 7)}


def test_tokens_in_python_are_those_of_the_column(spark):
    rng = random.Random(3)
    odd = ["", "The Ties of BEEs", "İstanbul K ÅNGSTRÖM Σίσυφος", "21As 4ments abcका सं", "a bb ccc dddd eeees ments aments goings wedly", "x\ty zed\nharbour-master’s"]
    texts = odd + ["".join(rng.choices("abies mentgdly 129Éक’-\n", k=200)) for _ in range(200)]
    v = Vocabulary()
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(F.lower("t").alias("low"), X.tokens(F.col("t")).alias("toks")).collect()
    place, number = v.numbers([r["low"] for r in rows])
    for i, r in enumerate(rows):
        assert [v.stems[j] for j in number[place == i]] == r["toks"]


def test_selection_in_passes(spark, index, monkeypatch):
    first, _ = index
    asked = spark.createDataFrame([(q, w) for q, w in enumerate(WORDS[:15])], "query_id long, question string")
    want = sorted(map(str, R.retrieve(asked, first)[1].collect()))
    monkeypatch.setattr(R, "SET_WORDS", 60)
    assert sorted(map(str, R.retrieve(asked, first)[1].collect())) == want and want


def test_benchmark_items_and_plans_read_postings_by_blocks(spark, monkeypatch):
    """Neither makes a row for each posting that a question meets."""
    from lexmill.plans.registry import QUERIES

    for name in ("scored", "bounded"):
        monkeypatch.setattr(L, name, lambda *a, **b: pytest.fail("postings met one by one"))
    assert QUERIES["bm25_bounded"](spark, "/root/testdata/sf0.001").count() > 0
