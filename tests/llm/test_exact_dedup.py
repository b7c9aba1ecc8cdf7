"""Exact duplicates against grouping in memory, over loads, sessions and odd tables."""

import hashlib
import random
from collections import defaultdict

import pytest

from lexmill.llm import exact_dedup as X

SCHEMA = "doc_id long, text string"


def model(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        left = 1
        for i in ids:
            kept = i == keep and left == 1
            left -= kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def collected(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


@pytest.mark.parametrize("loads", [1, 4])
def test_against_groups(spark, loads):
    rng = random.Random(loads)
    rows = [(rng.choice([None, *range(400)]), rng.choice(["hot"] * 30 + [None, "", " ", "Hot", "é", "é", "w " * 50_000] + [f"t{k}" for k in range(60)])) for _ in range(600)]
    rows += rows[:40] + [(None, "only without ids"), (None, "only without ids")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id", "text", "'x' as keep_id", "1 as n", "'d' as digest", "0 as `Doc_Id`")
    assert collected(X.deduplicate(df, loads=loads)) == model(rows)


def test_empty(spark):
    assert X.deduplicate(spark.createDataFrame([], SCHEMA)).collect() == []


def test_many_copies_of_one_row(spark, monkeypatch):
    monkeypatch.setattr(X, "COPIES", 7)
    rows = [(5, "same")] * 100 + [(6, "other")] * 7
    assert collected(X.deduplicate(spark.createDataFrame(rows, SCHEMA))) == model(rows)


def test_index_lasts_and_loads_are_added_once(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, f"t{rng.randrange(150)}") for i in range(500)]
    path, seen = str(tmp_path / "index"), set()
    for k in range(3):
        part = rows[k::3]
        digests = X.digest_rows(spark.createDataFrame(part, SCHEMA))
        index = X.open_index(spark, path, 150)
        new = {r["digest"] for r in X.unseen(X.grouped(digests), index).collect()}
        want = {hashlib.sha256(t.encode()).digest() for _, t in part}
        assert new == want - seen
        seen |= want
        X.add_load(digests, index, f"day {k}")
        before = spark.table(index).count()
        X.add_load(digests, index, f"day {k}")
        assert spark.table(index).count() == before
        # A session that knows nothing of the table finds it by its folder.
        spark.sql(f"drop table {index}")
    index = X.open_index(spark, path)
    all_rows = X.digest_rows(spark.createDataFrame(rows, SCHEMA))
    assert collected(X.resolve(all_rows, index)) == model(rows)
    small = X.compact(spark, path, str(tmp_path / "compacted"), buckets=4)
    assert spark.table(small).count() == len(seen)
    assert collected(X.resolve(all_rows, small)) == model(rows)


def test_the_index_is_not_shuffled(spark, tmp_path):
    index = X.open_index(spark, str(tmp_path / "index"), 10)
    rows = X.digest_rows(spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA))
    X.add_load(rows, index, "one")
    groups = spark.createDataFrame([(bytes(32), 1, 1)], "digest binary, keep_id long, n long")
    plan = X.unseen(groups, index)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1
