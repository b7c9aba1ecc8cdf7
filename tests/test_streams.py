"""Rate limit as a table and as a stream; questions planned from a stream."""

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from lexmill.streaming.rate_limit import admit, client_key, rate_limit, rate_limit_stream, stretches


def test_admit_against_model():
    rng = random.Random(3)
    for _ in range(200):
        times, accepted, want = sorted(rng.randrange(2000) for _ in range(rng.randrange(40))), [], []
        for t in times:
            ok = sum(t - a < 300 for a in accepted) < 3
            want.append(ok)
            accepted += [t] * ok
        assert admit(times, [], 3, 300)[0] == want
        cut = rng.randrange(len(times) + 1)
        first, held = admit(times[:cut], [], 3, 300)
        assert first + admit(times[cut:], held, 3, 300)[0] == want and len(held) <= 3


def test_table_equals_stream(spark, tmp_path):
    rng, t0 = random.Random(5), datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = [(rng.choice("abc"), t0 + timedelta(seconds=rng.randrange(300)), i) for i in range(200)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, id long")
    batch = {r["id"]: r["allowed"] for r in rate_limit(df.withColumn("ts_ms", F.unix_millis("ts")), 4, 60_000).collect()}
    assert len(batch) == 200 and not all(batch.values())
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = rate_limit_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), 4, 60_000)
    q = stream.writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["id"]: r["allowed"] for r in spark.table("limited").collect()} == batch


def test_busy_key_is_many_tasks(spark):
    rng, rows, t = random.Random(8), [], 0
    for i in range(3000):
        t += rng.choice([0, 1, 7, 50, 299, 300, 301, 5000])
        rows.append(("hot" if rng.random() < 0.9 else rng.choice(["a", None]), t, i))
    df = spark.createDataFrame(rows, "key string, ts_ms long, id long").repartition(4)
    got = rate_limit(df, 3, 300)
    want = {}
    for k in {r[0] for r in rows}:
        mine = sorted((t, i) for key, t, i in rows if key == k)
        want |= dict(zip((i for _, i in mine), admit([t for t, _ in mine], [], 3, 300)[0]))
    assert {r["id"]: r["allowed"] for r in got.collect()} == want
    spread = stretches(df, 300).where("key = 'hot'").groupBy("stretch").count()
    assert spread.count() > 100 and spread.agg(F.max("count")).first()[0] < 500
    assert rate_limit(df.limit(0)).count() == 0


def test_client_key(spark):
    df = spark.createDataFrame([("1.2.3.4, 5.6.7.8",), ("",), (None,)], "x string")
    assert [r[0] for r in df.select(client_key(F.col("x"))).collect()] == ["1.2.3.4", "local", "local"]


def test_planned_stream(spark, tmp_path):
    from lexmill import schemas
    from lexmill.operators.index import write_index
    from lexmill.streaming.questions import plan_stream

    chunks = spark.createDataFrame([(0, "b", "Book", 1, None, None, None, ["21"], "Life", [], "article", "No person shall be deprived of life", "Book\nNo person shall be deprived of life")], schemas.CHUNK)
    spark.createDataFrame([(1, "What is Article 21?"), (2, "hello")], "query_id long, question string").coalesce(1).write.parquet(f"{tmp_path}/q")
    stream = spark.readStream.schema("query_id long, question string").parquet(f"{tmp_path}/q")
    write_index(chunks, f"{tmp_path}/index")
    plan_stream(stream, f"{tmp_path}/index", f"{tmp_path}/log", f"{tmp_path}/cp").awaitTermination()
    assert {r["query_id"]: r["kind"] for r in spark.read.json(f"{tmp_path}/log").collect()} == {1: "answer", 2: "canned"}


def test_turns_of_earlier_runs_are_history(spark, tmp_path):
    import json

    from lexmill.streaming.questions import with_history

    schema = "conv_id long, turn long, role string, content string, query_id long"
    runs = [[(1, 0, "user", "first", 10), (1, 1, "assistant", None, None), (2, 0, "user", "other", 20), (1, 2, "system", "no turn", None)], [(1, 4, "user", "third", 12), (1, 3, "user", "second", 11)], [(1, k, "user", f"turn {k}", k + 100) for k in range(5, 14)]]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for rows in runs:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = with_history(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        out.writeStream.format("json").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = {r["query_id"]: [(t["role"], t.asDict().get("content")) for t in r["history"]] for r in spark.read.schema(f"query_id long, question string, history array<struct<role:string,content:string>>").json(f"{tmp_path}/out").collect()}
    assert got[10] == [] and got[20] == [] and got[11] == [("user", "first"), ("assistant", None)] and got[12] == [*got[11], ("user", "second")]
    assert got[113] == [("user", f"turn {k}") for k in range(7, 13)] and json.dumps(got)
