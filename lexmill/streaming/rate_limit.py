"""Sliding-log rate limit by key, for tables and streams of requests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql import functions as F

from ..plans.stages import stage


def admit(times: list[int], held: list[int], limit: int, window_ms: int) -> tuple[list[bool], list[int]]:
    """(verdicts, accepted times still in the window) for ordered ``times`` after the accepted times ``held``.

    A request passes if fewer than ``limit`` accepted ones lie less than ``window_ms`` before it; denied ones do not count.
    """
    out = []
    for now in times:
        held = [t for t in held if now - t < window_ms]
        out.append(len(held) < limit)
        if out[-1]:
            held = [*held, now]
    return out, held


def client_key(forwarded):
    """The first forwarded address, else "local"."""
    first = F.trim(F.element_at(F.split(forwarded, ","), 1))
    return F.when(first != "", first).otherwise("local")


def stretches(requests: DataFrame, window_ms: int) -> DataFrame:
    """Requests ``(key, ts_ms, id)`` with ``stretch``, the time at which the key's run of requests without a gap of ``window_ms`` begins.

    After such a gap no accepted request lies in the window, so stretches do not depend on each other. Requests are dealt out by
    ranges of key and time; a range hands on the key's last request and the start of its last stretch, so a busy key is many
    tasks.
    """
    dealt = stage(requests.select("key", "ts_ms", "id").repartitionByRange("key", "ts_ms", "id").withColumn("part", F.spark_partition_id()))
    within = Window.partitionBy("key", "part").orderBy("ts_ms", "id")
    parts = Window.partitionBy("key").orderBy("part")

    def with_parts(rows: DataFrame, ends: DataFrame) -> DataFrame:
        ends = ends.withColumnsRenamed({"key": "_key", "part": "_part"})
        return rows.join(ends, F.col("key").eqNullSafe(F.col("_key")) & (F.col("part") == F.col("_part"))).drop("_key", "_part")

    ends = dealt.groupBy("key", "part").agg(F.max("ts_ms").alias("end")).select("key", "part", F.lag("end").over(parts).alias("end_before"))
    before = F.coalesce(F.lag("ts_ms").over(within), F.col("end_before"))
    rows = with_parts(dealt, ends).withColumn("before", before)
    rows = stage(rows.withColumn("start", F.when(F.col("before").isNull() | (F.col("ts_ms") - F.col("before") >= window_ms), F.col("ts_ms"))).drop("before", "end_before"))
    earlier = parts.rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("key", "part").agg(F.max("start").alias("start")).select("key", "part", F.last("start", True).over(earlier).alias("start_before"))
    so_far = F.last("start", True).over(within.rowsBetween(Window.unboundedPreceding, 0))
    return with_parts(rows, starts).select("key", "ts_ms", "id", F.coalesce(so_far, F.col("start_before")).alias("stretch"))


def rate_limit(requests: DataFrame, limit: int = 12, window_ms: int = 60_000) -> DataFrame:
    """Rows ``(key, ts_ms, id)`` with ``allowed``, by key in order of time and id.

    The stretches of a key go to tasks of their own, sorted by Spark, and pass through in batches: between them only the accepted
    times of the last window are held, ``limit`` at most. A stretch itself is one task, as each verdict needs those before it.
    """
    dealt = stretches(requests, window_ms).repartition("key", "stretch").sortWithinPartitions("key", "stretch", "ts_ms", "id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []
        for pdf in frames:
            verdicts = []
            for k, part in pdf.groupby(["key", "stretch"], sort=False, dropna=False):
                if k != at:
                    at, held = k, []
                got, held = admit(part["ts_ms"].tolist(), held, limit, window_ms)
                verdicts += got
            yield pdf.drop(columns="stretch").assign(allowed=verdicts)

    return dealt.mapInPandas(run, "key string, ts_ms long, id long, allowed boolean")


class Limiter(StatefulProcessor):
    """Keeps the accepted times of a key's last window; a timer drops a key that has been idle that long."""

    def __init__(self, limit: int = 12, window_ms: int = 60_000):
        self.limit, self.window_ms = limit, window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "times array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["ts", "id"])
        ms = (pdf["ts"].astype("int64") // 1_000_000 if str(pdf["ts"].dtype).startswith("datetime64[ns") else pdf["ts"].astype("datetime64[ms]").astype("int64")).tolist()
        held = list(self.held.get()[0]) if self.held.exists() else []
        got, held = admit(ms, held, self.limit, self.window_ms)
        self.held.update((held,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(ms[-1] + self.window_ms)
        yield pd.DataFrame({"key": key[0], "id": pdf["id"].to_numpy(), "allowed": got})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def rate_limit_stream(requests: DataFrame, limit: int = 12, window_ms: int = 60_000, delay: str = "10 seconds") -> DataFrame:
    """A stream ``(key, ts timestamp, id)`` to (key, id, allowed); rows older than the watermark are dropped."""
    keyed = requests.withWatermark("ts", delay).groupBy("key")
    return keyed.transformWithStateInPandas(Limiter(limit, window_ms), outputStructType="key string, id long, allowed boolean", outputMode="Append", timeMode="EventTime")
