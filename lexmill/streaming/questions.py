"""Turns of a stream of conversations, with the turns before each question, planned against a stored index."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from .. import schemas
from ..operators.index import open_index
from ..operators.retrieval import plan_kind, retrieve
from ..sources.io import answer_log

#: Turns of a conversation that are held.
HELD_TURNS = 6


class Turns(StatefulProcessor):
    """Keeps the last turns of a conversation and gives each question those before it."""

    def __init__(self, held: int, idle_ms: int | None):
        self.most, self.idle_ms = held, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getValueState("turns", "turns string", ttlDurationMs=self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = json.loads(self.turns.get()[0]) if self.turns.exists() else []
        out = []
        for r in pd.concat(list(rows)).sort_values("turn").itertuples():
            if not pd.isna(r.query_id):
                out.append((int(r.query_id), r.content, json.dumps(held)))
            held = [*held, {"role": r.role, "content": r.content}][-self.most :]
        self.turns.update((json.dumps(held),))
        yield pd.DataFrame(out, columns=["query_id", "question", "history"])

    def close(self) -> None:
        pass


def with_history(turns: DataFrame, held: int = HELD_TURNS, idle_ms: int | None = None) -> DataFrame:
    """A stream ``(conv_id, turn, role, content, query_id)`` to (query_id, question, history) of the turns with a query_id.

    Turns of a conversation must come in order, those of one batch may be mixed. Roles other than user and assistant are left
    out. With ``idle_ms`` a conversation is forgotten after so long without a turn; such a stream goes on by processing time, so it
    needs a trigger that does too. Needs the RocksDB state store.
    """
    kept = turns.where("role in ('user', 'assistant')").select("conv_id", "turn", "role", "content", F.col("query_id").cast("double").alias("query_id"))
    out = kept.groupBy("conv_id").transformWithStateInPandas(Turns(held, idle_ms), outputStructType="query_id long, question string, history string", outputMode="Append", timeMode="ProcessingTime" if idle_ms else "None")
    return out.withColumn("history", F.from_json("history", schemas.TURN))


def plan_stream(questions: DataFrame, index_path: str, log_path: str, checkpoint: str, calls: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Plans every micro-batch of ``questions(query_id, question[, history])`` against the latest version of a stored index.

    Records go to ``log_path``, a folder for each batch, which a batch that is run again after a failure writes anew.
    ``calls(planned, selected)`` answers a batch and gives (query_id, model, ms); without it no model is called, and ``ms`` is
    the time since the batch began. A batch reads the postings and token sets that it asks for, no text of the corpus.
    """

    def each(batch: DataFrame, number: int) -> None:
        began = time.time()
        planned, selected = retrieve(batch, open_index(batch.sparkSession, index_path))
        planned = planned.withColumn("kind", plan_kind())
        if calls is not None:
            called = calls(planned, selected)
        else:
            called = planned.select("query_id", F.lit(None).cast("string").alias("model"), F.lit(round(1000 * (time.time() - began))).cast("long").alias("ms"))
        answer_log(planned, selected, calls=called).write.mode("overwrite").json(f"{log_path}/batch={number}")

    return questions.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
