"""Slices that arrive over time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wallscan.operators.profiles import recognise
from wallscan.sources.store import append_results, read_results


def recognise_stream(spark: SparkSession, slices: str, schema, results: str, checkpoint: str) -> StreamingQuery:
    """Recognises each new slice file once and appends its groups; a repeated batch replaces itself.

    A slice is complete in its file, so there is no state between batches."""
    stream = spark.readStream.schema(schema).parquet(slices)
    run = lambda batch, number: append_results(recognise(batch), results, number)
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def face_heights_stream(heights: DataFrame, strategy: str = "max") -> DataFrame:
    """A running height for each face over arriving (face_id, height) rows; for update mode."""
    how = {"max": F.max, "min": F.min, "avg": F.avg}[strategy]
    return heights.where("face_id is not null").groupBy("face_id").agg(how("height").alias("height"), F.count("*").alias("n"))


def write_heights_stream(heights: DataFrame, results: str, checkpoint: str, strategy: str = "max") -> StreamingQuery:
    """Adds to a result store, batch by batch, the running heights of the faces that changed; `store.read_latest` reads it.

    What a batch writes follows its own faces, not all faces seen. A repeated batch replaces itself."""
    running = face_heights_stream(heights, strategy).writeStream.outputMode("update")
    return running.foreachBatch(lambda batch, number: append_results(batch, results, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _bytes(rows: pd.DataFrame) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, (table := pa.Table.from_pandas(rows, preserve_index=False)).schema) as stream:
        stream.write_table(table)
    return out.getvalue().to_pybytes()


def _wait(patience_ms: int) -> Callable:
    """Holds the pieces of a slice until all of its n_slice segments are there, or until none came for patience_ms.

    A slice given up is passed on as it is and stays in the state: if more of it comes, it is passed on again,
    whole or after the next wait, and the later version counts."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [pa.ipc.open_stream(state.get[0]).read_pandas()] if state.exists else []
        if state.hasTimedOut:
            yield held[0].drop(columns="n_slice")
            return
        rows = pd.concat([*held, *batches], ignore_index=True)
        if len(rows) >= rows["n_slice"].max():
            state.remove()
            yield rows.drop(columns="n_slice")
        else:
            state.update((_bytes(rows),))
            state.setTimeoutDuration(patience_ms)

    return step


def recognise_pieces_stream(pieces: DataFrame, results: str, checkpoint: str, patience_ms: int = 3_600_000) -> StreamingQuery:
    """Recognises slices whose segments come in any batches; `read_recognised` reads the results.

    pieces holds segments with n_slice, the number of segments of the whole slice. Each slice is recognised once
    it is whole, or as it is in the first batch after nothing of it came for patience_ms. A slice without groups leaves one row with
    null groups, so that it replaces what an earlier version gave."""
    fields = [f for f in pieces.schema.fields if f.name != "n_slice"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    waiting = pieces.select(*(f.name for f in fields), "n_slice").groupBy("k")
    whole = waiting.applyInPandasWithState(_wait(patience_ms), schema, "held binary", "append", GroupStateTimeout.ProcessingTimeTimeout)

    def run(batch: DataFrame, number: int) -> None:
        kept = f"{checkpoint}/whole"  # written first, as reading the batch twice would run the state twice
        append_results(batch, kept, number)
        slices = read_results(batch.sparkSession, f"{kept}/batch={number}")
        append_results(slices.select("k").distinct().join(recognise(slices), "k", "left"), results, number)

    # Timers would keep asking for empty batches, and the query would never end; a stream takes the session's settings when it starts.
    spark, name = pieces.sparkSession, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        return whole.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, before)


def read_recognised(spark: SparkSession, results: str) -> DataFrame:
    """The groups of the newest version of each slice."""
    every = read_results(spark, results)
    newest = every.groupBy("k").agg(F.max("batch").alias("batch"))
    return every.join(newest, ["k", "batch"], "left_semi").where("path_id is not null").drop("batch")
