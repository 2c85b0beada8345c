"""Structured Streaming over append-only logs: each micro-batch is folded into the committed tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quarry.operators.intake import State, drain, empty
from quarry.sources.versions import commit, current, load, markers

FEEDBACK = "ts string, batch_id string, target_type string, target_id string, action string"


def feedback_stream(spark: SparkSession, folder: str, schema: str = FEEDBACK) -> DataFrame:
    """Feedback events as they are appended to a folder of JSON lines."""
    return spark.readStream.schema(schema).json(folder)


def fold(stream: DataFrame, root: str, step: Callable[[State, DataFrame, int], State], checkpoint: str) -> StreamingQuery:
    """Run step on the current version for each micro-batch and commit what it returns, marked with the batch's number.

    A batch that fails starts anew from the last commit; one that was committed, but not yet noted in the checkpoint, is not folded twice.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if any(b is not None and b >= number for _, b in markers(spark, root)):
            return
        state = load(spark, root) if current(spark, root) else empty(spark)
        commit(step(state, batch, number), root, number)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain_arrivals(stream: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """slug arrivals: pending links whose target arrived become links."""
    return fold(stream, root, lambda s, batch, n: drain(s, batch, f"stream-{n}", ""), checkpoint)
