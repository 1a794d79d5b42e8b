"""Resolution of streamed records against a fixed left side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.resolve import exact_names, first_channel, shared_postal, shared_prefix


def stream_candidates(left: DataFrame, batch: DataFrame) -> DataFrame:
    """Uncapped candidates of one micro-batch of the pool."""
    return first_channel(exact_names(left, batch), shared_postal(left, batch), shared_prefix(left, batch))


def start(left: DataFrame, pool: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Run the rules on each micro-batch of a stream of canonical pool records.

    left is static.  sink gets the batch's pairs; it must be idempotent by batch
    number, as batches can come again after a failure.
    """
    writer = pool.writeStream.foreachBatch(lambda df, n: sink(stream_candidates(left, df), n)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


_STATE = T.StructType([T.StructField("n", T.IntegerType())])
_CAPPED = "s1_id string, cand_id string, is_match boolean, place int"


def capped(pairs: DataFrame, most: int = 25) -> DataFrame:
    """The first ``most`` candidates of each record across the whole stream, by a count kept for each record."""

    def keep(key, frames, state):
        n = state.get[0] if state.exists else 0
        for pdf in frames:
            pdf = pdf.sort_values(["source", "pos", "cand_id"])[: max(most - n, 0)].copy()
            pdf["place"] = range(n + 1, n + 1 + len(pdf))
            n += len(pdf)
            yield pdf[["s1_id", "cand_id", "is_match", "place"]].astype({"place": "int32"})
        state.update((n,))

    return pairs.groupBy("s1_id").applyInPandasWithState(keep, _CAPPED, _STATE, "append", "NoTimeout")


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """n, total by event time window and type; rows later than the watermark are left out.

    Times without a zone are taken in the session's.
    """
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
