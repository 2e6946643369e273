"""Line-of-sight sums over a stream.

The batch kernel's sums are whole numbers, so streaming them gives the batch result in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sightline.functions import scalars as S


def windowed_kernel(samples: DataFrame, *, time: str, late: str, window: str, decay: S.Decay | None = None) -> DataFrame:
    """Per pair and time window: samples, visible samples, weight sum in millionths, mask of observers.

    ``samples``: ``source_h3, target_h3, observer, distance_km, clear`` and an event time; rows later
    than ``late`` behind the newest time are left out by the watermark.
    """
    weight = S.quantize_weight((decay or S.Decay()).weight("distance_km"))
    marked = samples.withWatermark(time, late).withColumn("weight_q", F.when(F.col("clear"), weight).otherwise(0))
    return marked.groupBy(F.window(time, window), "source_h3", "target_h3").agg(
        F.count("*").alias("samples"), F.count_if("clear").alias("visible_pairs"), F.sum("weight_q").alias("weight_q_sum"),
        F.bit_or(F.when(F.col("clear"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("observer").cast("int"))).otherwise(F.lit(0).cast("long"))).alias("observer_mask"),
    )


def run_to_memory(stream: DataFrame, name: str, mode: str = "complete") -> StreamingQuery:
    """Process what is there into an in-memory table (for tests and small jobs)."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
