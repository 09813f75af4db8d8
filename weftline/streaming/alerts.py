"""Streaming forms of batch operators (extensions): file intake, day counts, late-safe alert dedup.

The batch operators define the results; a stream over the same rows gives the same, up to the
watermark. State is bounded by the watermark, so no stream grows without end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def intake(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 5) -> DataFrame:
    """Files of a folder as a stream, oldest first, a few at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def run_each(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, seconds: int | None = None) -> StreamingQuery:
    """``work`` on each batch; until the present input is done, or every so many seconds for ever."""
    w = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=f"{seconds} seconds") if seconds else w.trigger(availableNow=True)).start()


def window_counts(events: DataFrame, time: str, keys: list[str], window: str = "48 hours", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Events per key and window of event time; a window is final once the watermark has passed it."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    return events.withWatermark(time, late).groupBy(w, *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def new_alerts(signals: DataFrame, time: str, late: str = "2 days") -> DataFrame:
    """Signals whose fingerprint has not been seen within the watermark."""
    return signals.withWatermark(time, late).dropDuplicatesWithinWatermark(["fingerprint"])
