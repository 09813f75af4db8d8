"""Continuous covered periods per key, and the gaps between them.

1. Spark's native ``session_window`` with a duration of its own for each row merges overlapping
   events within (key, slice of time). On a doubled microsecond scale an event [s, e] becomes the
   half-open session [2s, 2e+1): touching events overlap by one unit, a hole of one microsecond
   stays a hole, and an event of zero length still has a length.
2. The merged pieces are far fewer than the events. Pieces that reach into later slices are
   stitched: each slice learns the furthest end of all slices before it (a window over one row
   per key and slice), so that no task ever holds all rows of a hot key.
3. A piece that starts beyond everything before it opens a covered span; the hole before it is
   the gap.

Defined results: events without key, start or end, or with end before start, do not count.
Repeated events and repeated keys within an event change nothing. No events, no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.plans.lineage import Scratch

DAY_US = 86_400_000_000


def micros(c: str | Column) -> Column:
    """Microseconds since 1970-01-01 of a timestamp without zone, read as UTC."""
    c = F.col(c) if isinstance(c, str) else c
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, c.cast("timestamp_ntz"))


def merge_sessions(events: DataFrame, keys: list[str], start: str = "s", end: str = "e") -> DataFrame:
    """Unions of touching or overlapping [start, end] (int64) per ``keys``, by ``session_window``."""
    twice = F.timestamp_micros(F.col(start) * 2)
    seconds = ((F.col(end) - F.col(start)) * 2 + 1).cast("decimal(24,0)") / F.lit(1_000_000).cast("decimal(7,0)")
    length = F.make_interval(secs=seconds.cast("decimal(18,6)"))
    return (
        events.select(*keys, twice.alias("_t"), length.alias("_len"))
        .groupBy(*keys, F.session_window("_t", F.col("_len")).alias("_w"))
        .agg(F.count("*").alias("n_events"))
        .select(
            *keys,
            F.expr("unix_micros(_w.start) div 2").alias(start),
            F.expr("(unix_micros(_w.end) - 1) div 2").alias(end),
            "n_events",
        )
    )


def covered_and_gaps(events: DataFrame, key: str, start: str, end: str, *, slice_us: int = DAY_US) -> DataFrame:
    """(key, span_kind, start_us, end_us) with span_kind ``covered`` or ``gap``.

    ``events`` has one row per key and event; ``start`` and ``end`` are timestamps.
    """
    timed = (
        events.select(F.col(key).alias("k"), micros(start).alias("s"), micros(end).alias("e"))
        .where("k is not null and s is not null and e >= s")
        .withColumn("slice", F.floor(F.col("s") / slice_us))
    )
    # written once: three steps below read the pieces, and would each scan the events again
    pieces = Scratch(events.sparkSession, "spans").cut(merge_sessions(timed, ["k", "slice"]).drop("n_events"))

    in_slice = W.partitionBy("k", "slice").orderBy("s")
    before = in_slice.rowsBetween(W.unboundedPreceding, -1)
    earlier = W.partitionBy("k").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    slices = pieces.groupBy("k", "slice").agg(F.max("e").alias("reach"))
    carried = slices.select("k", "slice", F.max("reach").over(earlier).alias("carry"))

    opened = (
        pieces.join(carried, ["k", "slice"])
        .withColumn("prev_end", F.greatest("carry", F.max("e").over(before)))
        .withColumn("opens", F.col("prev_end").isNull() | (F.col("s") > F.col("prev_end")))
        .withColumn("n_open", F.sum(F.col("opens").cast("int")).over(in_slice.rowsBetween(W.unboundedPreceding, 0)))
    )
    counts = opened.groupBy("k", "slice").agg(F.max("n_open").alias("n"))
    offset = counts.select("k", "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("off"))
    spans = (
        opened.join(offset, ["k", "slice"])
        .groupBy("k", (F.col("off") + F.col("n_open")).alias("no"))
        .agg(F.min("s").alias("s"), F.max("e").alias("e"), F.min_by("prev_end", "s").alias("prev_end"))
    )
    rows = F.array(
        F.struct(F.lit("covered").alias("span_kind"), F.col("s").alias("start_us"), F.col("e").alias("end_us")),
        F.struct(F.lit("gap").alias("span_kind"), F.col("prev_end").alias("start_us"), F.col("s").alias("end_us")),
    )
    return (
        spans.select("k", F.explode(rows).alias("r"))
        .select(F.col("k").alias(key), "r.*")
        .where("start_us is not null")
    )
