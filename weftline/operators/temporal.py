"""Timelines: sequences, gap sessions, overlaps and active periods. Times are microseconds (bigint)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000


def active_period(df: DataFrame, keys: list[str]) -> DataFrame:
    """First start and last end of each key, an open end counting as its start."""
    return df.groupBy(*keys).agg(F.min("s").alias("first_s"), F.max(F.coalesce("e", "s")).alias("last_e"), F.count("*").alias("n_events"))


def sequence(df: DataFrame, key: str) -> DataFrame:
    """Steps of each key in order, with the minutes since the step before ended and how to say them."""
    w = W.partitionBy(key).orderBy("s", "id")
    gap = F.greatest(F.lit(0.0), (F.col("s") - F.lag(F.coalesce("e", "s")).over(w)) / 6e7)
    step = df.withColumn("step", F.row_number().over(w)).withColumn("minutes", gap)
    said = (
        F.when(F.col("step") == 1, "Origin")
        .when(F.col("minutes") < 60, F.concat(F.floor("minutes").cast("string"), F.lit(" min")))
        .when(F.col("minutes") < 1440, F.concat(F.floor(F.col("minutes") / 60).cast("string"), F.lit(" h")))
        .otherwise(F.concat(F.floor(F.col("minutes") / 1440).cast("string"), F.lit(" d")))
    )
    return step.withColumn("said", said)


def gap_sessions(df: DataFrame, key: str, gap_us: int = 36 * HOUR_US) -> DataFrame:
    """Sessions of each key, a new one where an event starts more than the gap after the event before it ended.

    The event before is the previous row, not the furthest end so far, so ``session_window`` would differ.
    """
    w = W.partitionBy(key).orderBy("s", "id")
    new = F.when(F.col("s") - F.lag(F.coalesce("e", "s")).over(w) > gap_us, 1).otherwise(0)
    run = df.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)) + 1)
    out = run.groupBy(key, "session").agg(
        F.min("s").alias("s"), F.max(F.coalesce("e", "s")).alias("e"), F.count("*").alias("n_events"), F.count_distinct("loc").alias("n_places")
    )
    level = F.when(F.col("n_events") >= 4, "HIGH").when(F.col("n_events") >= 2, "MEDIUM").otherwise("LOW")
    return out.withColumn("intensity", level)


#: Slices of an overlap join are an hour, or eight times that as often as the longer event asks for.
SLICE_BASE, SLICE_CLASSES = 8, 8


def overlaps(left: DataFrame, right: DataFrame, on: list[str], residual: Column, slice_us: int = HOUR_US) -> DataFrame:
    """Pairs of events with equal ``on`` whose [s, e) strictly overlap, by an equi-join on time slices.

    An event's class is the slice length at which it touches at most nine slices. It lies in slices of its
    own class and of the coarser classes that occur, and a pair meets in the class of its longer event and the
    slice in which its later event starts: once, however long either is.
    """
    size = lambda c: F.lit(slice_us) * F.pow(F.lit(SLICE_BASE), c).cast("bigint")
    steps = F.ceil(F.log(F.greatest(F.lit(1.0), (F.col("e") - F.col("s")) / slice_us / SLICE_BASE)) / F.log(F.lit(float(SLICE_BASE))))
    own = F.greatest(F.lit(0), F.least(F.lit(SLICE_CLASSES - 1), steps.cast("int")))
    classed = lambda d: d.where("s is not null and e > s").withColumn("own", own)
    a, b = classed(left), classed(right)
    occur = F.broadcast(a.select("own").unionByName(b.select("own")).distinct().withColumnRenamed("own", "class"))  # eight rows at most

    def spread(d: DataFrame, p: str) -> DataFrame:
        at = d.join(occur, F.col("class") >= F.col("own"))
        cells = F.sequence(F.floor(F.col("s") / size(F.col("class"))), F.floor(F.col("e") / size(F.col("class"))))
        return at.select(*on, "class", F.col("own").alias(f"{p}_own"), *[F.col(c).alias(f"{p}_{c}") for c in d.columns if c not in on and c != "own"], F.explode(cells).alias("slice"))

    s, e = F.greatest("a_s", "b_s"), F.least("a_e", "b_e")
    pairs = spread(a, "a").join(spread(b, "b"), [*on, "class", "slice"]).where(F.col("class") == F.greatest("a_own", "b_own"))
    return pairs.where((F.col("slice") == F.floor(s / size(F.col("class")))) & (s < e) & residual).withColumn("os", s).withColumn("oe", e).drop("slice", "class", "a_own", "b_own")


def _precise(a: str, b: str) -> Column:
    """How far both times of a pair can be relied on."""
    return F.when((F.col(a) == "EXACT") & (F.col(b) == "EXACT"), 1.0).when((F.col(a) == "MINUTE") | (F.col(b) == "MINUTE"), 0.9).otherwise(0.7)


def overlap_signals(ev: DataFrame, on: str, min_minutes: float = 1.0) -> DataFrame:
    """Overlapping events at one place, scored by length, precision and review state."""
    side = ev.select(on, "id", "s", "e", "precision", "status")
    pairs = overlaps(side, side, [on], F.col("a_id") < F.col("b_id"))
    minutes = (F.col("oe") - F.col("os")) / 6e7
    both = F.when((F.col("a_status") == "APPROVED") & (F.col("b_status") == "APPROVED"), 1.0).otherwise(0.85)
    score = 0.40 * F.least(F.lit(1.0), minutes / 60) + 0.25 * _precise("a_precision", "b_precision") + 0.20 + 0.15 * both
    return pairs.withColumn("minutes", minutes).where(F.col("minutes") >= min_minutes).withColumn("score", score)


def _given(c: str) -> Column:
    return F.when(F.trim(c) != "", F.lower(c))


def related_overlaps(ev: DataFrame, min_minutes: float = 1.0) -> DataFrame:
    """Overlapping events of one case that share their place (by id or by name) or a participant.

    ``ev``: (id, case_id, s, e, loc, place, people, precision, status); texts compare without letter case. One
    row a pair, a_id < b_id: os, oe, minutes, same_place, n_shared, score (a shared place counts 1, else 0.6).
    """
    shared = F.transform(F.filter("people", lambda x: F.trim(x) != ""), lambda x: F.concat(F.lit("P"), F.lower(x)))
    keys = F.array_distinct(F.array_compact(F.concat(F.array(F.concat(F.lit("L"), _given("loc")), F.concat(F.lit("T"), _given("place"))), F.coalesce(shared, F.array().cast("array<string>")))))
    side = ev.select("case_id", "id", "s", F.coalesce("e", "s").alias("e"), "precision", "status", F.explode(keys).alias("key"))
    met = overlaps(side, side, ["case_id", "key"], F.col("a_id") < F.col("b_id"))
    place = F.max(~F.startswith("key", F.lit("P")))
    pairs = met.groupBy("case_id", "a_id", "b_id", "os", "oe", "a_precision", "b_precision", "a_status", "b_status").agg(place.alias("same_place"), F.count_if(F.startswith("key", F.lit("P"))).alias("n_shared"))
    minutes = (F.col("oe") - F.col("os")) / 6e7
    both = F.when((F.col("a_status") == "APPROVED") & (F.col("b_status") == "APPROVED"), 1.0).otherwise(0.85)
    score = 0.40 * F.least(F.lit(1.0), minutes / 60) + 0.25 * _precise("a_precision", "b_precision") + 0.20 * F.when(F.col("same_place"), 1.0).otherwise(0.6) + 0.15 * both
    return pairs.withColumn("minutes", minutes).where(F.col("minutes") >= min_minutes).select("case_id", "a_id", "b_id", "os", "oe", "minutes", "same_place", "n_shared", score.alias("score"))


def cross_case_overlaps(ev: DataFrame, place: str, min_minutes: float = 1.0, fixed_score: float | None = None) -> DataFrame:
    """Overlapping events of different cases with equal ``place`` (blank and null match nothing), a_id < b_id.

    Scored by length, or with ``fixed_score``.
    """
    side = ev.where("case_id is not null").select(_given(place).alias("key"), "case_id", "id", "s", F.coalesce("e", "s").alias("e")).where("key is not null")
    pairs = overlaps(side, side, ["key"], (F.col("a_id") < F.col("b_id")) & (F.col("a_case_id") != F.col("b_case_id")))
    minutes = (F.col("oe") - F.col("os")) / 6e7
    score = F.lit(fixed_score) if fixed_score is not None else 0.40 * F.least(F.lit(1.0), minutes / 60) + 0.60
    return pairs.withColumn("minutes", minutes).where(F.col("minutes") >= min_minutes).withColumn("score", score)
