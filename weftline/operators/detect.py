"""Anomaly detectors and the alert pipeline. Every signal is a hint for review, status PENDING.

A detector is a function of prepared inputs that returns signals; ``DETECTORS`` is the registry to
which more can be added. Greedy selections (bursts, surges) count forward with a RANGE window and
then read each run of hits in order with constant state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.geo import haversine, valid

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US
DETECTORS: dict[str, Callable[..., DataFrame]] = {}
SIGNAL = ("alert_type", "source", "target", "place", "window_key", "score", "severity")


def detector(name: str):
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        DETECTORS[name] = f
        return f

    return add


def _signal(df: DataFrame, kind: str, source: Column, score: Column, severity: Column, target: Column | None = None, place: Column | None = None, window: Column | None = None) -> DataFrame:
    blank = F.lit("")
    text = lambda c: blank if c is None else c.cast("string")
    return df.select(
        F.lit(kind).alias("alert_type"), text(source).alias("source"), text(target).alias("target"), text(place).alias("place"),
        text(window).alias("window_key"), score.cast("double").alias("score"), severity.alias("severity"),
    )


def greedy_windows(rows: DataFrame, key: str, window_us: int, least: int) -> DataFrame:
    """Greedy non-overlapping windows: from a row on, the rows within the window; with ``least`` rows
    or more it is a hit and the next row looked at is that many rows on, else the next one.

    ``rows``: (key, s, id). Returns (key, s, n). Rows that cannot start a hit are dropped first. What is
    left falls into runs that no earlier hit reaches into, so that the choice starts anew in each; runs are
    spread over the tasks, and each is read in order with one number of state, never collected.
    """
    by = W.partitionBy(key)
    counted = rows.withColumn("rn", F.row_number().over(by.orderBy("s", "id"))).withColumn("n", F.count("*").over(by.orderBy("s").rangeBetween(0, window_us)))
    before = by.orderBy("rn").rowsBetween(W.unboundedPreceding, -1)
    hits = counted.where(F.col("n") >= least).withColumn("new", (F.col("rn") >= F.coalesce(F.max(F.col("rn") + F.col("n")).over(before), F.lit(0))).cast("int"))
    runs = hits.withColumn("run", F.sum("new").over(by.orderBy("rn"))).select(key, "run", "rn", "s", F.col("n").cast("bigint").alias("n"), "new")

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        free = 0
        for b in batches:
            take = np.zeros(len(b), dtype=bool)
            for i, (new, rn, n) in enumerate(zip(b["new"].to_numpy(), b["rn"].to_numpy(), b["n"].to_numpy())):
                if new or rn >= free:  # a run's first row is always free
                    take[i], free = True, rn + n
            yield b.loc[take, [key, "s", "n"]]

    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    placed = runs.repartition(key, "run").sortWithinPartitions(key, "run", "rn")
    return placed.mapInPandas(choose, f"`{key}` {kind[key]}, s {kind['s']}, n bigint")


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("deg"))


@detector("network")
def network(edges: DataFrame, least: int = 5, times: float = 2.0, always: int = 10) -> DataFrame:
    """Nodes with many relationships, against the mean over nodes that have any."""
    d = degrees(edges)
    mean = d.agg(F.avg("deg").alias("mean"))
    hot = d.crossJoin(F.broadcast(mean)).where((F.col("deg") >= least) & ((F.col("deg") >= times * F.col("mean")) | (F.col("deg") >= always)))  # one row
    score = F.least(F.lit(0.95), 0.60 + 0.08 * F.col("deg") / F.col("mean"))
    return _signal(hot, "NETWORK", F.col("id"), score, F.when((F.col("deg") >= 10) | (score >= 0.85), "HIGH").otherwise("MEDIUM"))


@detector("network_all_nodes")
def network_all_nodes(nodes: DataFrame, edges: DataFrame, least: int = 5, times: float = 2.5) -> DataFrame:
    """As ``network``, against the mean over all nodes, those without relationships included."""
    d = nodes.select("id").join(degrees(edges), "id", "left").na.fill(0, ["deg"])
    mean = d.agg(F.avg("deg").alias("mean"))
    hot = d.crossJoin(F.broadcast(mean)).where((F.col("deg") >= least) & ((F.col("deg") >= times * F.col("mean")) | (F.col("deg") >= 10)))  # one row
    score = F.least(F.lit(0.95), 0.60 + 0.08 * F.col("deg") / F.col("mean"))
    return _signal(hot, "NETWORK", F.col("id"), score, F.when((F.col("deg") >= 10) | (score >= 0.85), "HIGH").otherwise("MEDIUM"))


@detector("burst")
def burst(ev: DataFrame, window_hours: int = 48, least: int = 4) -> DataFrame:
    """Many events of one participant within a window."""
    w = greedy_windows(ev.select("pid", "s", "id"), "pid", window_hours * HOUR_US, least)
    return _signal(w, "TEMPORAL_BURST", F.col("pid"), F.least(F.lit(0.92), 0.60 + 0.05 * F.col("n")), F.when(F.col("n") >= 8, "HIGH").otherwise("MEDIUM"), window=F.col("s"))


@detector("surge")
def surge(ev: DataFrame, window_hours: int = 48, least: int = 5) -> DataFrame:
    """Many joint events of one pair of participants within a window."""
    pairs = ev.select(F.concat_ws("~", F.least("pid", "pid2").cast("string"), F.greatest("pid", "pid2").cast("string")).alias("pair"), "s", "id", "pid", "pid2").where("pid <> pid2")
    w = greedy_windows(pairs.select("pair", "s", "id"), "pair", window_hours * HOUR_US, least)
    ends = F.split("pair", "~")
    return _signal(w, "RELATIONSHIP_SURGE", ends[0], F.least(F.lit(0.95), 0.65 + 0.05 * F.col("n")), F.when(F.col("n") >= 8, "HIGH").otherwise("MEDIUM"), target=ends[1], window=F.col("s"))


def daily_spikes(ev: DataFrame, least: int = 5, z: float = 2.0, ratio: float = 2.5) -> DataFrame:
    """Days of a case with unusually many events; days without events are no rows."""
    days = ev.groupBy("case_id", F.floor(F.col("s") / DAY_US).alias("day")).agg(F.count("*").alias("n"))
    stat = days.groupBy("case_id").agg(F.sum("n").alias("total"), F.count("*").alias("n_days"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("sd"))
    j = days.join(stat, "case_id").where("total >= 5 and n_days >= 2")
    j = j.withColumn("z", F.when(F.col("sd") > 1e-4, (F.col("n") - F.col("mean")) / F.col("sd")).otherwise(0.0))
    return j.where((F.col("n") >= least) & ((F.col("z") >= z) | (F.col("n") / F.col("mean") >= ratio)))


@detector("spike")
def spike(ev: DataFrame) -> DataFrame:
    d = daily_spikes(ev)
    score = F.least(F.lit(0.96), 0.65 + 0.08 * F.greatest("z", F.lit(2.0)))
    return _signal(d, "ACTIVITY_SPIKE", F.col("case_id"), score, F.when((F.col("z") >= 3) | (F.col("n") >= 12), "CRITICAL").otherwise("HIGH"), window=F.col("day"))


@detector("geographic")
def geographic(located: DataFrame, km: float = 100.0) -> DataFrame:
    """Far from where the participant was first seen; one signal a participant and place."""
    w = W.partitionBy("pid").orderBy("s", "id")
    d = haversine(F.first("lat").over(w), F.first("lon").over(w), F.col("lat"), F.col("lon"))
    far = located.withColumn("km", d).where(F.col("km") >= km).groupBy("pid", "loc").agg(F.max("km").alias("km"))
    return _signal(far, "GEOGRAPHIC_OUTLIER", F.col("pid"), F.least(F.lit(0.94), 0.65 + 0.2 * F.col("km") / 500), F.when(F.col("km") >= 300, "HIGH").otherwise("MEDIUM"), place=F.col("loc"))


@detector("travel")
def unusual_travel(located: DataFrame) -> DataFrame:
    """Consecutive places too far apart for the time between."""
    w = W.partitionBy("pid").orderBy("s", "id")
    km = haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    hours = (F.col("s") - F.lag(F.coalesce("e", "s")).over(w)) / 3.6e9
    legs = located.withColumn("km", km).withColumn("hours", hours).where("km > 80 and hours >= 0")
    legs = legs.withColumn("kmh", F.col("km") / F.greatest("hours", F.lit(0.01)))
    fast = (F.col("km") > 100) & (F.col("kmh") > 900)
    hit = legs.where(fast | ((F.col("kmh") > 400) & (F.col("hours") < 1)))
    return _signal(hit, "UNUSUAL_TRAVEL", F.col("pid"), F.when(fast, 0.95).otherwise(0.78), F.when(fast, "HIGH").otherwise("MEDIUM"), place=F.col("loc"), window=F.col("s"))


@detector("velocity")
def velocity(located: DataFrame, kmh: float = 800.0, km: float = 80.0) -> DataFrame:
    """Consecutive places at least ``km`` apart reached faster than ``kmh``; no time between counts as a thousandth of an hour."""
    w = W.partitionBy("pid").orderBy("s", "id")
    d = haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    hours = (F.col("s") - F.lag("s").over(w)) / 3.6e9
    legs = located.withColumn("km", d).withColumn("hours", F.when(hours <= 0, 0.001).otherwise(hours)).where(F.col("km") >= km)
    legs = legs.withColumn("kmh", F.col("km") / F.col("hours")).where(F.col("kmh") > kmh)
    score = F.least(F.lit(0.96), 0.70 + F.least(F.lit(0.25), F.col("kmh") / 2000 * 0.25))
    return _signal(legs, "VELOCITY", F.col("pid"), score, F.when(F.col("kmh") > 1000, "HIGH").otherwise("MEDIUM"), place=F.col("loc"), window=F.col("s"))


@detector("consistency")
def consistency(ev: DataFrame, places: DataFrame) -> DataFrame:
    """Events that end before they start, and places off the globe."""
    bad_time = _signal(ev.where("e < s"), "TIME_INVERSION", F.col("id"), F.lit(0.88), F.lit("MEDIUM"))
    bad_place = places.where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~valid(F.col("lat"), F.col("lon")))
    return bad_time.unionByName(_signal(bad_place, "BAD_COORDINATES", F.col("id"), F.lit(0.95), F.lit("HIGH")))


@detector("cross_case")
def cross_case(named: DataFrame) -> DataFrame:
    """Names that occur in more than one case: one signal a name. ``named``: (name, case_id)."""
    per = named.select(F.lower("name").alias("name"), "case_id").where("name is not null and case_id is not null").distinct()
    g = per.groupBy("name").agg(F.count("*").alias("n_cases"), F.min("case_id").alias("first_case")).where("n_cases > 1")
    return _signal(g, "CROSS_CASE", F.col("name"), F.lit(0.85), F.lit("MEDIUM"), target=F.col("n_cases"))


@detector("model")
def model_signal(leads: DataFrame, least: float = 0.70) -> DataFrame:
    hit = leads.where(F.col("score") >= least)
    return _signal(hit, "MODEL_SIGNAL", F.col("a"), F.col("score"), F.when(F.col("score") >= 0.85, "HIGH").otherwise("MEDIUM"), target=F.col("b"))


def fingerprint(case: Column) -> Column:
    return F.sha2(F.concat_ws(":", case, "alert_type", "source", "target", "place", "window_key"), 256)


def priority(score: Column, evidence: Column, cross: Column) -> Column:
    """0.40 score + 0.25 with evidence + 0.20 across cases + 0.15."""
    return F.round(0.40 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)) + 0.25 * evidence.cast("int") + 0.20 * cross.cast("int") + 0.15, 4)


def alerts(signals: DataFrame, active: DataFrame | None = None, case: str = "all") -> DataFrame:
    """Signals merged by fingerprint; an active alert keeps its id and takes the higher score."""
    s = signals.withColumn("fingerprint", fingerprint(F.lit(case)))
    merged = s.groupBy("fingerprint").agg(
        F.min("alert_type").alias("alert_type"), F.min("source").alias("source"), F.max("score").alias("score"), F.max_by("severity", F.struct("score", "severity")).alias("said"), F.count("*").alias("n_signals")
    )
    if active is not None:
        open_ = active.where(F.col("status").isin("NEW", "ACKNOWLEDGED", "UNDER_REVIEW")).groupBy("fingerprint").agg(F.min("id").alias("id"), F.max("score").alias("old"))
        merged = merged.join(open_, "fingerprint", "left").withColumn("score", F.greatest("score", "old")).drop("old")
    p = priority(F.col("score"), F.lit(True), F.col("alert_type") == "CROSS_CASE")
    level = F.when(p >= 0.80, "CRITICAL").when(p >= 0.65, "HIGH").when(p >= 0.45, "MEDIUM").otherwise("LOW")
    return merged.withColumn("priority", p).withColumn("severity", F.when(F.col("said").isin("HIGH", "CRITICAL"), F.col("said")).otherwise(level)).drop("said")
