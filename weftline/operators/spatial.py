"""Places: activity, radius search, travel, co-presence, outliers and leader clusters."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.geo import haversine, implausible, speed
from weftline.operators.temporal import overlaps

#: Events of one block of people; cells (pairs of people) and meetings that a task counts at a time.
BLOCK_EVENTS, MEETING_CELLS, PIECE = 1_000_000, 8_000_000, 2_000_000


def with_places(ev: DataFrame, places: DataFrame) -> DataFrame:
    """Events with the coordinates of their place."""
    return ev.join(places.select("loc", "lat", "lon"), "loc")


def activity(ev: DataFrame, places: DataFrame) -> DataFrame:
    """Events, people and active period of every place, places without events included."""
    per = ev.groupBy("loc").agg(F.count("*").alias("n_events"), F.count_distinct("pid").alias("n_people"), F.min("s").alias("first_s"), F.max("s").alias("last_s"))
    zero = F.lit(0).cast("bigint")
    return places.join(per, "loc", "left").withColumns({"n_events": F.coalesce("n_events", zero), "n_people": F.coalesce("n_people", zero)})


def visits(ev: DataFrame) -> DataFrame:
    """Visits of each person to each place: count, first and last."""
    return ev.groupBy("loc", "pid").agg(F.count("*").alias("n"), F.min("s").alias("first_s"), F.max("s").alias("last_s"))


def within(places: DataFrame, lat: float, lon: float, km: float) -> DataFrame:
    """Places within a radius, with their distance; impossible arguments raise."""
    if not (-90 <= lat <= 90 and -180 <= lon <= 180) or km <= 0:
        raise ValueError("latitude, longitude or radius out of range")
    box = F.col("lat").between(lat - km / 110.0, lat + km / 110.0)  # pushes down; the distance decides
    d = haversine(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))
    return places.where(box).withColumn("km", d).where(F.col("km") <= km)


def travel(ev: DataFrame, key: str, from_end: bool = False) -> DataFrame:
    """Legs between consecutive located events of each key: km, hours, km/h, running total, implausible."""
    w = W.partitionBy(key).orderBy("s", "id")
    since = F.coalesce("e", "s") if from_end else F.col("s")
    km = haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    legs = ev.withColumn("km", km).withColumn("hours", (F.col("s") - F.lag(since).over(w)) / 3.6e9)
    legs = legs.withColumn("total_km", F.sum(F.coalesce("km", F.lit(0.0))).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return legs.withColumn("kmh", speed(F.col("km"), F.col("hours"))).withColumn("implausible", F.coalesce(implausible(F.col("km"), F.col("hours")), F.lit(False)))


def outliers(ev: DataFrame, key: str, km: float = 100.0) -> DataFrame:
    """Events at least ``km`` from the first located event of their key."""
    w = W.partitionBy(key).orderBy("s", "id")
    d = haversine(F.first("lat").over(w), F.first("lon").over(w), F.col("lat"), F.col("lon"))
    return ev.withColumn("km", d).where(F.col("km") >= km)


def copresence(ev: DataFrame) -> DataFrame:
    """Different people at one place at overlapping times, scored by length and confidence."""
    side = ev.select("loc", "id", "pid", "s", "e", "conf")
    residual: Column = (F.col("a_id") < F.col("b_id")) & (F.col("a_pid") != F.col("b_pid"))
    pairs = overlaps(side, side, ["loc"], residual)
    minutes = (F.col("oe") - F.col("os")) / 6e7
    score = F.least(F.lit(1.0), 0.5 + F.least(minutes, F.lit(60.0)) / 120 + 0.3 * F.least("a_conf", "b_conf"))
    return pairs.withColumn("minutes", minutes).withColumn("score", score)


def copresence_counts(ev: DataFrame) -> DataFrame:
    """(p, q, n, score), p < q: how often two people meet by ``copresence``, and the best score to six places.

    People fall into blocks and a task has the events of two of them, so that all meetings of two people
    are counted where they are found: events are shuffled once a block, meetings never.
    """
    side = ev.where("s is not null and e > s and loc is not null and pid is not null and id is not null").select("loc", "id", "pid", "s", "e", F.col("conf").cast("double").alias("conf"))
    k = max(4, -(-side.count() // BLOCK_EVENTS))
    two = [(i, j) for i in range(k) for j in range(i + 1, k)] + [(i, i) for i in range(k)]  # the longer tasks first
    of = [(b, t, x) for t, (i, j) in enumerate(two) for x, b in enumerate((i, j)[: 1 + (i < j)])]
    tasks = F.broadcast(ev.sparkSession.createDataFrame(of, "block int, task int, side int"))  # k x k rows
    spread = side.withColumn("block", F.pmod(F.xxhash64("pid"), F.lit(k)).cast("int")).join(tasks, "block").drop("block")
    kind = ev.schema["pid"].dataType.simpleString()
    return spread.repartitionById(len(two), F.col("task")).drop("task").mapInArrow(_meetings, f"p {kind}, q {kind}, n bigint, score double")


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``copresence_counts`` of one task: people of side 0 with those of side 1, or among themselves."""
    run = [b for b in batches if b.num_rows]
    if not run:
        return
    t = pa.Table.from_batches(run)
    people = pc.unique(t.column("pid").combine_chunks())
    people = people.take(pc.sort_indices(people))
    code = lambda c, among: pc.index_in(t.column(c).combine_chunks(), value_set=among).to_numpy(zero_copy_only=False).astype(np.int64)
    v = {"p": code("pid", people), "id": code("id", pc.unique(t.column("id").combine_chunks())), "loc": code("loc", pc.unique(t.column("loc").combine_chunks()))}
    v |= {c: t.column(c).to_numpy() for c in ("side", "s", "e", "conf")}
    del t, run
    v["conf"] = np.where(np.isnan(v["conf"]), np.inf, v["conf"])  # what is missing never is the least
    times = np.unique(np.concatenate([v["s"], v["e"]]))
    for c in ("s", "e"):  # places and times as one number
        v[f"k{c}"] = v["loc"] * (len(times) + 1) + np.searchsorted(times, v[c])
    order = np.argsort(v["ks"], kind="stable")
    v = {c: x[order] for c, x in v.items() if c != "loc"}
    pick = lambda d, at: {c: x[at] for c, x in d.items()}
    cross = bool(v["side"].any())
    left, right = (pick(v, v["side"] == 0), pick(v, v["side"] == 1)) if cross else (v, v)
    first = np.unique(left["p"])
    second = np.unique(right["p"])
    place = np.zeros(len(people), dtype=np.int64)
    place[second] = np.arange(len(second))
    step = max(1, MEETING_CELLS // len(second)) if len(second) else 1
    for at in range(0, len(first) if len(second) else 0, step):
        some = first[at : at + step]
        a = pick(left, (left["p"] >= some[0]) & (left["p"] <= some[-1]))
        row = np.searchsorted(some, a["p"])
        n, best = np.zeros(len(some) * len(second), np.int64), np.full(len(some) * len(second), -np.inf)

        def add(i: np.ndarray, j: np.ndarray) -> None:
            keep = a["id"][i] != right["id"][j]
            if not cross:
                keep &= a["p"][i] < right["p"][j]
            i, j = i[keep], j[keep]
            cell = row[i] * len(second) + place[right["p"][j]]
            minutes = (np.minimum(a["e"][i], right["e"][j]) - np.maximum(a["s"][i], right["s"][j])) / 6e7
            score = np.minimum(1.0, 0.5 + np.minimum(minutes, 60.0) / 120 + 0.3 * np.minimum(a["conf"][i], right["conf"][j]))
            np.add.at(n, cell, 1)
            np.maximum.at(best, cell, score)

        # the later event of a pair starts within the other; of two that start at once the right one counts as later
        for x, y, swap in ((a, right, False), (right, a, True)):
            lo, hi = np.searchsorted(y["ks"], x["ks"], "right" if swap else "left"), np.searchsorted(y["ks"], x["ke"], "left")
            probe = np.flatnonzero(hi > lo)
            lo, c = lo[probe], (hi - lo)[probe]
            cut = np.flatnonzero(np.diff((np.cumsum(c) - 1) // PIECE)) + 1
            for q, l, m in zip(np.split(probe, cut), np.split(lo, cut), np.split(c, cut), strict=True):
                if len(q):
                    i, j = np.repeat(q, m), np.repeat(l - np.cumsum(m) + m, m) + np.arange(m.sum())
                    add(*((j, i) if swap else (i, j)))
        met = np.flatnonzero(n)
        for k in range(0, len(met), 500_000):
            cells = met[k : k + 500_000]
            x, y = some[cells // len(second)], second[cells % len(second)]
            p, q = (people.take(pa.array(f(x, y))) for f in (np.minimum, np.maximum))
            yield pa.record_batch([p, q, pa.array(n[cells]), pa.array(_six_places(best[cells]))], names=["p", "q", "n", "score"])


def _six_places(x: np.ndarray) -> np.ndarray:
    """Rounded to six places, halves of the shortest decimal form away from zero as ``round`` of SQL has it."""
    y = x * 1e6
    out = np.floor(y + 0.5) / 1e6
    for k in np.flatnonzero(np.abs(y - np.floor(y) - 0.5) < 1e-6):
        out[k] = float(Decimal(repr(float(x[k]))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return out


def copresence_of_lists(ev: DataFrame) -> DataFrame:
    """Different participants of overlapping events of one case at one place, by id or else by name.

    ``ev``: (id, case_id, s, e, loc, place, people, conf). One row per pair of events and of participants, a from the
    event with the smaller id; a missing confidence counts as 0.
    """
    blank = lambda c: F.when(F.trim(c) != "", F.lower(c))
    keys = F.array_compact(F.array(F.concat(F.lit("L"), blank("loc")), F.concat(F.lit("T"), blank("place"))))
    people = F.array_distinct(F.filter("people", lambda x: F.trim(x) != ""))
    side = ev.select("case_id", "id", "s", F.coalesce("e", "s").alias("e"), F.coalesce("conf", F.lit(0.0)).alias("conf"), people.alias("people"), F.explode(keys).alias("key")).where("size(people) > 0")
    met = overlaps(side, side, ["case_id", "key"], F.col("a_id") < F.col("b_id")).drop("key").distinct()
    minutes = (F.col("oe") - F.col("os")) / 6e7
    score = F.least(F.lit(1.0), 0.5 + F.least(minutes, F.lit(60.0)) / 120 + 0.3 * F.least("a_conf", "b_conf"))
    pairs = met.withColumn("minutes", minutes).withColumn("score", score).select("case_id", "a_id", "b_id", "os", "oe", "minutes", "score", F.explode("a_people").alias("a"), "b_people")
    return pairs.select("case_id", "a_id", "b_id", "os", "oe", "minutes", "score", "a", F.explode("b_people").alias("b")).where(F.lower("a") != F.lower("b"))


def leader_clusters(points: DataFrame, key: str, km: float = 25.0) -> DataFrame:
    """Greedy clusters per key: in order of id, a free point leads and takes all free points within ``km`` of it.

    A fold over each key's sorted points inside the JVM; a key's points are places, not events.
    """
    pts = points.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("loc", "lat", "lon"))).alias("pts"))

    def near(p: Column, q: Column) -> Column:
        return haversine(p.lat, p.lon, q.lat, q.lon) <= km

    def add(state: Column, p: Column) -> Column:
        led = F.filter(state, lambda q: (q.leader == q.loc) & near(q, p))
        lead = F.when(F.size(led) > 0, F.element_at(led, 1).leader).otherwise(p.loc)
        row = F.struct(p.loc.alias("loc"), p.lat.alias("lat"), p.lon.alias("lon"), lead.alias("leader"))
        return F.concat(state, F.array(row))

    empty = F.expr("cast(array() as array<struct<loc:bigint,lat:double,lon:double,leader:bigint>>)")
    done = pts.select(key, F.explode(F.aggregate("pts", empty, add)).alias("p")).select(key, "p.*")
    return done.groupBy(key, "leader").agg(F.count("*").alias("n"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
