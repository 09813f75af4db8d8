"""Timelines, places and detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.geo import HAVERSINE_SQL
from weftline.operators import detect as D
from weftline.operators import spatial as X
from weftline.operators import temporal as T
from weftline.operators.spans import micros
from weftline.sources import canon
from weftline.sources.canon import with_
from weftline.sources.tables import table


def _live(spark: SparkSession, sf: str) -> DataFrame:
    return canon.live(canon.events(spark, sf))


def _located(spark: SparkSession, sf: str) -> DataFrame:
    return X.with_places(_live(spark, sf), F.broadcast(canon.places(spark, sf)))  # 25 rows, fixed


def active_period(spark: SparkSession, sf: str) -> DataFrame:
    return T.active_period(canon.events(spark, sf), ["pid"])


def entity_sequence(spark: SparkSession, sf: str) -> DataFrame:
    return T.sequence(_live(spark, sf), "pid").select("pid", "id", F.col("step").cast("bigint").alias("step"), F.round("minutes", 3).alias("minutes"), "said")


def sessions_36h(spark: SparkSession, sf: str) -> DataFrame:
    return T.gap_sessions(_live(spark, sf), "pid").select("pid", "session", "s", "e", "n_events", "n_places", "intensity")


def overlap_pairs(spark: SparkSession, sf: str) -> DataFrame:
    o = T.overlap_signals(_live(spark, sf), "loc")
    return o.groupBy("loc").agg(F.count("*").alias("n_pairs"), F.round(F.sum("minutes"), 3).alias("minutes"), F.round(F.max("score"), 6).alias("best"), F.max("a_id").alias("last_a"))


def copresence_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return X.copresence_counts(_live(spark, sf))


def location_activity(spark: SparkSession, sf: str) -> DataFrame:
    return X.activity(_live(spark, sf), canon.places(spark, sf)).select("loc", "name", "n_events", "n_people", "first_s", "last_s")


def location_visits(spark: SparkSession, sf: str) -> DataFrame:
    return X.visits(_live(spark, sf))


def radius_search(spark: SparkSession, sf: str) -> DataFrame:
    return X.within(canon.places(spark, sf), 20.0, 80.0, 800.0).select("loc", F.round("km", 4).alias("km"))


def travel_sequence(spark: SparkSession, sf: str) -> DataFrame:
    t = X.travel(_located(spark, sf), "pid")
    return t.groupBy("pid").agg(F.round(F.max("total_km"), 3).alias("total_km"), F.round(F.max("kmh"), 3).alias("max_kmh"), F.count_if("implausible").alias("n_implausible"))


def implausible_travel(spark: SparkSession, sf: str) -> DataFrame:
    t = X.travel(_located(spark, sf), "pid", from_end=True).where("implausible")
    return t.select("pid", "id", F.round("km", 4).alias("km"), F.round("hours", 6).alias("hours"))


def geo_outliers(spark: SparkSession, sf: str) -> DataFrame:
    return X.outliers(_located(spark, sf), "pid").groupBy("pid").agg(F.count("*").alias("n"), F.round(F.max("km"), 4).alias("km"))


def leader_clusters(spark: SparkSession, sf: str) -> DataFrame:
    c = X.leader_clusters(canon.places(spark, sf), "case_id", 1500.0)
    return c.select("case_id", "leader", "n", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"))


def _six(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


def detect_network(spark: SparkSession, sf: str) -> DataFrame:
    return _six(D.network(canon.relationships(spark, sf))).select("source", "score", "severity")


def detect_burst(spark: SparkSession, sf: str) -> DataFrame:
    return _six(D.burst(_live(spark, sf))).select("source", "window_key", "score", "severity")


def detect_surge(spark: SparkSession, sf: str) -> DataFrame:
    ev = _live(spark, sf).withColumn("pid", F.col("pid") % 20)
    return _six(D.surge(ev)).select("source", "target", "window_key", "score", "severity")


def detect_spike(spark: SparkSession, sf: str) -> DataFrame:
    return _six(D.spike(_live(spark, sf))).select("source", "window_key", "score", "severity")


def detect_travel(spark: SparkSession, sf: str) -> DataFrame:
    return _six(D.unusual_travel(_located(spark, sf))).select("source", "place", "window_key", "score", "severity")


def detect_network_all(spark: SparkSession, sf: str) -> DataFrame:
    return _six(D.network_all_nodes(canon.entities(spark, sf), canon.relationships(spark, sf))).select("source", "score", "severity")


def detect_velocity(spark: SparkSession, sf: str) -> DataFrame:
    return _six(D.velocity(_located(spark, sf))).select("source", "place", "window_key", "score", "severity")


def detect_geographic(spark: SparkSession, sf: str) -> DataFrame:
    return _six(D.geographic(_located(spark, sf))).select("source", "place", "score", "severity")


def detect_consistency(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "timeline_events").select("id", F.col("start_time_utc").alias("s"), F.col("end_time_utc").alias("e")).distinct()
    return D.consistency(ev, table(spark, sf, "locations")).select("alert_type", "source", "severity")


def detect_cross_case(spark: SparkSession, sf: str) -> DataFrame:
    named = table(spark, sf, "entities").select("name", F.col("linked_investigation_id").alias("case_id"))
    return D.cross_case(named).select("source", "target")


def _signals(spark: SparkSession, sf: str) -> DataFrame:
    ev = _live(spark, sf)
    parts = [D.burst(ev), D.surge(ev.withColumn("pid", F.col("pid") % 20)), D.spike(ev), D.network(canon.relationships(spark, sf))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def alerts_dedup(spark: SparkSession, sf: str) -> DataFrame:
    twice = _signals(spark, sf)
    a = D.alerts(twice.unionByName(twice))
    return a.select("fingerprint", "alert_type", "source", F.round("score", 6).alias("score"), "n_signals", F.round("priority", 3).alias("priority"), "severity")


def alert_summary(spark: SparkSession, sf: str) -> DataFrame:
    a = D.alerts(_signals(spark, sf))
    return a.groupBy("alert_type").agg(
        F.count("*").alias("n"), F.count_if(F.col("severity") == "CRITICAL").alias("n_critical"), F.count_if(F.col("severity") == "HIGH").alias("n_high"), F.count_if(F.col("severity") == "MEDIUM").alias("n_medium")
    )


def _stored(spark: SparkSession, sf: str) -> DataFrame:
    """Stored events that were not rejected, once each."""
    e = table(spark, sf, "timeline_events").where("upper(verification_status) <> 'REJECTED' or verification_status is null")
    return e.dropDuplicates(["id"]).select(
        "id", "case_id", micros("start_time_utc").alias("s"), micros("end_time_utc").alias("e"), F.upper("time_precision").alias("precision"), F.upper("verification_status").alias("status"),
        F.col("location_entity_id").alias("loc"), F.col("location_name").alias("place"), F.col("related_entity_ids").alias("people"), F.col("confidence").alias("conf"),
    )


def related_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    return T.related_overlaps(_stored(spark, sf)).select("case_id", "a_id", "b_id", "same_place", "n_shared", F.round("minutes", 3).alias("minutes"), F.round("score", 6).alias("score"))


def cross_case_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return T.cross_case_overlaps(_stored(spark, sf), "place").select("a_id", "b_id", F.round("minutes", 3).alias("minutes"), F.round("score", 6).alias("score"))


def cross_case_places(spark: SparkSession, sf: str) -> DataFrame:
    return T.cross_case_overlaps(_stored(spark, sf), "loc", 0.0, 0.90).groupBy("key").agg(F.count("*").alias("n_pairs"), F.min("a_id").alias("first_id"), F.round(F.sum("minutes"), 2).alias("minutes"))


def copresence_entities(spark: SparkSession, sf: str) -> DataFrame:
    c = X.copresence_of_lists(_stored(spark, sf)).groupBy(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q"))
    return c.agg(F.count("*").alias("n"), F.round(F.max("score"), 6).alias("score"))


_ALL = [related_overlaps, cross_case_overlap, cross_case_places, copresence_entities, active_period, entity_sequence, sessions_36h, overlap_pairs, copresence_pairs, location_activity, location_visits, radius_search, travel_sequence,
        implausible_travel, geo_outliers, leader_clusters, detect_network, detect_burst, detect_surge, detect_spike, detect_travel, detect_velocity, detect_network_all, detect_geographic,
        detect_consistency, detect_cross_case, alerts_dedup, alert_summary]


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


_LOCATED = "located AS (SELECT l.*, p.lat, p.lon FROM live l JOIN place p USING (loc))"
_LEGS = f"""prev AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(s) OVER w AS ps, lag(e) OVER w AS pe FROM located WINDOW w AS (PARTITION BY pid ORDER BY s, id)),
legs AS (SELECT *, {HAVERSINE_SQL.format(a='p', b='')} AS km FROM prev)"""
_PAIRS = """pairs AS (SELECT a.loc, a.id AS a_id, b.id AS b_id, a.pid AS a_pid, b.pid AS b_pid, a.conf AS a_conf, b.conf AS b_conf, a.precision AS a_pr, b.precision AS b_pr, a.status AS a_st, b.status AS b_st,
  (least(a.e, b.e) - greatest(a.s, b.s)) / 6e7 AS minutes FROM live a JOIN live b ON a.loc = b.loc AND a.id < b.id AND greatest(a.s, b.s) < least(a.e, b.e))"""


def _greedy(name: str, rows: str, least: int) -> str:
    """Greedy windows by jumping along row numbers."""
    return f"""{name}_o AS (SELECT k, s, id, row_number() OVER (PARTITION BY k ORDER BY s, id) AS rn,
    count(*) OVER (PARTITION BY k ORDER BY s RANGE BETWEEN CURRENT ROW AND 172800000000 FOLLOWING) AS n FROM ({rows})),
{name}_n AS (SELECT o.k, o.rn, o.s, o.n, (SELECT min(h.rn) FROM {name}_o h WHERE h.k = o.k AND h.n >= {least} AND h.rn >= o.rn + o.n) AS nx FROM {name}_o o WHERE o.n >= {least}),
{name}_r(k, rn) AS (SELECT k, min(rn) FROM {name}_n GROUP BY k UNION ALL SELECT r.k, x.nx FROM {name}_r r JOIN {name}_n x ON x.k = r.k AND x.rn = r.rn WHERE x.nx IS NOT NULL),
{name} AS (SELECT x.k, x.s, x.n FROM {name}_r r JOIN {name}_n x USING (k, rn))"""


_BURST = _greedy("burst", "SELECT pid AS k, s, id FROM live", 4)
_SURGE = _greedy("surge", "SELECT least(pid % 20, pid2) || '~' || greatest(pid % 20, pid2) AS k, s, id FROM live WHERE pid % 20 <> pid2", 5)
_DEG = "deg AS (SELECT id, count(*) AS d FROM (SELECT src AS id FROM rel UNION ALL SELECT dst FROM rel) GROUP BY id)"
_NET = """net AS (SELECT id, d, least(0.95, 0.60 + 0.08::DOUBLE * d / m) AS score FROM deg, (SELECT avg(d) AS m FROM deg) WHERE d >= 5 AND (d >= 2 * m OR d >= 10))"""
_DAY = """day AS (SELECT case_id, s // 86400000000 AS day, count(*) AS n FROM live GROUP BY ALL),
dz AS (SELECT d.*, n / mean AS ratio, CASE WHEN sd > 1e-4 THEN (n - mean) / sd ELSE 0.0 END AS z FROM day d
  JOIN (SELECT case_id, avg(n) AS mean, stddev_pop(n) AS sd, sum(n) AS total, count(*) AS nd FROM day GROUP BY case_id) USING (case_id) WHERE total >= 5 AND nd >= 2),
spk AS (SELECT *, least(0.96, 0.65 + 0.08::DOUBLE * greatest(z, 2.0)) AS score FROM dz WHERE n >= 5 AND (z >= 2 OR ratio >= 2.5))"""
_SIG = """sig AS (
  SELECT 'TEMPORAL_BURST' AS alert_type, k::VARCHAR AS source, '' AS target, '' AS place, s::VARCHAR AS window_key, least(0.92, 0.60 + 0.05::DOUBLE * n) AS score, CASE WHEN n >= 8 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM burst
  UNION ALL SELECT 'RELATIONSHIP_SURGE', split_part(k, '~', 1), split_part(k, '~', 2), '', s::VARCHAR, least(0.95, 0.65 + 0.05::DOUBLE * n), CASE WHEN n >= 8 THEN 'HIGH' ELSE 'MEDIUM' END FROM surge
  UNION ALL SELECT 'ACTIVITY_SPIKE', case_id::VARCHAR, '', '', day::VARCHAR, score, CASE WHEN z >= 3 OR n >= 12 THEN 'CRITICAL' ELSE 'HIGH' END FROM spk
  UNION ALL SELECT 'NETWORK', id, '', '', '', score, CASE WHEN d >= 10 OR score >= 0.85 THEN 'HIGH' ELSE 'MEDIUM' END FROM net),
al AS (SELECT sha256(concat_ws(':', 'all', alert_type, source, target, place, window_key)) AS fingerprint, alert_type, source, score, severity AS said,
  0.40::DOUBLE * least(1.0, score) + 0.25 + 0.15 AS priority FROM sig),
al2 AS (SELECT *, CASE WHEN said IN ('HIGH', 'CRITICAL') THEN said WHEN round(priority, 4) >= 0.80 THEN 'CRITICAL' WHEN round(priority, 4) >= 0.65 THEN 'HIGH' WHEN round(priority, 4) >= 0.45 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM al)"""


def oracle_sql() -> dict[str, str]:
    travel = with_("ev", "live", "place", _LOCATED, _LEGS)
    signals = with_("ev", "live", "rel", _DEG, _NET, _BURST, _SURGE, _DAY, _SIG, recursive=True)
    stored = """st AS (SELECT * FROM (SELECT DISTINCT ON (id) id, case_id, epoch_us(start_time_utc) AS s, epoch_us(coalesce(end_time_utc, start_time_utc)) AS e, upper(time_precision) AS pr, upper(verification_status) AS vs, nullif(lower(trim(location_entity_id)), '') AS loc,
      nullif(lower(trim(location_name)), '') AS place, list_distinct(list_transform(coalesce(related_entity_ids, []), lambda x: lower(x))) AS ppl, list_distinct(coalesce(related_entity_ids, [])) AS people, coalesce(confidence, 0.0) AS conf FROM timeline_events) WHERE coalesce(vs, '') <> 'REJECTED'),
      mt AS (SELECT a.case_id AS ca, b.case_id AS cb, a.id AS a_id, b.id AS b_id, a.pr AS ap, b.pr AS bp, a.vs AS av, b.vs AS bv, a.loc AS la, b.loc AS lb, a.place AS pa, b.place AS pb, a.ppl AS xa, b.ppl AS xb, a.people AS ua, b.people AS ub, a.conf AS fa, b.conf AS fb,
        (least(a.e, b.e) - greatest(a.s, b.s)) / 6e7 AS minutes FROM st a JOIN st b ON a.id < b.id AND a.s < b.e AND b.s < a.e AND a.s < a.e AND b.s < b.e AND {})""".format
    return {
        "related_overlaps": "WITH " + stored("a.case_id = b.case_id AND (a.loc = b.loc OR a.place = b.place OR list_has_any(a.ppl, b.ppl))") + """, z AS (SELECT *, coalesce(la = lb, false) OR coalesce(pa = pb, false) AS same FROM mt WHERE minutes >= 1)
             SELECT ca AS case_id, a_id, b_id, same AS same_place, len(list_intersect(xa, xb)) AS n_shared, round(minutes, 3) AS minutes, round(0.40::DOUBLE * least(1.0, minutes / 60) + 0.25::DOUBLE * CASE WHEN ap = 'EXACT' AND bp = 'EXACT' THEN 1.0 WHEN ap = 'MINUTE' OR bp = 'MINUTE' THEN 0.9 ELSE 0.7 END
             + 0.20::DOUBLE * CASE WHEN same THEN 1.0 ELSE 0.6 END + 0.15::DOUBLE * CASE WHEN av = 'APPROVED' AND bv = 'APPROVED' THEN 1.0 ELSE 0.85 END, 6) AS score FROM z""",
        "cross_case_overlap": "WITH " + stored("a.case_id <> b.case_id AND a.place = b.place") + " SELECT a_id, b_id, round(minutes, 3) AS minutes, round(0.40::DOUBLE * least(1.0, minutes / 60) + 0.60, 6) AS score FROM mt WHERE minutes >= 1",
        "cross_case_places": "WITH " + stored("a.case_id <> b.case_id AND a.loc = b.loc") + " SELECT la AS key, count(*) AS n_pairs, min(a_id) AS first_id, round(sum(minutes), 2) AS minutes FROM mt GROUP BY la",
        "copresence_entities": "WITH " + stored("a.case_id = b.case_id AND (a.loc = b.loc OR a.place = b.place)") + """, x AS (SELECT a_id, b_id, unnest(ua) AS a, ub, least(1.0, 0.5 + least(minutes, 60.0) / 120 + 0.3::DOUBLE * least(fa, fb)) AS score FROM mt), y AS (SELECT a, unnest(ub) AS b, score FROM x)
             SELECT least(a, b) AS p, greatest(a, b) AS q, count(*) AS n, round(max(score), 6) AS score FROM y WHERE lower(a) <> lower(b) AND trim(a) <> '' AND trim(b) <> '' GROUP BY ALL""",
        "active_period": with_("ev") + "SELECT pid, min(s) AS first_s, max(coalesce(e, s)) AS last_e, count(*) AS n_events FROM ev GROUP BY pid",
        "entity_sequence": with_("ev", "live", "q AS (SELECT pid, id, row_number() OVER w AS step, greatest(0.0, (s - lag(coalesce(e, s)) OVER w) / 6e7) AS minutes, lag(id) OVER w AS p FROM live WINDOW w AS (PARTITION BY pid ORDER BY s, id))")
        + """SELECT pid, id, step, round(minutes, 3) AS minutes, CASE WHEN step = 1 THEN 'Origin' WHEN minutes < 60 THEN floor(minutes)::BIGINT || ' min'
             WHEN minutes < 1440 THEN floor(minutes / 60)::BIGINT || ' h' ELSE floor(minutes / 1440)::BIGINT || ' d' END AS said FROM q""",
        "sessions_36h": with_("ev", "live", "q AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY pid ORDER BY s, id) > 129600000000 THEN 1 ELSE 0 END AS nw FROM live)",
                              "r AS (SELECT *, sum(nw) OVER (PARTITION BY pid ORDER BY s, id ROWS UNBOUNDED PRECEDING)::BIGINT + 1 AS session FROM q)")
        + """SELECT pid, session, min(s) AS s, max(e) AS e, count(*) AS n_events, count(DISTINCT loc) AS n_places,
             CASE WHEN count(*) >= 4 THEN 'HIGH' WHEN count(*) >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS intensity FROM r GROUP BY pid, session""",
        "overlap_pairs": with_("ev", "live", _PAIRS)
        + """SELECT loc, count(*) AS n_pairs, round(sum(minutes), 3) AS minutes, round(max(0.40::DOUBLE * least(1.0, minutes / 60)
               + 0.25::DOUBLE * CASE WHEN a_pr = 'EXACT' AND b_pr = 'EXACT' THEN 1.0 WHEN a_pr = 'MINUTE' OR b_pr = 'MINUTE' THEN 0.9 ELSE 0.7 END + 0.20
               + 0.15::DOUBLE * CASE WHEN a_st = 'APPROVED' AND b_st = 'APPROVED' THEN 1.0 ELSE 0.85 END), 6) AS best, max(a_id) AS last_a FROM pairs WHERE minutes >= 1 GROUP BY loc""",
        "copresence_pairs": with_("ev", "live", _PAIRS)
        + """SELECT least(a_pid, b_pid) AS p, greatest(a_pid, b_pid) AS q, count(*) AS n, round(max(least(1.0, 0.5 + least(minutes, 60.0) / 120 + 0.3::DOUBLE * least(a_conf, b_conf))), 6) AS score
             FROM pairs WHERE a_pid <> b_pid GROUP BY ALL""",
        "location_activity": with_("ev", "live", "place")
        + "SELECT p.loc, p.name, count(l.id) AS n_events, count(DISTINCT l.pid) AS n_people, min(l.s) AS first_s, max(l.s) AS last_s FROM place p LEFT JOIN live l ON l.loc = p.loc GROUP BY p.loc, p.name",
        "location_visits": with_("ev", "live") + "SELECT loc, pid, count(*) AS n, min(s) AS first_s, max(s) AS last_s FROM live GROUP BY loc, pid",
        "radius_search": with_("place", "q AS (SELECT *, 20.0::DOUBLE AS plat, 80.0::DOUBLE AS plon FROM place)", f"d AS (SELECT loc, {HAVERSINE_SQL.format(a='p', b='')} AS km FROM q)")
        + "SELECT loc, round(km, 4) AS km FROM d WHERE km <= 800",
        "travel_sequence": travel
        + """, v AS (SELECT *, (s - ps) / 3.6e9 AS hours FROM legs), k AS (SELECT *, CASE WHEN hours <= 1e-4 THEN 0.0 ELSE km / hours END AS kmh FROM v)
             SELECT pid, round(sum(coalesce(CASE WHEN ps IS NULL THEN 0.0 ELSE km END, 0.0)), 3) AS total_km, round(max(CASE WHEN ps IS NULL THEN NULL ELSE kmh END), 3) AS max_kmh,
             count(*) FILTER (ps IS NOT NULL AND km > 100 AND hours > 0 AND kmh > 900) AS n_implausible FROM k GROUP BY pid""",
        "implausible_travel": travel
        + """, v AS (SELECT *, (s - pe) / 3.6e9 AS hours FROM legs WHERE ps IS NOT NULL)
             SELECT pid, id, round(km, 4) AS km, round(hours, 6) AS hours FROM v WHERE km > 100 AND hours > 0 AND CASE WHEN hours <= 1e-4 THEN 0 ELSE km / hours END > 900""",
        "geo_outliers": with_("ev", "live", "place", _LOCATED, "f AS (SELECT *, first_value(lat) OVER w AS plat, first_value(lon) OVER w AS plon FROM located WINDOW w AS (PARTITION BY pid ORDER BY s, id))",
                              f"d AS (SELECT pid, {HAVERSINE_SQL.format(a='p', b='')} AS km FROM f)")
        + "SELECT pid, count(*) AS n, round(max(km), 4) AS km FROM d WHERE km >= 100 GROUP BY pid",
        "leader_clusters": with_("place", f"dist AS (SELECT a.case_id, a.loc, b.loc AS lead FROM place a JOIN (SELECT case_id, loc, lat AS plat, lon AS plon FROM place) b ON a.case_id = b.case_id AND b.loc <= a.loc WHERE {HAVERSINE_SQL.format(a='b.p', b='a.')} <= 1500)",
                                 "o AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY loc) AS rn FROM place)",
                                 """r(case_id, rn, leaders, leader) AS (SELECT case_id, rn, [loc], loc FROM o WHERE rn = 1
                                 UNION ALL SELECT o.case_id, o.rn, CASE WHEN f.l IS NULL THEN list_append(r.leaders, o.loc) ELSE r.leaders END, coalesce(f.l, o.loc)
                                 FROM r JOIN o ON o.case_id = r.case_id AND o.rn = r.rn + 1,
                                 LATERAL (SELECT min(d.lead) AS l FROM dist d WHERE d.loc = o.loc AND list_contains(r.leaders, d.lead)) f)""", recursive=True)
        + "SELECT r.case_id, leader, count(*) AS n, round(avg(o.lat), 4) AS lat, round(avg(o.lon), 4) AS lon FROM r JOIN o USING (case_id, rn) GROUP BY ALL",
        "detect_network": with_("rel", _DEG, _NET) + "SELECT id AS source, round(score, 6) AS score, CASE WHEN d >= 10 OR score >= 0.85 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM net",
        "detect_burst": with_("ev", "live", _BURST, recursive=True)
        + "SELECT k::VARCHAR AS source, s::VARCHAR AS window_key, round(least(0.92, 0.60 + 0.05::DOUBLE * n), 6) AS score, CASE WHEN n >= 8 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM burst",
        "detect_surge": with_("ev", "live", _SURGE, recursive=True)
        + "SELECT split_part(k, '~', 1) AS source, split_part(k, '~', 2) AS target, s::VARCHAR AS window_key, round(least(0.95, 0.65 + 0.05::DOUBLE * n), 6) AS score, CASE WHEN n >= 8 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM surge",
        "detect_spike": with_("ev", "live", _DAY) + "SELECT case_id::VARCHAR AS source, day::VARCHAR AS window_key, round(score, 6) AS score, CASE WHEN z >= 3 OR n >= 12 THEN 'CRITICAL' ELSE 'HIGH' END AS severity FROM spk",
        "detect_travel": travel
        + """, v AS (SELECT *, (s - pe) / 3.6e9 AS hours FROM legs WHERE ps IS NOT NULL), k AS (SELECT *, km / greatest(hours, 0.01) AS kmh FROM v WHERE km > 80 AND hours >= 0)
             SELECT pid::VARCHAR AS source, loc::VARCHAR AS place, s::VARCHAR AS window_key, CASE WHEN km > 100 AND kmh > 900 THEN 0.95::DOUBLE ELSE 0.78::DOUBLE END AS score,
             CASE WHEN km > 100 AND kmh > 900 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM k WHERE (km > 100 AND kmh > 900) OR (kmh > 400 AND hours < 1)""",
        "detect_velocity": travel
        + """, v AS (SELECT *, CASE WHEN s - ps <= 0 THEN 0.001 ELSE (s - ps) / 3.6e9 END AS hours FROM legs WHERE ps IS NOT NULL), k AS (SELECT *, km / hours AS kmh FROM v WHERE km >= 80)
             SELECT pid::VARCHAR AS source, loc::VARCHAR AS place, s::VARCHAR AS window_key, round(least(0.96, 0.70 + least(0.25, kmh / 2000 * 0.25)), 6) AS score,
             CASE WHEN kmh > 1000 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM k WHERE kmh > 800""",
        "detect_network_all": with_("ent", "rel", _DEG, """net AS (SELECT id, d, least(0.95, 0.60 + 0.08::DOUBLE * d / m) AS score FROM deg, (SELECT (SELECT sum(d) FROM deg)::DOUBLE / (SELECT count(*) FROM ent) AS m) WHERE d >= 5 AND (d >= 2.5 * m OR d >= 10))""")
        + "SELECT id AS source, round(score, 6) AS score, CASE WHEN d >= 10 OR score >= 0.85 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM net",
        "detect_geographic": with_("ev", "live", "place", _LOCATED, "f AS (SELECT *, first_value(lat) OVER w AS plat, first_value(lon) OVER w AS plon FROM located WINDOW w AS (PARTITION BY pid ORDER BY s, id))",
                                   f"d AS (SELECT pid, loc, max({HAVERSINE_SQL.format(a='p', b='')}) AS km FROM f GROUP BY pid, loc)")
        + "SELECT pid::VARCHAR AS source, loc::VARCHAR AS place, round(least(0.94, 0.65 + 0.2::DOUBLE * km / 500), 6) AS score, CASE WHEN km >= 300 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM d WHERE km >= 100",
        "detect_consistency": """SELECT 'TIME_INVERSION' AS alert_type, id AS source, 'MEDIUM' AS severity FROM (SELECT DISTINCT id, start_time_utc, end_time_utc FROM timeline_events) WHERE end_time_utc < start_time_utc
             UNION ALL SELECT 'BAD_COORDINATES', id, 'HIGH' FROM locations WHERE lat IS NOT NULL AND lon IS NOT NULL AND NOT (lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT isnan(lat) AND NOT isnan(lon))""",
        "detect_cross_case": """SELECT lower(name) AS source, count(DISTINCT linked_investigation_id)::VARCHAR AS target FROM entities
             WHERE name IS NOT NULL AND linked_investigation_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT linked_investigation_id) > 1""",
        "alerts_dedup": signals + "SELECT fingerprint, alert_type, source, round(score, 6) AS score, 2::BIGINT AS n_signals, round(round(priority, 4), 3) AS priority, severity FROM al2",
        "alert_summary": signals
        + """SELECT alert_type, count(*) AS n, count(*) FILTER (severity = 'CRITICAL') AS n_critical, count(*) FILTER (severity = 'HIGH') AS n_high, count(*) FILTER (severity = 'MEDIUM') AS n_medium
             FROM al2 GROUP BY alert_type""",
    }
