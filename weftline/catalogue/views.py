"""Smaller views: profiles, cross-case networks, formats, ledger pages, sequence highlights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import formats as N
from weftline.operators import relational as R
from weftline.operators.spans import micros
from weftline.sources import canon
from weftline.sources.canon import with_
from weftline.sources.tables import table


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "timeline_events").select("id", "case_id", "start_time_utc", "end_time_utc", "time_precision", "location_entity_id", "related_entity_ids", "verification_status").dropDuplicates(["id"])


def elapsed_formats(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).where("end_time_utc >= start_time_utc")
    return e.select(N.elapsed(micros("end_time_utc") - micros("start_time_utc")).alias("elapsed")).groupBy("elapsed").agg(F.count("*").alias("n"))


def time_at_precision(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).select("id", N.at_precision(F.col("start_time_utc"), F.col("time_precision")).alias("shown"))


def case_numbers(spark: SparkSession, sf: str) -> DataFrame:
    i = table(spark, sf, "investigations").where("district is not null").groupBy("id").agg(F.max("district").alias("district"), F.max("created_at").alias("created_at"))
    seq = F.row_number().over(W.partitionBy("district").orderBy("id"))
    return i.where("created_at is not null").select("id", N.case_number("CR", F.col("district"), F.year("created_at"), seq).alias("case_number"))


def entity_locations(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).where("location_entity_id is not null").select(F.explode(F.array_distinct("related_entity_ids")).alias("entity_id"), "location_entity_id", "start_time_utc")
    g = e.where("entity_id is not null").groupBy("entity_id", "location_entity_id").agg(F.count("*").alias("n_visits"), F.min("start_time_utc").alias("first_seen"))
    return g.join(table(spark, sf, "locations").select(F.col("id").alias("location_entity_id"), "city"), "location_entity_id", "left")


def mention_timeline(spark: SparkSession, sf: str) -> DataFrame:
    """Events that name both of two entities: the pairs with the most joint events."""
    e = _events(spark, sf).select("id", F.array_sort(F.array_distinct(F.filter("related_entity_ids", lambda x: x.isNotNull()))).alias("ids"))
    pairs = e.select("id", F.posexplode("ids").alias("i", "a"), "ids").select("id", "a", F.explode(F.expr("slice(ids, i + 2, size(ids))")).alias("b"))
    return R.top_k(pairs.groupBy("a", "b").agg(F.count("*").alias("n_joint"), F.min("id").alias("first_id")), [F.desc("n_joint"), F.asc("a"), F.asc("b")], 20)


def sequence_highlights(spark: SparkSession, sf: str) -> DataFrame:
    """The first ten steps of each participant with the signed minutes since the step before."""
    w = W.partitionBy("pid").orderBy("s", "id")
    ev = canon.live(canon.events(spark, sf)).withColumn("step", F.row_number().over(w)).withColumn("m", F.floor((F.col("s") - F.lag("e").over(w)) / 60_000_000)).where("step <= 10")
    said = F.when(F.col("step") == 1, "T-0").when(F.abs("m") < 60, F.concat(F.col("m").cast("string"), F.lit("m"))).otherwise(F.concat(F.floor(F.col("m") / 60).cast("string"), F.lit("h")))
    return ev.select("pid", "id", F.col("step").cast("bigint").alias("step"), said.alias("delta"))


def cross_case_network(spark: SparkSession, sf: str) -> DataFrame:
    """Accepted matches whose entities belong to different cases, counted per pair of cases."""
    ent = table(spark, sf, "entities").where("linked_investigation_id is not null").groupBy("entity_id").agg(F.min("linked_investigation_id").alias("c"))
    ok = F.lower(F.regexp_replace("status", r"[\s_]+", "")) == "acceptedrepresentation"
    m = table(spark, sf, "resolution_candidates").where(ok).select("mention_a", "mention_b").distinct()
    j = m.join(ent.select(F.col("entity_id").alias("mention_a"), F.col("c").alias("ca")), "mention_a").join(ent.select(F.col("entity_id").alias("mention_b"), F.col("c").alias("cb")), "mention_b")
    return j.where("ca <> cb").groupBy(F.least("ca", "cb").alias("case_a"), F.greatest("ca", "cb").alias("case_b")).agg(F.count("*").alias("n_links"))


def entity_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Latest row of each entity with its nodes and candidates."""
    e = R.newest(table(spark, sf, "entities").select("entity_id", "name", "risk", "ingested_at", "id"), ["entity_id"], "ingested_at", "id").select("entity_id", "risk")
    n = table(spark, sf, "graph_nodes").select("id", "entity_id").distinct().groupBy("entity_id").agg(F.count("*").alias("n_nodes"))
    c = table(spark, sf, "resolution_candidates").select("id", F.explode(F.array_distinct(F.array("mention_a", "mention_b"))).alias("entity_id")).distinct().groupBy("entity_id").agg(F.count("*").alias("n_candidates"))
    return e.join(n, "entity_id", "left").join(c, "entity_id", "left").na.fill(0, ["n_nodes", "n_candidates"])


def investigation_search(spark: SparkSession, sf: str) -> DataFrame:
    i = table(spark, sf, "investigations").select("id", "case_number", "title", "district").distinct()
    return R.search(i, "cargo", ["title", "case_number", "district"]).select("id", "title")


_ALL = [elapsed_formats, time_at_precision, case_numbers, entity_locations, mention_timeline, sequence_highlights, cross_case_network, entity_profile, investigation_search]


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


_EV = "e AS (SELECT DISTINCT ON (id) * FROM timeline_events)"


def oracle_sql() -> dict[str, str]:
    return {
        "elapsed_formats": f"""WITH {_EV}, m AS (SELECT (epoch_us(end_time_utc) - epoch_us(start_time_utc)) // 60000000 AS m FROM e WHERE end_time_utc >= start_time_utc)
             SELECT CASE WHEN m >= 1440 THEN '+' || (m // 1440) || 'd ' || (m // 60 % 24) || 'h' WHEN m >= 60 THEN '+' || (m // 60) || 'h ' || (m % 60) || 'm' ELSE '+' || greatest(m, 1) || 'm' END AS elapsed, count(*) AS n FROM m GROUP BY 1""",
        "time_at_precision": f"""WITH {_EV} SELECT id, CASE WHEN start_time_utc IS NULL OR upper(time_precision) = 'UNKNOWN' THEN 'Time unavailable' WHEN upper(time_precision) IN ('DAY', 'DATE_ONLY') THEN strftime(start_time_utc, '%Y-%m-%d')
             WHEN upper(time_precision) = 'MONTH' THEN strftime(start_time_utc, '%Y-%m') ELSE strftime(start_time_utc, '%Y-%m-%d %H:%M') END AS shown FROM e""",
        "case_numbers": """WITH i AS (SELECT id, max(district) AS d, max(created_at) AS t FROM investigations WHERE district IS NOT NULL GROUP BY id)
             SELECT id, 'CR-' || upper(left(regexp_replace(d, '[^A-Za-z]', '', 'g'), 3)) || '-' || year(t) || '-' || lpad((row_number() OVER (PARTITION BY d ORDER BY id))::VARCHAR, 4, '0') AS case_number FROM i WHERE t IS NOT NULL""",
        "entity_locations": f"""WITH {_EV}, x AS (SELECT DISTINCT id, unnest(related_entity_ids) AS entity_id, location_entity_id, start_time_utc FROM e WHERE location_entity_id IS NOT NULL)
             SELECT entity_id, location_entity_id, count(*) AS n_visits, min(start_time_utc) AS first_seen, any_value(l.city) AS city FROM x LEFT JOIN locations l ON l.id = location_entity_id WHERE entity_id IS NOT NULL GROUP BY 1, 2""",
        "mention_timeline": f"""WITH {_EV}, x AS (SELECT DISTINCT id, unnest(related_entity_ids) AS v FROM e)
             SELECT p.v AS a, q.v AS b, count(*) AS n_joint, min(p.id) AS first_id FROM x p JOIN x q ON p.id = q.id AND p.v < q.v GROUP BY 1, 2 ORDER BY n_joint DESC, a, b LIMIT 20""",
        "sequence_highlights": with_("ev", "live", "q AS (SELECT pid, id, row_number() OVER w AS step, floor((s - lag(e) OVER w) / 6e7)::BIGINT AS m FROM live WINDOW w AS (PARTITION BY pid ORDER BY s, id))")
        + "SELECT pid, id, step, CASE WHEN step = 1 THEN 'T-0' WHEN abs(m) < 60 THEN m || 'm' ELSE floor(m / 60.0)::BIGINT || 'h' END AS delta FROM q WHERE step <= 10",
        "cross_case_network": r"""WITH c AS (SELECT entity_id, min(linked_investigation_id) AS c FROM entities WHERE linked_investigation_id IS NOT NULL GROUP BY 1),
             m AS (SELECT DISTINCT mention_a, mention_b FROM resolution_candidates WHERE lower(regexp_replace(status, '[\s_]+', '', 'g')) = 'acceptedrepresentation')
             SELECT least(x.c, y.c) AS case_a, greatest(x.c, y.c) AS case_b, count(*) AS n_links FROM m JOIN c x ON x.entity_id = mention_a JOIN c y ON y.entity_id = mention_b WHERE x.c <> y.c GROUP BY 1, 2""",
        "entity_profile": """WITH e AS (SELECT entity_id, risk FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ingested_at DESC, id DESC) AS r FROM entities) WHERE r = 1)
             SELECT entity_id, risk, (SELECT count(DISTINCT id) FROM graph_nodes g WHERE g.entity_id = e.entity_id) AS n_nodes,
             (SELECT count(DISTINCT id) FROM resolution_candidates c WHERE c.mention_a = e.entity_id OR c.mention_b = e.entity_id) AS n_candidates FROM e""",
        "investigation_search": "SELECT id, title FROM (SELECT DISTINCT id, case_number, title, district FROM investigations) WHERE contains(lower(title), 'cargo') OR contains(lower(case_number), 'cargo') OR contains(lower(district), 'cargo')",
    }
