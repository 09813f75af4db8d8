"""Queries of the general data problems (p1, p3, p4) over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import instants, orphans, spans
from weftline.sources.tables import table

#: (table, its record id, the reference, parent table, parent key)
REFERENCES = (
    ("investigations", "id", "lead_officer_id", "users", "id"),
    ("entities", "entity_id", "linked_investigation_id", "investigations", "id"),
    ("graph_nodes", "id", "entity_id", "entities", "entity_id"),
)


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.find_orphans(
        [orphans.Reference(name, table(spark, sf_dir, name), rid, ref, table(spark, sf_dir, parent), key) for name, rid, ref, parent, key in REFERENCES]
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("ref_table", "record_id", "ref_month")


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "timeline_events").select(
        F.explode(F.array_distinct("related_entity_ids")).alias("entity_id"), "start_time_utc", "end_time_utc"
    )
    return spans.covered_and_gaps(events, "entity_id", "start_time_utc", "end_time_utc")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = instants.normalise(
        table(spark, sf_dir, "temporal_requests"), key="request_id", text="text", zone="zone_name", reference="reference_date"
    )
    answered = instants.normalise(table(spark, sf_dir, "temporal_responses"), key="request_id", text="start_time_utc")
    return (
        asked.select(F.lit("text").alias("field_name"), "request_id", "utc_us")
        .unionByName(answered.select(F.lit("start_time_utc").alias("field_name"), "request_id", "utc_us"))
        .distinct()
    )


_P1_CASES = """
WITH kids AS (
  SELECT 'investigations' t, id rid, lead_officer_id ref, created_at, ingested_at FROM investigations
  UNION ALL SELECT 'entities', entity_id, linked_investigation_id, created_at, ingested_at FROM entities
  UNION ALL SELECT 'graph_nodes', id, entity_id, created_at, ingested_at FROM graph_nodes),
rec AS (SELECT t, rid, lower(trim(ref)) k, min(ingested_at) seen, min(created_at) created FROM kids
  WHERE rid IS NOT NULL AND trim(ref) <> '' GROUP BY ALL),
par AS (
  SELECT 'investigations' t, lower(trim(id)) k, min(ingested_at) seen, min(deleted_at) del FROM users GROUP BY ALL
  UNION ALL SELECT 'entities', lower(trim(id)), min(ingested_at), min(deleted_at) FROM investigations GROUP BY ALL
  UNION ALL SELECT 'graph_nodes', lower(trim(entity_id)), min(ingested_at), min(deleted_at) FROM entities GROUP BY ALL),
cases AS (SELECT r.t AS ref_table, r.rid AS record_id, coalesce(strftime(r.created, '%Y-%m'), 'unknown') AS ref_month,
    CASE WHEN p.k IS NULL THEN 'missing' WHEN p.del <= r.seen THEN 'deleted' WHEN p.seen > r.seen THEN 'late' END AS reason
  FROM rec r LEFT JOIN par p ON p.t = r.t AND p.k = r.k)
"""

_P3 = """
WITH ev AS (SELECT DISTINCT unnest(related_entity_ids) AS entity_id, epoch_us(start_time_utc) s, epoch_us(end_time_utc) e
  FROM timeline_events WHERE end_time_utc >= start_time_utc),
o AS (SELECT *, max(e) OVER (PARTITION BY entity_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) pe
  FROM ev WHERE entity_id IS NOT NULL),
g AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY entity_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) n FROM o),
c AS (SELECT entity_id, n, min(s) s, max(e) e FROM g GROUP BY ALL),
l AS (SELECT *, lead(s) OVER (PARTITION BY entity_id ORDER BY n) nx FROM c)
SELECT entity_id, 'covered' AS span_kind, s AS start_us, e AS end_us FROM l
UNION ALL SELECT entity_id, 'gap', e, nx FROM l WHERE nx IS NOT NULL
"""


def queries() -> dict:
    return {"p1_found": p1_found, "p1_report": p1_report, "p3_found": p3_found, "p4_found": p4_found}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1_CASES + "SELECT ref_table, record_id, ref_month FROM cases WHERE reason IS NOT NULL",
        "p1_report": _P1_CASES
        + "SELECT ref_table, ref_month, reason, count(*)::BIGINT AS n_orphans FROM cases WHERE reason IS NOT NULL GROUP BY ALL",
        "p3_found": _P3,
    }
