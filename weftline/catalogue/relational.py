"""Scans, filters, lookups, joins, counts, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import relational as R
from weftline.sources import canon
from weftline.sources.canon import with_
from weftline.sources.tables import table


def scan_filter_multi(spark: SparkSession, sf: str) -> DataFrame:
    ev = canon.events(spark, sf)
    return R.where_given(ev, equal={"kind": "Error", "status": "ALL", "case_id": 2}, at_least={"s": 1_704_585_600_000_000}, at_most={"e": 1_705_881_600_000_000}).select("id", "pid", "kind", "s", "e")


def substring_search_degree(spark: SparkSession, sf: str) -> DataFrame:
    hits = R.search(canon.entities(spark, sf), "00012", ["name", "id"])
    rel = canon.relationships(spark, sf)
    ends = rel.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return hits.join(ends, "id", "left").select("id", "name", F.coalesce("degree", F.lit(0)).alias("degree"))


def kpi_summary(spark: SparkSession, sf: str) -> DataFrame:
    rel = canon.relationships(spark, sf)
    return (
        canon.entities(spark, sf)
        .join(rel.select(F.col("src").alias("id")).distinct().withColumn("linked", F.lit(True)), "id", "left")
        .groupBy("case_id")
        .agg(
            F.count("*").alias("n_entities"),
            F.count_if(F.col("risk") == "CRITICAL").alias("n_critical"),
            F.count_if(F.col("status") == "VERIFIED").alias("n_verified"),
            F.count_if(F.col("linked")).alias("n_linked"),
            F.count_distinct("district").alias("n_districts"),
        )
    )


def type_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return R.histogram(table(spark, sf, "entities").select("entity_id", "type").distinct(), "type")


def fk_enrich(spark: SparkSession, sf: str) -> DataFrame:
    cust = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    nation, region = (F.broadcast(table(spark, sf, t)) for t in ("nation", "region"))  # fixed sizes
    return (
        table(spark, sf, "orders")
        .join(cust, F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .groupBy("r_name", "n_name")
        .agg(F.count("*").alias("n_orders"), F.count_distinct("c_custkey").alias("n_customers"), F.max("o_orderkey").alias("last_order"))
    )


def membership_edges(spark: SparkSession, sf: str) -> DataFrame:
    ok = canon.entities(spark, sf).where("status = 'VERIFIED'").select("id")
    rel = canon.relationships(spark, sf)
    return rel.join(ok.withColumnRenamed("id", "src"), "src", "left_semi").join(ok.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


def unledgered_docs(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return docs.join(table(spark, sf, "review_labels").select("doc_id").distinct(), "doc_id", "left_anti")


def active_and_latest(spark: SparkSession, sf: str) -> DataFrame:
    ev = canon.live(canon.events(spark, sf))
    return R.newest(ev.select("pid", "id", "kind", "s"), ["pid"], "s", "id")


def timeline_page(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "timeline_events").select("id", "case_id", F.upper("event_type").alias("kind"), "start_time_utc", "created_at_utc").distinct()
    order = [F.asc_nulls_first("start_time_utc"), F.asc("created_at_utc"), F.asc("id")]
    return R.page(ev, order, 3, 50).select("id", "kind")


def page_clamped(spark: SparkSession, sf: str) -> DataFrame:
    return R.page(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 0, 5000, most=200)


def priority_queue(spark: SparkSession, sf: str) -> DataFrame:
    first = F.when(F.upper("priority") == "CRITICAL", 2).when(F.upper("priority") == "HIGH", 1).otherwise(0)
    inv = table(spark, sf, "investigations").groupBy("id").agg(F.max("priority").alias("priority"), F.max("created_at").alias("created_at"))
    return R.top_k(inv, [first.desc(), F.desc_nulls_last("created_at"), F.asc("id")], 6).select("id", "priority")


def set_union_existing_wins(spark: SparkSession, sf: str) -> DataFrame:
    a, b = canon.relationships(spark, sf, rare=True), canon.relationships(spark, sf)
    new = R.without_known_pairs(b.select(F.col("dst").alias("src"), F.col("src").alias("dst")), a, "src", "dst")
    return a.withColumn("origin", F.lit("stored")).unionByName(new.withColumn("origin", F.lit("added")))


def upsert_nodes(spark: SparkSession, sf: str) -> DataFrame:
    old = canon.entities(spark, sf).select("id", "name", "risk")
    new = old.where("risk = 'CRITICAL'").withColumn("risk", F.lit("REVIEW"))
    return R.upsert(old, new, ["id"]).groupBy("risk").agg(F.count("*").alias("n"))


def upsert_edges(spark: SparkSession, sf: str) -> DataFrame:
    known = canon.entities(spark, sf).where("status = 'VERIFIED'").select("id")
    old = canon.relationships(spark, sf, rare=True).select("src", F.lit("PAID").alias("type"), "dst", F.lit("old").alias("origin"))
    new = canon.relationships(spark, sf).select("src", F.lit("PAID").alias("type"), "dst", F.lit("new").alias("origin"))
    return R.upsert_edges(old, new, known).groupBy("origin").agg(F.count("*").alias("n"))


def cosine_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Cosine of each vector with the mean of its label, rescaled to [0, 1]."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    means = (
        e.select("label", F.posexplode("v").alias("i", "x"))
        .groupBy("label", "i")
        .agg(F.avg("x").alias("x"))
        .groupBy("label")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s.x).alias("m"))
    )
    return e.join(means, "label").select("vec_id", F.round(R.cosine01(F.col("v"), F.col("m")), 6).alias("cos"))


def classifier_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "review_labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    rows = rows.where("label is not null").select((F.col("label") != "none").cast("int").alias("y"), F.col("n_chars").cast("double").alias("score"))
    m = R.classifier_metrics(rows, "y", "score", 500.0)
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


def queries() -> dict:
    names = [scan_filter_multi, substring_search_degree, kpi_summary, type_histogram, fk_enrich, membership_edges, unledgered_docs, active_and_latest,
             timeline_page, page_clamped, priority_queue, set_union_existing_wins, upsert_nodes, upsert_edges, cosine_pairs, classifier_metrics]
    return {f.__name__: f for f in names}


def oracle_sql() -> dict[str, str]:
    return {
        "scan_filter_multi": with_("ev") + "SELECT id, pid, kind, s, e FROM ev WHERE upper(kind) = 'ERROR' AND case_id = 2 AND s >= 1704585600000000 AND e <= 1705881600000000",
        "substring_search_degree": with_("ent", "rel")
        + """SELECT e.id, e.name, coalesce(d.n, 0) AS degree FROM ent e LEFT JOIN
             (SELECT id, count(*) n FROM (SELECT src id FROM rel UNION ALL SELECT dst FROM rel) GROUP BY id) d ON d.id = e.id
             WHERE contains(lower(e.name), '00012') OR contains(lower(e.id), '00012')""",
        "kpi_summary": with_("ent", "rel")
        + """SELECT case_id, count(*) AS n_entities, count(*) FILTER (risk = 'CRITICAL') AS n_critical, count(*) FILTER (status = 'VERIFIED') AS n_verified,
             count(*) FILTER (id IN (SELECT src FROM rel)) AS n_linked, count(DISTINCT district) AS n_districts FROM ent GROUP BY case_id""",
        "type_histogram": "SELECT upper(type) AS type, count(*) AS n FROM (SELECT DISTINCT entity_id, type FROM entities) GROUP BY 1",
        "fk_enrich": """SELECT r_name, n_name, count(*) AS n_orders, count(DISTINCT c_custkey) AS n_customers, max(o_orderkey) AS last_order
             FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
             GROUP BY ALL""",
        "membership_edges": with_("ent", "rel") + "SELECT src, dst FROM rel WHERE src IN (SELECT id FROM ent WHERE status = 'VERIFIED') AND dst IN (SELECT id FROM ent WHERE status = 'VERIFIED')",
        "unledgered_docs": "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM review_labels r WHERE r.doc_id = d.doc_id)",
        "active_and_latest": with_("ev", "live") + "SELECT pid, id, kind, s FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY s DESC, id DESC) r FROM live) WHERE r = 1",
        "timeline_page": """SELECT id, upper(event_type) AS kind FROM (SELECT DISTINCT id, case_id, upper(event_type) event_type, start_time_utc, created_at_utc FROM timeline_events)
             ORDER BY start_time_utc ASC NULLS FIRST, created_at_utc, id LIMIT 50 OFFSET 100""",
        "page_clamped": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 200",
        "priority_queue": """SELECT id, priority FROM (SELECT id, max(priority) priority, max(created_at) created_at FROM investigations GROUP BY id)
             ORDER BY CASE upper(priority) WHEN 'CRITICAL' THEN 2 WHEN 'HIGH' THEN 1 ELSE 0 END DESC, created_at DESC NULLS LAST, id LIMIT 6""",
        "set_union_existing_wins": with_("rel", "rare")
        + """SELECT src, dst, 'stored' AS origin FROM rare UNION ALL
             SELECT least(src, dst), greatest(src, dst), 'added' FROM rel w WHERE NOT EXISTS (SELECT 1 FROM rare n WHERE n.src = w.src AND n.dst = w.dst)""",
        "upsert_nodes": with_("ent") + "SELECT CASE WHEN risk = 'CRITICAL' THEN 'REVIEW' ELSE risk END AS risk, count(*) AS n FROM ent GROUP BY 1",
        "upsert_edges": with_("ent", "rel", "rare", "ok AS (SELECT w.* FROM rel w WHERE src IN (SELECT id FROM ent WHERE status = 'VERIFIED') AND dst IN (SELECT id FROM ent WHERE status = 'VERIFIED'))")
        + "SELECT origin, count(*) AS n FROM (SELECT 'new' origin FROM ok UNION ALL SELECT 'old' FROM rare n WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.src = n.src AND ok.dst = n.dst)) GROUP BY 1",
        "cosine_pairs": """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
             c AS (SELECT label, list(x ORDER BY i) AS m FROM (SELECT label, i, avg(v[i]) AS x FROM e, generate_series(1, 64) t(i) GROUP BY ALL) GROUP BY label)
             SELECT vec_id, round((list_cosine_similarity(v, m) + 1) / 2, 6) AS cos FROM e JOIN c USING (label)""",
        "classifier_metrics": """WITH x AS (SELECT (label <> 'none')::INT AS y, n_chars::DOUBLE AS s FROM review_labels JOIN documents USING (doc_id) WHERE label IS NOT NULL),
             pr AS (SELECT a.y, a.s, (SELECT count(*) FROM x b WHERE b.s >= a.s) n, (SELECT sum(b.y) FROM x b WHERE b.s >= a.s) tp,
                    (SELECT count(*) FILTER (b.s < a.s) + 0.5 * count(*) FILTER (b.s = a.s) FROM x b WHERE b.y = 0) below FROM x a),
             t AS (SELECT sum(y)::DOUBLE p, count(*)::DOUBLE n, sum(y) FILTER (s >= 500)::DOUBLE tp, count(*) FILTER (s >= 500)::DOUBLE called FROM x)
             SELECT round((SELECT sum(below)::DOUBLE FROM pr WHERE y = 1) / (p * (n - p)), 6) AS roc_auc, round((SELECT sum(tp / n::DOUBLE) FROM pr WHERE y = 1) / p, 6) AS average_precision,
             round(tp / called, 6) AS precision, round(tp / p, 6) AS recall, round(2 * tp / (called + p), 6) AS f1 FROM t""",
    }
