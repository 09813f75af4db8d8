"""Graph measures over the projected relationships."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import graph as G
from weftline.sources import canon
from weftline.sources.canon import with_


def _whole(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return canon.entities(spark, sf), canon.relationships(spark, sf)


def _linked(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The relationships and their ends."""
    e = canon.relationships(spark, sf)
    ends = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return ends.withColumn("type", F.when(F.startswith("id", F.lit("C")), "PERSON").otherwise("ORGANIZATION")), e


def case_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    v, e = G.subgraph(*_whole(spark, sf))
    return e.groupBy("dst").agg(F.count("*").alias("n_links"), F.min("src").alias("first_src"))


def degree_centrality(spark: SparkSession, sf: str) -> DataFrame:
    return G.degree(*_whole(spark, sf))


def degree_rank_top20(spark: SparkSession, sf: str) -> DataFrame:
    d = G.degree(*_whole(spark, sf)).where("degree > 0")
    top = d.orderBy(F.desc("degree"), "id").limit(20)
    return top.crossJoin(F.broadcast(d.agg(F.max("degree").alias("most")))).select("id", "degree", F.round(F.col("degree") / F.col("most"), 6).alias("score"))


def neighborhood_2hop(spark: SparkSession, sf: str) -> DataFrame:
    v, e = _whole(spark, sf)
    n = G.neighbourhood(e, v.where("type = 'ORGANIZATION' and risk = 'CRITICAL'").select("id"), 2)
    return n.groupBy("root", "hops").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def components(spark: SparkSession, sf: str) -> DataFrame:
    return G.components(*_linked(spark, sf))


def component_profile(spark: SparkSession, sf: str) -> DataFrame:
    v, e = _linked(spark, sf)
    return G.component_profile(v, e, G.components(v, e))


def communities(spark: SparkSession, sf: str) -> DataFrame:
    v, e = _linked(spark, sf)
    c = G.communities(e, G.components(v, e))
    return c.groupBy("community").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def closeness(spark: SparkSession, sf: str) -> DataFrame:
    return G.closeness_of(*_linked(spark, sf))


def betweenness(spark: SparkSession, sf: str) -> DataFrame:
    return G.betweenness_of(*_linked(spark, sf))


def pagerank_10(spark: SparkSession, sf: str) -> DataFrame:
    v, e = _linked(spark, sf)
    return G.pagerank(v, e, rounds=10, tolerance=None).select("id", F.round("rank", 9).alias("rank"))


def shortest_path_hops(spark: SparkSession, sf: str) -> DataFrame:
    v, e = _whole(spark, sf)
    start = v.where("type = 'ORGANIZATION'").agg(F.min("id").alias("start"))
    goals = v.where("type = 'ORGANIZATION'").select(F.col("id").alias("goal"))
    return G.shortest_hops(e, goals.crossJoin(F.broadcast(start)), 4)  # one row


def network_stats(spark: SparkSession, sf: str) -> DataFrame:
    return G.statistics(*_linked(spark, sf))


def shortest_path_nodes(spark: SparkSession, sf: str) -> DataFrame:
    v, e = _whole(spark, sf)
    org = v.where("type = 'ORGANIZATION'")
    pairs = org.select(F.col("id").alias("goal")).crossJoin(F.broadcast(org.agg(F.min("id").alias("start"))))  # one row
    return G.shortest_paths(e, pairs, 4).select("start", "goal", "hops", F.array_join("path", ">").alias("path"))


def shortest_path_edges(spark: SparkSession, sf: str) -> DataFrame:
    v, e = _whole(spark, sf)
    org = v.where("type = 'ORGANIZATION'")
    pairs = org.select(F.col("id").alias("goal")).crossJoin(F.broadcast(org.agg(F.min("id").alias("start"))))  # one row
    return G.path_edges(G.shortest_paths(e, pairs, 4), e).select("start", "goal", "step", "src", "dst")


def neighborhood_edges(spark: SparkSession, sf: str) -> DataFrame:
    v, e = _whole(spark, sf)
    near = G.neighbourhood(e, v.where("type = 'ORGANIZATION' and risk = 'CRITICAL'").select("id"), 2)
    return G.neighbourhood_edges(near, e).groupBy("root").agg(F.count("*").alias("n_edges"), F.min("src").alias("first_src"))


def incident_edges(spark: SparkSession, sf: str) -> DataFrame:
    v, e = _whole(spark, sf)
    return G.incident_edges(e, v.where("risk = 'CRITICAL'"), v).select("id", "direction", "other", "other_type")


def average_path_length(spark: SparkSession, sf: str) -> DataFrame:
    return G.average_path_length(*_linked(spark, sf))


def community_density(spark: SparkSession, sf: str) -> DataFrame:
    v, e = _linked(spark, sf)
    return G.community_profile(G.communities(e, G.components(v, e)), e)


def graph_run_top20(spark: SparkSession, sf: str) -> DataFrame:
    return G.top_nodes(G.analyse(*_linked(spark, sf)), "betweenness", 20)


def component_leads(spark: SparkSession, sf: str) -> DataFrame:
    return G.component_leads(G.analyse(*_linked(spark, sf), ("betweenness",)))


def top_closeness(spark: SparkSession, sf: str) -> DataFrame:
    return G.top_nodes(G.closeness_of(*_linked(spark, sf)), "closeness", 15)


def two_hop_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return G.fallback_leads(_linked(spark, sf)[1]).select("a", "b", "shared", F.round("score", 6).alias("score"))


def node_features(spark: SparkSession, sf: str) -> DataFrame:
    f = G.node_features(*_linked(spark, sf))
    return f.select("id", F.posexplode("f").alias("pos", "x")).where("x <> 0").select("id", "pos", F.round("x", 9).alias("x"))


def link_scores(spark: SparkSession, sf: str) -> DataFrame:
    s = G.link_scores(*_linked(spark, sf))
    return s.select("a", "b", "shared", F.round("score", 6).alias("score"))


_ALL = [case_subgraph, degree_centrality, degree_rank_top20, neighborhood_2hop, components, component_profile, communities, closeness, betweenness,
        pagerank_10, shortest_path_hops, shortest_path_nodes, shortest_path_edges, neighborhood_edges, incident_edges, average_path_length, community_density,
        graph_run_top20, component_leads, top_closeness, network_stats, two_hop_candidates, node_features, link_scores]


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


_ADJ = "adj AS (SELECT src AS a, dst AS b FROM rel UNION SELECT dst, src FROM rel)"
_REACH = "reach(s, v) AS (SELECT DISTINCT a, a FROM adj UNION SELECT r.s, j.b FROM reach r JOIN adj j ON j.a = r.v)"
_COMP = "comp AS (SELECT s AS id, min(v) AS component FROM reach GROUP BY s)"
#: Distances up to six hops, level by level (the projected graph has four at most).
_BFS = ",\n".join(
    ["l0 AS (SELECT DISTINCT a AS s, a AS v FROM adj)", "l1 AS (SELECT a AS s, b AS v FROM adj)"]
    + [f"l{k} AS (SELECT DISTINCT x.s, j.b AS v FROM l{k - 1} x JOIN adj j ON j.a = x.v EXCEPT (SELECT * FROM l{k - 1} UNION ALL SELECT * FROM l{k - 2}))" for k in range(2, 7)]
    + ["dist AS (" + " UNION ALL ".join(f"SELECT s, v, {k} AS d FROM l{k}" for k in range(7)) + ")"]
)
_N = "nn AS (SELECT count(DISTINCT a) AS n FROM adj)"
_DEG = "deg AS (SELECT a AS id, count(*) AS degree FROM adj GROUP BY a)"
_TWO = "two AS (SELECT x.b AS a, y.b AS b, count(*) AS shared FROM adj x JOIN adj y ON x.a = y.a AND x.b < y.b WHERE NOT EXISTS (SELECT 1 FROM adj e WHERE e.a = x.b AND e.b = y.b) GROUP BY ALL)"
_FEAT = """feat AS (SELECT d.id, [CASE WHEN id LIKE 'C%' THEN 1.0::DOUBLE ELSE 0 END, 0, 0, 0, CASE WHEN id LIKE 'S%' THEN 1.0::DOUBLE ELSE 0 END, 0, 0, 0, 0,
  degree::DOUBLE / greatest(n - 1, 1), CASE WHEN id LIKE 'S%' THEN 1.0::DOUBLE ELSE 0 END, CASE WHEN id LIKE 'C%' THEN 1.0::DOUBLE ELSE 0 END, 0, 0, 0, 0, 0.1::DOUBLE, 0, 0] AS f, degree FROM deg d, nn)"""


def oracle_sql() -> dict[str, str]:
    rel = lambda *x: with_("ent", "rel", _ADJ, *x, recursive=True)
    degree = """d AS (SELECT e.id, (SELECT count(*) FROM adj WHERE a = e.id) AS degree, (SELECT count(*) FROM rel WHERE dst = e.id) AS in_degree, (SELECT count(*) FROM rel WHERE src = e.id) AS out_degree FROM ent e)"""
    pr = ["pr0 AS (SELECT id, degree, 1.0::DOUBLE / n AS r FROM deg, nn)"] + [
        f"pr{k} AS (SELECT p.id, p.degree, 0.15::DOUBLE / n + 0.85::DOUBLE * (SELECT sum(q.r / q.degree) FROM adj j JOIN pr{k - 1} q ON q.id = j.b WHERE j.a = p.id) AS r FROM pr{k - 1} p, nn)" for k in range(1, 11)
    ]
    cm = """best AS (SELECT a, b AS lead, degree FROM (SELECT j.a, j.b, d.degree, row_number() OVER (PARTITION BY j.a ORDER BY d.degree DESC, j.b) AS r FROM adj j JOIN deg d ON d.id = j.b) WHERE r = 1),
      cm AS (SELECT c.id, component || '/' || CASE WHEN count(*) OVER (PARTITION BY component) <= 4 THEN component WHEN b.degree >= 2 THEN b.lead ELSE c.id END AS community FROM comp c LEFT JOIN best b ON b.a = c.id)"""
    near = """h0 AS (SELECT id AS root, id FROM ent WHERE type = 'ORGANIZATION' AND risk = 'CRITICAL'), h1 AS (SELECT DISTINCT root, b AS id FROM h0 JOIN adj ON a = id),
      h AS (SELECT * FROM h0 UNION SELECT * FROM h1 UNION SELECT DISTINCT root, b FROM h1 JOIN adj ON a = id)"""
    steps = ["p0 AS (SELECT min(id) AS v, [min(id)] AS p FROM ent WHERE type = 'ORGANIZATION')"] + [
        f"p{k} AS (SELECT b AS v, list_append(min(p), b) AS p FROM p{k - 1} JOIN adj ON a = v WHERE b NOT IN ({' UNION ALL '.join(f'SELECT v FROM p{i}' for i in range(k))}) GROUP BY b)" for k in range(1, 5)
    ] + ["pp AS (" + " UNION ALL ".join(f"SELECT v, p, {k}::INT AS hops FROM p{k}" for k in range(5)) + ")"]
    score = "round(CASE WHEN sum(d) > 0 THEN (count(*) - 1) / sum(d)::DOUBLE * (count(*) - 1) / greatest(1, any_value(n) - 1) ELSE 0 END, 4)"
    return {
        "shortest_path_nodes": rel(*steps) + "SELECT (SELECT v FROM p0) AS start, v AS goal, hops, array_to_string(p, '>') AS path FROM pp WHERE v IN (SELECT id FROM ent WHERE type = 'ORGANIZATION')",
        "shortest_path_edges": rel(*steps) + """SELECT (SELECT v FROM p0) AS start, v AS goal, i::INT AS step, src, dst FROM (SELECT *, unnest(range(1, len(p))) AS i FROM pp WHERE v IN (SELECT id FROM ent WHERE type = 'ORGANIZATION'))
             JOIN rel ON (src = p[i] AND dst = p[i + 1]) OR (src = p[i + 1] AND dst = p[i])""",
        "neighborhood_edges": rel(near) + "SELECT x.root, count(*) AS n_edges, min(src) AS first_src FROM rel JOIN h x ON x.id = src JOIN h y ON y.id = dst AND y.root = x.root GROUP BY x.root",
        "incident_edges": rel() + """SELECT x.id, direction, other, o.type AS other_type FROM (SELECT src AS id, 'OUT' AS direction, dst AS other FROM rel UNION ALL SELECT dst, 'IN', src FROM rel) x
             JOIN ent e ON e.id = x.id AND e.risk = 'CRITICAL' LEFT JOIN ent o ON o.id = other""",
        "average_path_length": rel(_BFS) + "SELECT round(sum(d) / count(*)::DOUBLE, 2) AS avg_path_length, count(*) AS n_pairs FROM dist WHERE d > 0",
        "community_density": rel(_REACH, _COMP, _DEG, cm) + """SELECT community, n_nodes, coalesce(n_edges, 0) AS n_edges, CASE WHEN n_nodes > 1 THEN round(coalesce(n_edges, 0) / (n_nodes * (n_nodes - 1) / 2.0::DOUBLE), 3) ELSE 0.0::DOUBLE END AS density
             FROM (SELECT community, count(*) AS n_nodes FROM cm GROUP BY 1) LEFT JOIN (SELECT x.community, count(*) AS n_edges FROM rel JOIN cm x ON x.id = src JOIN cm y ON y.id = dst AND x.community = y.community GROUP BY 1) USING (community)""",
        "top_closeness": rel(_BFS, _N) + f"SELECT s AS id, {score} AS closeness FROM dist, nn GROUP BY s ORDER BY closeness DESC, id LIMIT 15",
        "case_subgraph": rel() + "SELECT dst, count(*) AS n_links, min(src) AS first_src FROM rel WHERE src IN (SELECT id FROM ent WHERE status = 'VERIFIED') AND dst IN (SELECT id FROM ent WHERE status = 'VERIFIED') GROUP BY dst",
        "degree_centrality": rel(degree) + "SELECT id, degree, round(degree::DOUBLE / greatest((SELECT count(*) FROM ent) - 1, 1), 4) AS normalised, in_degree, out_degree FROM d",
        "degree_rank_top20": rel(degree) + "SELECT id, degree, round(degree::DOUBLE / (SELECT max(degree) FROM d), 6) AS score FROM d WHERE degree > 0 ORDER BY degree DESC, id LIMIT 20",
        "neighborhood_2hop": rel("h0 AS (SELECT id AS root, id FROM ent WHERE type = 'ORGANIZATION' AND risk = 'CRITICAL')",
                                  "h1 AS (SELECT DISTINCT root, b AS id FROM h0 JOIN adj ON a = id WHERE b <> root)",
                                  "h2 AS (SELECT DISTINCT root, b AS id FROM h1 JOIN adj ON a = id WHERE b <> root AND NOT EXISTS (SELECT 1 FROM h1 x WHERE x.root = h1.root AND x.id = b))")
        + "SELECT root, hops, count(*) AS n, min(id) AS first_id FROM (SELECT root, id, 0::INT AS hops FROM h0 UNION ALL SELECT root, id, 1 FROM h1 UNION ALL SELECT root, id, 2 FROM h2) GROUP BY root, hops",
        "components": rel(_REACH, _COMP) + "SELECT id, component FROM comp",
        "component_profile": rel(_REACH, _COMP, _DEG)
        + """SELECT component, count(*) AS n_nodes, (SELECT count(*) FROM rel JOIN comp c2 ON c2.id = src WHERE c2.component = c.component) AS n_edges,
             (SELECT string_agg(id, ',' ORDER BY degree DESC, id) FROM (SELECT d.id, d.degree FROM comp c3 JOIN deg d USING (id) WHERE c3.component = c.component ORDER BY degree DESC, d.id LIMIT 3)) AS top FROM comp c GROUP BY component""",
        "communities": rel(_REACH, _COMP, _DEG, "best AS (SELECT a, b AS lead, degree FROM (SELECT j.a, j.b, d.degree, row_number() OVER (PARTITION BY j.a ORDER BY d.degree DESC, j.b) AS r FROM adj j JOIN deg d ON d.id = j.b) WHERE r = 1)",
                              "cm AS (SELECT c.id, component || '/' || CASE WHEN count(*) OVER (PARTITION BY component) <= 4 THEN component WHEN b.degree >= 2 THEN b.lead ELSE c.id END AS community FROM comp c LEFT JOIN best b ON b.a = c.id)")
        + "SELECT community, count(*) AS n, min(id) AS first_id FROM cm GROUP BY community",
        "closeness": rel(_BFS, _N) + "SELECT s AS id, round(CASE WHEN sum(d) > 0 THEN (count(*) - 1) / sum(d)::DOUBLE * (count(*) - 1) / greatest(1, any_value(n) - 1) ELSE 0 END, 4) AS closeness FROM dist, nn GROUP BY s",
        "pagerank_10": rel(_DEG, _N, *pr) + "SELECT id, round(r, 9) AS rank FROM pr10",
        "shortest_path_hops": rel("hop(v, k) AS (SELECT min(id), 0 FROM ent WHERE type = 'ORGANIZATION' UNION SELECT j.b, h.k + 1 FROM hop h JOIN adj j ON j.a = h.v WHERE h.k < 4)")
        + "SELECT (SELECT min(id) FROM ent WHERE type = 'ORGANIZATION') AS start, v AS goal, min(k)::INT AS hops FROM hop WHERE v IN (SELECT id FROM ent WHERE type = 'ORGANIZATION') GROUP BY v",
        "network_stats": rel(_N) + """SELECT n AS n_nodes, m AS n_edges, round(2 * m / n::DOUBLE, 2) AS avg_degree, round(m / (n::DOUBLE * (n - 1) / 2), 6) AS density FROM nn, (SELECT count(*) AS m FROM rel)""",
        "two_hop_candidates": rel(_TWO) + """SELECT a, b, shared, round(least(0.96, 0.50::DOUBLE * least(0.95, 0.72 + 0.08::DOUBLE * shared) + 0.35::DOUBLE * least(1.0, 0.4::DOUBLE * shared) + 0.10), 6) AS score FROM two""",
        "node_features": rel(_DEG, _N, _FEAT) + "SELECT id, (i - 1)::INT AS pos, round(f[i], 9) AS x FROM feat, generate_series(1, 19) t(i) WHERE f[i] <> 0",
        "link_scores": rel(_DEG, _N, _FEAT, _TWO, """sc AS (SELECT t.a, t.b, shared, greatest(0.10, least(0.98, 0.50::DOUBLE * (list_cosine_similarity(x.f, y.f) + 1) / 2 + 0.35::DOUBLE * least(1.0, 0.35::DOUBLE * shared)
             + 0.15::DOUBLE * shared / (x.degree + y.degree - shared))) AS score FROM two t JOIN feat x ON x.id = t.a JOIN feat y ON y.id = t.b)""")
        + "SELECT a, b, shared, round(score, 6) AS score FROM sc WHERE score >= 0.5",
    }
