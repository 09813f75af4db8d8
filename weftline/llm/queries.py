"""Queries of the training-data problems tagged llm, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import components, leakage, names, packing, toxicity
from weftline.sources.tables import table

# -- 2: variant spellings of names -----------------------------------------------------------------


def _name_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.link_names(table(spark, sf_dir, "entities"), table(spark, sf_dir, "given_aliases"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.linked_pairs(_name_links(spark, sf_dir))


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _name_links(spark, sf_dir).select("entity_id", "kind", "group_id").distinct()


# -- 5: consolidating pairwise matches ------------------------------------------------------------


def _accepted():
    return F.lower(F.regexp_replace("status", r"[\s_]+", "")) == "acceptedrepresentation"


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = components.group_matches(table(spark, sf_dir, "resolution_candidates"), a="mention_a", b="mention_b", accepted=_accepted())
    return groups.select(F.col("id").alias("entity_id"), "group_id")


def p5_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_found(spark, sf_dir).groupBy("group_id").agg(F.count("*").alias("n_members"))


# -- 6: filling fixed-capacity containers ------------------------------------------------------------


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_sizes"))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.containers(_packed(spark, sf_dir))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(_packed(spark, sf_dir))


# -- 7: evaluation texts leaking into training text -------------------------------------------------


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p7_items_leaked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.items_leaked(_leaks(spark, sf_dir))


def p7_kept_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return leakage.drop_leaking(docs, _leaks(spark, sf_dir))


# -- 8: abusive, hateful or sexual content -----------------------------------------------------------


def _scores(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "review_labels"), keep=keep)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).where("flagged").select("doc_id").distinct()


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir)


def p8_rate_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rates(_scores(spark, sf_dir, "source"), "source")


_P5 = r"""
WITH RECURSIVE e AS (
  SELECT DISTINCT unnest([mention_a, mention_b]) a, unnest([mention_b, mention_a]) b FROM resolution_candidates
  WHERE lower(regexp_replace(status, '[\s_]+', '', 'g')) = 'acceptedrepresentation' AND mention_a IS NOT NULL AND mention_b IS NOT NULL),
r(id, other) AS (SELECT a, b FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.other),
m AS (SELECT DISTINCT id FROM (SELECT unnest([mention_a, mention_b]) id FROM resolution_candidates) WHERE id IS NOT NULL),
g AS (SELECT m.id, least(m.id, min(r.other)) gid FROM m LEFT JOIN r ON r.id = m.id GROUP BY m.id)
"""


def queries() -> dict:
    return {"p2_found": p2_found, "p2_classes": p2_classes} | {"p5_found": p5_found, "p5_group_sizes": p5_group_sizes} | {
        "p6_containers": p6_containers,
        "p6_fill": p6_fill,
        "p7_found": p7_found,
        "p7_items_leaked": p7_items_leaked,
        "p7_kept_documents": p7_kept_documents,
        "p8_found": p8_found,
        "p8_scores": p8_scores,
        "p8_rate_per_source": p8_rate_per_source,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": _P5 + "SELECT id AS entity_id, coalesce(gid, id) AS group_id FROM g",
        "p5_group_sizes": _P5 + "SELECT coalesce(gid, id) AS group_id, count(*) AS n_members FROM g GROUP BY 1",
    }
