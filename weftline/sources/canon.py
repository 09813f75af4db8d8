"""Projection of the star-schema test tables onto the canonical model, and the same as SQL.

case = region number of a place; place = nation; entity = customer (PERSON) or supplier
(ORGANIZATION); relationship = customer-supplier pairs of all order lines; event = row of
``events``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.spans import micros
from weftline.sources.tables import table


def places(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf, "nation").select(
        k.cast("bigint").alias("loc"),
        F.col("n_regionkey").cast("bigint").alias("case_id"),
        F.col("n_name").alias("name"),
        (F.lit(8.0) + F.lit(1.1) * k).alias("lat"),
        (F.lit(68.0) + F.lit(1.2) * ((k * 7) % 25)).alias("lon"),
    )


def events(spark: SparkSession, sf: str) -> DataFrame:
    start = micros("ts")
    loc = F.regexp_extract("props", r'"k":\s*(\d+)', 1).cast("bigint") % 25
    eid = F.col("event_id")
    return table(spark, sf, "events").select(
        eid.alias("id"),
        F.col("user_id").alias("pid"),
        F.col("event_type").alias("kind"),
        start.alias("s"),
        (start + F.floor(F.abs("value") * 60).cast("bigint") * 1_000_000).alias("e"),
        loc.alias("loc"),
        (loc % 5).alias("case_id"),
        (F.lit(20) + F.regexp_extract("props", r'"k":\s*(\d+)', 1).cast("bigint") % 10).alias("pid2"),
        ((eid % 50).cast("double") / 50).alias("conf"),
        F.when(eid % 10 == 0, "REJECTED").when(eid % 3 == 0, "APPROVED").otherwise("PENDING").alias("status"),
        F.when(eid % 4 == 0, "EXACT").when(eid % 4 == 1, "MINUTE").otherwise("HOUR").alias("precision"),
    )


def live(ev: DataFrame) -> DataFrame:
    return ev.where("status <> 'REJECTED' and s is not null")


def entities(spark: SparkSession, sf: str) -> DataFrame:
    nation = F.broadcast(table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"))  # 25 rows, fixed

    def side(t: str, p: str, letter: str, kind: str) -> DataFrame:
        key, bal = F.col(f"{p}_{t[:4]}key"), F.col(f"{p}_acctbal")
        return table(spark, sf, t).join(nation, F.col(f"{p}_nationkey") == F.col("n_nationkey")).select(
            F.concat(F.lit(letter), key.cast("string")).alias("id"),
            F.lit(kind).alias("type"),
            F.col(f"{p}_name").alias("name"),
            F.when(key % 10 == 0, "UNVERIFIED").otherwise("VERIFIED").alias("status"),
            F.when(bal < 0, "CRITICAL").when(bal < 3000, "HIGH").when(bal < 7000, "MEDIUM").otherwise("LOW").alias("risk"),
            F.col("n_name").alias("district"),
            F.col("n_regionkey").cast("bigint").alias("case_id"),
        )

    return side("customer", "c", "C", "PERSON").unionByName(side("supplier", "s", "S", "ORGANIZATION"))


def relationships(spark: SparkSession, sf: str, rare: bool = False) -> DataFrame:
    """Distinct customer-supplier pairs of all lines; ``rare``: of a few lines, as the older set where two sets are merged."""
    lines = table(spark, sf, "lineitem")
    if rare:
        lines = lines.where("l_returnflag = 'R' and l_quantity >= 50 and l_discount >= 0.05")
    return (
        lines.join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("dst"))
        .distinct()
    )


def _entity_sql(t: str, p: str, letter: str, kind: str) -> str:
    key, bal = f"{p}_{t[:4]}key", f"{p}_acctbal"
    return f"""SELECT '{letter}' || {key} AS id, '{kind}' AS type, {p}_name AS name,
    CASE WHEN {key} % 10 = 0 THEN 'UNVERIFIED' ELSE 'VERIFIED' END AS status,
    CASE WHEN {bal} < 0 THEN 'CRITICAL' WHEN {bal} < 3000 THEN 'HIGH' WHEN {bal} < 7000 THEN 'MEDIUM' ELSE 'LOW' END AS risk,
    n_name AS district, n_regionkey::BIGINT AS case_id FROM {t} JOIN nation ON {p}_nationkey = n_nationkey"""


def _rel_sql(cond: str = "true") -> str:
    return f"SELECT DISTINCT 'C' || o_custkey AS src, 'S' || l_suppkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE {cond}"


#: CTEs for the SQL side, by name.
SQL = {
    "place": """place AS (SELECT n_nationkey::BIGINT AS loc, n_regionkey::BIGINT AS case_id, n_name AS name,
    8.0::DOUBLE + 1.1::DOUBLE * n_nationkey AS lat, 68.0::DOUBLE + 1.2::DOUBLE * ((n_nationkey * 7) % 25) AS lon FROM nation)""",
    "ev": r"""ev AS (SELECT event_id AS id, user_id AS pid, event_type AS kind, epoch_us(ts) AS s,
    epoch_us(ts) + floor(abs(value) * 60)::BIGINT * 1000000 AS e, k % 25 AS loc, k % 25 % 5 AS case_id, 20 + k % 10 AS pid2,
    (event_id % 50)::DOUBLE / 50 AS conf,
    CASE WHEN event_id % 10 = 0 THEN 'REJECTED' WHEN event_id % 3 = 0 THEN 'APPROVED' ELSE 'PENDING' END AS status,
    CASE WHEN event_id % 4 = 0 THEN 'EXACT' WHEN event_id % 4 = 1 THEN 'MINUTE' ELSE 'HOUR' END AS precision
  FROM (SELECT *, regexp_extract(props, '"k":\s*(\d+)', 1)::BIGINT AS k FROM events))""",
    "live": "live AS (SELECT * FROM ev WHERE status <> 'REJECTED' AND s IS NOT NULL)",
    "ent": f"ent AS ({_entity_sql('customer', 'c', 'C', 'PERSON')} UNION ALL {_entity_sql('supplier', 's', 'S', 'ORGANIZATION')})",
    "rel": f"rel AS ({_rel_sql()})",
    "rare": f"rare AS ({_rel_sql("l_returnflag = 'R' AND l_quantity >= 50 AND l_discount >= 0.05")})",
}


def with_(*names: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(SQL[n] if n in SQL else n for n in names) + "\n"
