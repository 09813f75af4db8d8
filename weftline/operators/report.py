"""Dashboards and reports as key-value rows and sectioned lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tally(df: DataFrame, case: str, measures: dict[str, Column]) -> DataFrame:
    """(case_id, measure, value) long form of aggregates per case, in one pass over ``df``."""
    g = df.where(F.col(case).isNotNull()).groupBy(F.col(case).alias("case_id")).agg(*[m.cast("bigint").alias(k) for k, m in measures.items()])
    return g.unpivot("case_id", list(measures), "measure", "value")


def dashboard(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def sections(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """Lines of a sectioned report: each part has (case_id, ord, line)."""
    named = [p.select("case_id", F.lit(i).alias("section_no"), F.lit(n).alias("section"), F.col("ord").cast("bigint").alias("ord"), "line") for i, (n, p) in enumerate(parts, 1)]
    return reduce(DataFrame.unionByName, named)


def csv_line(*cells: Column) -> Column:
    """Quoted cells joined by commas, quotes doubled, null as empty."""
    return F.concat_ws(",", *[F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in cells])


def write_csv_report(lines: DataFrame, path: str) -> None:
    """One CSV file a case, lines in order, with a header line of section names."""
    lines.repartition("case_id").sortWithinPartitions("case_id", "section_no", "ord").select("case_id", F.concat_ws(",", "section", "line").alias("value")).write.mode("overwrite").partitionBy("case_id").text(path)
