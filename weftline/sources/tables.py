"""Readers of the parquet tables under a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table; ``sf_dir`` is the folder that holds ``<name>.parquet``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
