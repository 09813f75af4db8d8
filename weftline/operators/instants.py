"""Moments written in many notations, precisions and zones, as one UTC instant.

Texts are read by shape masks (``functions.timeshapes``) and converted through zone transition
tables (``functions.zones``) that are built once on the driver for the zones that occur (never
more than the database has) and sent to the executors. No shuffle: the operator is one scan.

Defined results: null or blank texts, texts without a moment, impossible dates and times, parts
of a day ("evening of"), relative days or clock times without a reference date, local times that
the zone skipped or had twice, and unknown zone names give no row. An offset or zone in the text
wins over the zone column, which wins over UTC. Fractions beyond microseconds are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from zoneinfo import available_timezones

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.timeshapes import to_utc
from weftline.functions.zones import ZoneTable


def zone_table(df: DataFrame, zone: str) -> ZoneTable:
    """Transition tables of the zones named in a column; unknown names are left out."""
    known = sorted(available_timezones())
    named = df.select(F.trim(F.col(zone)).alias("z")).where(F.col("z").isin(known)).distinct()
    return ZoneTable.build([r.z for r in named.collect()])  # at most len(known) rows


def normalise(df: DataFrame, *, key: str, text: str, zone: str | None = None, reference: str | None = None) -> DataFrame:
    """(key, utc_us) for each row of ``df`` whose text means exactly one instant."""
    spark = df.sparkSession
    null = F.lit(None).cast("string")
    rows = df.select(
        F.col(key).alias("key"),
        F.col(text).cast("string").alias("text"),
        (F.col(zone).cast("string") if zone else null).alias("zone"),
        (F.col(reference).cast("string") if reference else null).alias("ref"),
    ).where("key is not null and trim(text) <> ''")
    table = spark.sparkContext.broadcast(zone_table(rows, "zone") if zone else ZoneTable.build([]))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            us = to_utc(b["text"], b["zone"], b["ref"], table.value)
            yield pd.DataFrame({"key": b["key"], "utc_us": us})[us.notna().to_numpy()]

    kind = df.schema[key].dataType.simpleString()
    return rows.mapInPandas(read, f"key {kind}, utc_us bigint").withColumnRenamed("key", key)
