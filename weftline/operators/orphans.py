"""References to records that do not exist, are deleted or arrive later.

A Bloom filter of all parent keys, small enough to broadcast by construction, proves that most
missing keys are missing; only references that pass it are joined with the parents.

Defined results: null or blank references are never cases. Keys compare without letter case and
surrounding blanks. A repeated record counts once, with its earliest arrival and creation (once
for each reference, should its rows disagree); a repeated parent counts with its earliest arrival
and earliest deletion. A record or parent without arrival time can only be a case by a missing key.
Empty tables give no rows (empty parents: every reference is a case). Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import bloom
from weftline.plans.lineage import Scratch


def reference_key(c: Column) -> Column:
    """Trimmed lower-case text, null if blank."""
    k = F.lower(F.regexp_replace(c.cast("string"), r"^\s+|\s+$", ""))
    return F.when(k != "", k)


@dataclass(frozen=True)
class Reference:
    """Records of ``children`` (named ``ref_table``) refer by ``reference`` to ``parent_key`` of ``parents``."""

    ref_table: str
    children: DataFrame
    record_id: str
    reference: str
    parents: DataFrame
    parent_key: str


def find_orphans(references: list[Reference], *, max_filter_bits: int = bloom.MAX_BITS) -> DataFrame:
    """(ref_table, record_id, ref_month, reason) of the child records whose reference is an orphan.

    All references share one filter and one join, their keys told apart by the table's name.
    ``reason`` is ``missing``, ``deleted`` or ``late``. Hot reference keys are harmless: the
    parents have one row a key and Spark splits skewed partitions of the outer join's left side.
    """
    none = F.lit(None).cast("timestamp_ntz")

    def tagged(r: Reference, key: str) -> Column:
        return F.concat(F.lit(r.ref_table + "|"), reference_key(F.col(key)))

    def parents_of(r: Reference) -> DataFrame:
        deleted = F.col("deleted_at") if "deleted_at" in r.parents.columns else none
        return r.parents.select(tagged(r, r.parent_key).alias("k"), F.col("ingested_at").alias("p_seen"), deleted.alias("p_deleted"))

    def children_of(r: Reference) -> DataFrame:
        return r.children.select(
            F.lit(r.ref_table).alias("ref_table"), F.col(r.record_id).cast("string").alias("record_id"), tagged(r, r.reference).alias("k"), "ingested_at", "created_at"
        )

    parents = reduce(DataFrame.unionByName, map(parents_of, references)).where("k is not null")
    keys = parents.groupBy("k").agg(F.min("p_seen").alias("p_seen"), F.min("p_deleted").alias("p_deleted"))
    n_bits = bloom.bits_for(parents.count(), max_bits=max_filter_bits)
    # written once: the filter is read by several expressions, and its own plan stays out of theirs
    words = Scratch(parents.sparkSession, "bloom").cut(bloom.build(parents.select("k"), "k", n_bits))

    records = (
        reduce(DataFrame.unionByName, map(children_of, references))
        .where("record_id is not null and k is not null")
        .withColumn("maybe", bloom.might_contain(words.scalar(), F.col("k"), n_bits))
    )
    # an aggregate, so that both halves below read one shuffle instead of scanning each for itself
    probed = records.groupBy("ref_table", "record_id", "k").agg(
        F.min("ingested_at").alias("seen"), F.min("created_at").alias("created"), F.bool_or("maybe").alias("maybe")
    )
    reason = (
        F.when(F.col("p_key").isNull(), "missing")
        .when(F.col("p_deleted") <= F.col("seen"), "deleted")
        .when(F.col("p_seen") > F.col("seen"), "late")
    )
    verified = (
        probed.where("maybe")
        .join(keys.withColumn("p_key", F.col("k")), "k", "left")
        .withColumn("reason", reason)
        .where("reason is not null")
        .select("ref_table", "record_id", "created", "reason")
    )
    definite = probed.where("not maybe").select("ref_table", "record_id", "created", F.lit("missing").alias("reason"))
    return verified.unionByName(definite).select(
        "ref_table", "record_id", F.coalesce(F.date_format("created", "yyyy-MM"), F.lit("unknown")).alias("ref_month"), "reason"
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table, month and reason."""
    return orphans.groupBy("ref_table", "ref_month", "reason").agg(F.count("*").alias("n_orphans"))
