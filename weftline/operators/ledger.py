"""Hash chains over documents: building, verifying, versions and integrity status."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GENESIS = "0" * 64


def stamp(c: str) -> Column:
    """UTC time with seven digits of fraction, the last always 0; empty for null."""
    return F.coalesce(F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0Z")), F.lit(""))


def records(docs: DataFrame, chain: str) -> DataFrame:
    """(chain, block_index, body, content_hash): documents of each chain in order of id."""
    idx = F.row_number().over(W.partitionBy(chain).orderBy("doc_id")) - 1
    h = F.sha2(F.coalesce("text", F.lit("")), 256)
    return docs.select(F.col(chain).alias("chain"), "doc_id", idx.alias("block_index"), h.alias("content_hash"), F.concat_ws("|", F.col("doc_id").cast("string"), h, F.lit("REGISTER"), stamp("created_at")).alias("body"))


def build(recs: DataFrame) -> DataFrame:
    """Adds prev_hash and block_hash. A block's hash needs the one before, so each chain is read once
    in order, streamed through its task in batches with one hash carried: any chain length fits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain, last = None, GENESIS
        for b in batches:
            prev, now = [], []
            for c, i, body in zip(b["chain"], b["block_index"], b["body"]):
                if c != chain:
                    chain, last = c, GENESIS
                prev.append(last)
                last = hashlib.sha256(f"{i}|{last}|{body}".encode()).hexdigest()
                now.append(last)
            yield b.assign(prev_hash=prev, block_hash=now)

    schema = "chain string, doc_id bigint, block_index int, content_hash string, body string, prev_hash string, block_hash string"
    return recs.repartition("chain").sortWithinPartitions("chain", "block_index").mapInPandas(run, schema)


def verify(blocks: DataFrame) -> DataFrame:
    """(chain, n_blocks, first_bad, reason): each block against its predecessor only, in parallel."""
    w = W.partitionBy("chain").orderBy("block_index")
    prev_hash, prev_idx = F.lag("block_hash").over(w), F.lag("block_index").over(w)
    redo = F.sha2(F.concat_ws("|", F.col("block_index").cast("string"), "prev_hash", "body"), 256)
    reason = (
        F.when(F.length("block_hash") != 64, "BAD_HASH")
        .when(prev_idx.isNull() & (F.col("block_index") != 0), "BAD_GENESIS")
        .when(prev_idx.isNull() & (F.col("prev_hash") != GENESIS), "BAD_GENESIS")
        .when(prev_idx.isNotNull() & (F.col("block_index") != prev_idx + 1), "BAD_INDEX")
        .when(prev_hash.isNotNull() & (F.col("prev_hash") != prev_hash), "BROKEN_LINK")
        .when(redo != F.col("block_hash"), "HASH_MISMATCH")
    )
    c = blocks.withColumn("reason", reason)
    bad = F.when(F.col("reason").isNotNull(), F.struct("block_index", "reason"))
    return c.groupBy("chain").agg(F.count("*").alias("n_blocks"), F.min(bad).alias("b")).select("chain", "n_blocks", F.col("b.block_index").alias("first_bad"), F.coalesce("b.reason", F.lit("VALID")).alias("reason"))


def versions(docs: DataFrame, name: str) -> DataFrame:
    """(doc_id, version, parent_id): documents of one name numbered by time."""
    w = W.partitionBy(name).orderBy(F.asc_nulls_first("created_at"), "doc_id")
    return docs.select("doc_id", name, F.row_number().over(w).alias("version"), F.lag("doc_id").over(w).alias("parent_id"))


def integrity(docs: DataFrame, blocks: DataFrame, broken: DataFrame) -> DataFrame:
    """(doc_id, status) by precedence: MISSING_FILE, MISSING_LEDGER_RECORD, EVIDENCE_MODIFIED, CHAIN_INVALID, VERIFIED."""
    b = blocks.groupBy("doc_id").agg(F.max_by("content_hash", "block_index").alias("stored"), F.max("chain").alias("chain"))
    j = docs.select("doc_id", "text").join(b, "doc_id", "left").join(broken.select("chain", F.lit(True).alias("bad")).distinct(), "chain", "left")
    status = (
        F.when(F.col("text").isNull(), "MISSING_FILE")
        .when(F.col("stored").isNull(), "MISSING_LEDGER_RECORD")
        .when(F.sha2("text", 256) != F.col("stored"), "EVIDENCE_MODIFIED")
        .when(F.col("bad"), "CHAIN_INVALID")
        .otherwise("VERIFIED")
    )
    return j.select("doc_id", status.alias("status"))
