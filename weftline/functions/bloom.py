"""A Bloom filter that is built and probed with JVM-side column expressions.

Building is one distributed aggregation (``bit_or`` of 64-bit words with map-side combine);
the filter has at most ``max_bits`` bits whatever the number of keys, so that the single row
holding it may always be broadcast. Probing is ``get(words, i) & mask`` inside codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BITS = 1 << 26  # 8 MiB of words: the proven bound of what is broadcast
MIN_BITS = 1 << 13


def bits_for(n_keys: int, bits_per_key: int = 12, max_bits: int = MAX_BITS) -> int:
    """Power of two that gives ``bits_per_key`` bits a key, never more than ``max_bits``."""
    want = max(MIN_BITS, n_keys * bits_per_key)
    return min(max_bits, 1 << (want - 1).bit_length())


def _positions(key: Column, n_bits: int, k: int) -> list[Column]:
    # 48 and 40 bits of the two hashes, so that no sum overflows
    h1 = F.xxhash64(key).bitwiseAND(F.lit((1 << 48) - 1))
    h2 = F.xxhash64(key, F.lit(0x5BD1E995)).bitwiseAND(F.lit((1 << 40) - 1)).bitwiseOR(F.lit(1))
    return [(h1 + h2 * F.lit(i)).bitwiseAND(F.lit(n_bits - 1)) for i in range(k)]


def build(keys: DataFrame, key: str, n_bits: int, k: int = 5) -> DataFrame:
    """One row, one column ``words``: array<bigint> of n_bits / 64 words. Null keys are ignored."""
    n_words = n_bits // 64
    pos = keys.where(F.col(key).isNotNull()).select(F.explode(F.array(*_positions(F.col(key), n_bits, k))).alias("p"))
    words = pos.groupBy(F.shiftright("p", 6).cast("int").alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("m")
    )
    packed = words.agg(F.map_from_entries(F.collect_list(F.struct("w", "m"))).alias("by_word"))
    dense = f"transform(sequence(0, {n_words - 1}), i -> coalesce(try_element_at(by_word, i), 0L))"
    if n_words > 4096:  # a map lookup is linear: fill the gaps by a join instead
        spine = keys.sparkSession.range(n_words).select(F.col("id").cast("int").alias("w"))
        packed = (
            spine.join(words, "w", "left")
            .agg(F.sort_array(F.collect_list(F.struct("w", F.coalesce("m", F.lit(0).cast("bigint")).alias("m")))).alias("by_word"))
        )
        dense = "transform(by_word, x -> x.m)"
    return packed.select(F.expr(dense).alias("words"))


def might_contain(words: Column, key: Column, n_bits: int, k: int = 5) -> Column:
    """False only for keys that are certainly absent; null for a null key."""
    out = F.lit(True)
    for p in _positions(key, n_bits, k):
        word = F.get(words, F.shiftright(p, 6).cast("int"))
        bit = F.call_function("shiftright", word, p.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1))
        out = out & (bit == 1)
    return F.when(key.isNotNull(), out)
