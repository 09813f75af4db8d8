"""Relational building blocks: optional filters, search, paging, lookups, upserts, anti-joins, counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.plans.lineage import Scratch


def where_given(df: DataFrame, *, equal: dict | None = None, at_least: dict | None = None, at_most: dict | None = None) -> DataFrame:
    """Conjunction of the predicates whose argument is given; blank and ``ALL`` mean not given.

    Texts compare without letter case. A null column value fails every range predicate.
    """
    preds: list[Column] = []
    for c, v in (equal or {}).items():
        if v is not None and str(v).strip() not in ("", "ALL"):
            preds.append(F.upper(c) == str(v).upper() if isinstance(v, str) else F.col(c) == v)
    preds += [F.col(c) >= v for c, v in (at_least or {}).items() if v is not None]
    preds += [F.col(c) <= v for c, v in (at_most or {}).items() if v is not None]
    return df.where(reduce(Column.__and__, preds)) if preds else df


def search(df: DataFrame, needle: str, columns: list[str]) -> DataFrame:
    """Rows with ``needle`` inside any of the columns, without letter case; a blank needle keeps all."""
    if not needle or not needle.strip():
        return df
    q = F.lit(needle.strip().lower())
    return df.where(reduce(Column.__or__, [F.coalesce(F.contains(F.lower(c), q), F.lit(False)) for c in columns]))


def page(df: DataFrame, order: list[Column], number: int, size: int, most: int | None = None) -> DataFrame:
    """The page of the given number (from 1); number and size below 1 count as 1, size above ``most`` as ``most``."""
    size = max(1, size if most is None else min(size, most))
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def newest(df: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """The latest row of each key."""
    row = F.struct(*[F.col(c) for c in df.columns])
    best = df.groupBy(*keys).agg(F.max_by(row, F.struct(time, tie)).alias("r"))
    return best.select("r.*")


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def histogram(df: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    """Rows per upper-cased value."""
    return df.groupBy(*(keys or []), F.upper(column).alias(column)).agg(F.count("*").alias("n"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and ``new`` merged by key: a column takes the new value where there is one, else keeps the old.

    Columns that only one side has are kept. Of several new rows of a key the greatest value of each column
    counts, nulls aside. Rows with a null in a key match nothing and are kept as they are.
    """
    rest = [c for c in dict.fromkeys([*old.columns, *new.columns]) if c not in keys]
    one = new.groupBy(*keys).agg(*[F.max(c).alias(f"_new_{c}") for c in rest if c in new.columns])
    both = old.withColumnsRenamed({c: f"_old_{c}" for c in rest}).join(one, keys, "full")
    value = {c: F.coalesce(*[F.col(f"_{p}_{c}") for p, d in (("new", new), ("old", old)) if c in d.columns]) for c in rest}
    return both.select(*keys, *[v.alias(c) for c, v in value.items()])


def upsert_edges(old: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of (src, type, dst) merged; new edges without both ends among ``nodes`` are left out."""
    ends = nodes.select("id")
    ok = new.join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return upsert(old, ok, ["src", "type", "dst"])


def pair_key(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs with the smaller end first."""
    return df.withColumn("_lo", F.least(a, b)).withColumn("_hi", F.greatest(a, b)).drop(a, b).withColumnsRenamed({"_lo": a, "_hi": b})


def without_known_pairs(pairs: DataFrame, known: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Pairs that are in ``known`` in neither direction."""
    return pair_key(pairs, a, b).join(pair_key(known.select(a, b), a, b).distinct(), [a, b], "left_anti")


def rank_in(df: DataFrame, keys: list[str], order: list[Column], k: int, keep_rank: str | None = None) -> DataFrame:
    """The first k rows of each key; ``keep_rank`` names a column for their place."""
    r = keep_rank or "_r"
    first = df.withColumn(r, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(r) <= k)
    return first if keep_rank else first.drop(r)


def classifier_metrics(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """(roc_auc, average_precision, precision, recall, f1); fewer than two classes give 0.5, 0.5, 0, 0, 0.

    Exact at any size: positives and negatives are first counted per distinct score (combined
    before the shuffle); ranks run over the distinct scores.
    """
    y = F.col(label).cast("bigint")
    per = df.groupBy(F.col(score).alias("sc")).agg(F.sum(y).alias("p"), F.sum(1 - y).alias("q"))
    # ranges of scores lie in one task each; what lies below and above a range comes from the ranges' sums
    ranged = Scratch(df.sparkSession, "metrics").cut(per.repartitionByRange("sc").withColumn("part", F.spark_partition_id()))
    every = W.partitionBy(F.lit(0)).orderBy("part")  # one row a range
    sums = ranged.groupBy("part").agg(F.sum("p").alias("ps"), F.sum("q").alias("qs"))
    sums = sums.select("part", (F.sum("qs").over(every) - F.col("qs")).alias("q0"), *[(F.sum(c).over(W.partitionBy(F.lit(0))) - F.sum(c).over(every)).alias(f"{c[0]}1") for c in ("ps", "qs")])
    up, down = W.partitionBy("part").orderBy("sc"), W.partitionBy("part").orderBy(F.desc("sc"))
    run = (
        ranged.join(F.broadcast(sums), "part")
        .withColumn("q_below", F.col("q0") + F.sum("q").over(up) - F.col("q"))
        .withColumn("tp", F.col("p1") + F.sum("p").over(down))
        .withColumn("n_at", F.col("p1") + F.col("q1") + F.sum(F.expr("p + q")).over(down))
    )
    t = run.agg(
        F.sum("p").alias("P"),
        F.sum("q").alias("N"),
        F.sum(F.expr("p * (q_below + 0.5D * q)")).alias("u"),
        F.sum(F.expr("p * cast(tp as double) / n_at")).alias("ap"),
        F.sum(F.when(F.col("sc") >= threshold, F.col("p")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("sc") >= threshold, F.expr("p + q")).otherwise(0)).alias("called"),
    )
    two = "P > 0 and N > 0"
    return t.select(
        F.expr(f"if({two}, u / (cast(P as double) * N), 0.5D)").alias("roc_auc"),
        F.expr(f"if({two}, ap / P, 0.5D)").alias("average_precision"),
        F.expr(f"if({two} and called > 0, cast(tp as double) / called, 0D)").alias("precision"),
        F.expr(f"if({two}, cast(tp as double) / P, 0D)").alias("recall"),
        F.expr(f"if({two} and tp > 0, 2D * tp / (called + P), 0D)").alias("f1"),
    )


def cosine01(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles, rescaled to [0, 1]; 0.5 where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, (dot(a, b) / norm + 1) / 2).otherwise(0.5)
