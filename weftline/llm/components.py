"""Connected groups of pairwise matches, by alternating large-star and small-star rewrites.

Every edge list is one distributed table. A large-star joins each node's strictly larger
neighbours to the smallest of its neighbourhood; a small-star does the same for the smaller ones.
Both keep connectivity and shrink towards stars whose centre is the component's least id; the
loop ends when a round leaves the edge set unchanged (equal count and equal order-free sum of hashes).
Each rewrite is one grouped minimum (combined before the shuffle) and one join on the node;
no neighbourhood is ever collected, so a node with a third of all edges is split by Spark's
skew handling like any other hot join key.

Defined results: ids compare as text, the empty string is an id like any other; null ids are not
members. Self pairs and refused pairs create members without linking them. Repeated pairs, in
either order, count once. No rows, no groups. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.plans.lineage import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges``: distinct (a, b), a > b. One rewrite, distinct (a, b), a > b again."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")) if large else edges.groupBy("a").agg(F.min("b").alias("m"))
    if large:  # strictly larger neighbours of a, to the least of a and its neighbours
        out = (
            edges.select(F.col("b").alias("a"), F.col("a").alias("v"))
            .join(least, "a")
            .select(F.col("v").alias("a"), F.col("m").alias("b"))
        )
    else:  # smaller neighbours of a, and a itself, to the least of them
        out = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return out.distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
    return r.n, r.h


def connect(pairs: DataFrame, a: str = "a", b: str = "b", *, max_rounds: int = 100) -> DataFrame:
    """(id, group_id) for all ids linked by ``pairs``; group_id is the least id of the component."""
    spark = pairs.sparkSession
    scratch = Scratch(spark, "components")
    x, y = F.col(a), F.col(b)
    edges = scratch.cut(
        pairs.where(x.isNotNull() & y.isNotNull() & (x != y))
        .select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
        .distinct()
    )
    before = _fingerprint(edges)
    for _ in range(max_rounds):
        larger = _star(edges, large=True)
        smaller = scratch.cut(_star(larger, large=False))
        scratch.drop(edges)
        edges, now = smaller, _fingerprint(smaller)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("group_id")).unionByName(
        edges.select(F.col("b").alias("id"), F.col("b").alias("group_id")).distinct()
    )


def group_matches(candidates: DataFrame, *, a: str, b: str, accepted) -> DataFrame:
    """(id, group_id) for every id in ``a`` or ``b``; only rows where ``accepted`` holds link.

    An id without a link is its own group.
    """
    members = candidates.select(F.explode(F.array(a, b)).alias("id")).where("id is not null").distinct()
    linked = connect(candidates.where(accepted).select(F.col(a).alias("a"), F.col(b).alias("b")))
    return members.join(linked, "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id"))
