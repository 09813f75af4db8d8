"""Packing texts into containers of fixed capacity: pattern packing by non-negative least squares.

1. Texts are measured in tokens of a public tokenizer; a text above the capacity becomes full
   pieces and a rest, all others stay whole.
2. Only the histogram of lengths goes to the driver: at most ``capacity`` numbers whatever the
   corpus. Patterns of few distinct lengths that fill a container exactly are enumerated evenly over
   all lengths (pairs, triples, and repeats of a short length with one or two others), their repeat
   counts are fitted to the histogram by non-negative least squares and rounded by largest remainders.
   What is left is packed best-fit decreasing by counts of equal containers, not item by item. The plan
   has at most 20 x ``capacity`` groups of equal containers, whatever the corpus, and is broadcast.
3. Items are ranked within their length (in salted buckets, so that a length with a third of all
   items is no hot spot) and look their container up in the plan, which is broadcast.

Defined results: null texts are no items; empty texts take no room and are spread over the
containers; equal texts are items of their own; no items, no containers. Container numbers run
from 0 for each capacity.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.plans.lineage import Scratch

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Capacities planned and broadcast at once.
AT_ONCE = 64
#: Splitting pattern of byte-level BPE vocabularies (fixed value).
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(path: str):
    """The tokenizer of a ``.tiktoken`` file, once per worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def measure(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of all texts that are not null."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(tokenizer)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["d"], "n_tokens": [len(enc.encode_ordinary(t)) for t in b["t"]]})

    kind = documents.schema[doc_id].dataType.simpleString()
    rows = documents.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).where("d is not null and t is not null")
    return rows.mapInPandas(count, f"doc_id {kind}, n_tokens int")


# -- the plan, from a histogram -----------------------------------------------------------------


def patterns(lengths: np.ndarray, capacity: int, each: int = 8) -> list[tuple[tuple[int, int], ...]]:
    """Patterns ((length, copies), ...) of at most three distinct lengths that fill the capacity exactly.

    Every length, long or short, gets its pair, up to ``each`` triples whose second lengths are spread
    evenly over all that fit, and up to ``each`` repeats filled up by one or two others: at most
    (2 * each + 1) * capacity patterns, whatever the histogram.
    """
    have = np.zeros(capacity + 1, dtype=bool)
    have[lengths] = True
    out: set[tuple[tuple[int, int], ...]] = set()

    def add(*parts: int) -> None:
        n: dict[int, int] = {}
        for p in parts:
            n[int(p)] = n.get(int(p), 0) + 1
        out.add(tuple(sorted(n.items())))

    def spread(x: np.ndarray, k: int) -> np.ndarray:
        return x if len(x) <= k else x[np.linspace(0, len(x) - 1, k).astype(int)]

    for a in lengths:
        rest = capacity - a
        if have[rest]:
            add(a, rest)
        b = lengths[: np.searchsorted(lengths, rest // 2, side="right")]
        for x in spread(b[have[rest - b]], each):
            add(a, x, rest - x)
    for a in lengths[lengths <= capacity // 3]:
        whole = capacity // a
        for copies in sorted({whole, whole - 1, whole // 2, max(2, whole // 4)}):
            rest = int(capacity - copies * a)
            if copies < 2 or copies > whole:
                continue
            if rest == 0:
                out.add(((int(a), int(copies)),))
            elif have[rest]:
                add(*[a] * copies, rest)
            else:
                b = lengths[: np.searchsorted(lengths, rest // 2, side="right")]
                for x in spread(b[have[rest - b]], max(1, each // 4)):
                    add(*[a] * copies, x, rest - x)
    return sorted(out)


def fit(pats: list, histogram: np.ndarray, rounds: int = 4000, close: float = 1e-4) -> np.ndarray:
    """x >= 0 minimising the squared difference of the patterns' lengths and the histogram.

    Accelerated projected gradient with restarts; ends when all but a share ``close`` of the items is met.
    """
    if not pats:
        return np.zeros(0)
    row = np.array([ln for p in pats for ln, _ in p])
    val = np.array([c for p in pats for _, c in p], dtype=float)
    col = np.repeat(np.arange(len(pats)), [len(p) for p in pats])
    scale = np.sqrt(np.maximum(1.0, np.bincount(col, val * val)))  # unit columns
    val = val / scale[col]
    n, m = len(histogram), len(pats)
    v = np.random.default_rng(0).random(m)
    for _ in range(20):  # the largest eigenvalue
        v = np.bincount(col, val * np.bincount(row, val * v[col], n)[row], m)
        top = np.linalg.norm(v)
        v /= top
    x = z = np.zeros(m)
    t = 1.0
    enough = close * max(1.0, histogram.sum())
    for k in range(rounds):
        off = np.bincount(row, val * z[col], n) - histogram
        if k % 50 == 49 and np.abs(off).sum() <= enough:
            break
        grad = np.bincount(col, val * off[row], m)
        new = np.maximum(0, z - grad / top)
        if grad @ (new - x) > 0:
            t = 1.0
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x / scale


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Best-fit decreasing over a histogram, by counts rather than items: [(containers, {length: copies})].

    Containers with the same content are one group. A length enters the fullest group it fits, as many
    copies to a container as fit; only where it runs out is a group split, so there are at most three
    groups for each length that occurs, whatever the counts.
    """
    rooms: list[list[tuple[int, dict[int, int]]]] = [[] for _ in range(capacity + 1)]
    used = np.zeros(capacity + 1, dtype=bool)
    for ln in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[ln])
        while n:
            at = ln + int(np.argmax(used[ln:]))
            if used[at]:
                times, mix = rooms[at].pop()
                used[at] = bool(rooms[at])
            else:
                at, times, mix = capacity, n, {}
            copies = at // ln
            full = min(times, n // copies)
            parts = [(full, copies)]
            n -= full * copies
            if full < times and n:  # fewer than a container takes
                parts.append((1, n))
                full, n = full + 1, 0
            for k, c in parts:
                if k:
                    rooms[at - c * ln].append((k, {**mix, ln: c}))
                    used[at - c * ln] = True
            if full < times and mix:
                rooms[at].append((times - full, mix))
                used[at] = True
    return [group for groups in rooms for group in groups]


def plan(histogram: np.ndarray, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """[(containers, {length: copies})] that holds every item of ``histogram`` (index: length)."""
    left = histogram.astype(np.int64).copy()
    out: list[tuple[int, dict[int, int]]] = []
    if left[capacity]:
        out.append((int(left[capacity]), {capacity: 1}))
        left[capacity] = 0
    pats = patterns(np.flatnonzero(left), capacity)
    x = fit(pats, left.astype(float))

    def take(k: int, times: int) -> int:
        times = min([times] + [int(left[ln]) // c for ln, c in pats[k]])
        for ln, c in pats[k] if times > 0 else ():
            left[ln] -= times * c
        return max(0, times)

    # whole repeats, the largest first, as far as the items go; then one more by the largest remainders
    order = [k for k in np.argsort(-x, kind="stable") if x[k] > 1e-6]
    times = {k: take(k, int(x[k])) for k in order}
    for k in sorted(order, key=lambda k: -(x[k] % 1)):
        times[k] += take(k, 1)
    out += [(n, dict(pats[k])) for k, n in times.items() if n]
    return out + best_fit(left, capacity)


class Slots:
    """Where the item of a length and rank goes: ranges of ranks by length."""

    def __init__(self, groups: list[tuple[int, dict[int, int]]]):
        rows: dict[int, list[tuple[int, int, int]]] = {}
        used: dict[int, int] = {}
        first = 0
        for times, parts in groups:
            for ln, c in parts.items():
                lo = used.get(ln, 0)
                rows.setdefault(ln, []).append((lo, first, c))
                used[ln] = lo + times * c
            first += times
        self.containers = first
        self.rows = {ln: tuple(np.array(x, dtype=np.int64) for x in zip(*r)) for ln, r in rows.items()}

    def of(self, length: int, rank: np.ndarray) -> np.ndarray:
        lo, first, copies = self.rows[length]
        k = np.searchsorted(lo, rank, side="right") - 1
        return first[k] + (rank - lo[k]) // copies[k]


def pack(documents: DataFrame, sizes: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, buckets: int = 64) -> DataFrame:
    """(size_id, capacity_tokens, container_id, doc_id, part, start_token, n_tokens): one row per item.

    ``sizes`` has (size_id, capacity_tokens), a table of settings; it is taken in parts of 64 capacities, so
    that no broadcast holds more plans than that.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "packing")
    measured = scratch.cut(measure(documents, doc_id=doc_id, text=text, tokenizer=tokenizer))
    caps = sizes.where("size_id is not null and capacity_tokens > 0").select("size_id", "capacity_tokens").distinct().orderBy("size_id").toLocalIterator()
    parts = [_pack_measured(spark, scratch, measured, part, buckets) for part in iter(lambda: list(islice(caps, AT_ONCE)), [])]
    return reduce(DataFrame.unionByName, parts or [_pack_measured(spark, scratch, measured, [], buckets)])


def _pack_measured(spark, scratch: Scratch, measured: DataFrame, caps: list, buckets: int) -> DataFrame:
    cap = F.array(*[F.struct(F.lit(r.size_id).alias("size_id"), F.lit(r.capacity_tokens).alias("capacity_tokens")) for r in caps])
    if not caps:
        cap = F.expr("cast(array() as array<struct<size_id:int,capacity_tokens:int>>)")
    pieces = measured.select("doc_id", "n_tokens", F.explode(cap).alias("c")).select("c.*", "doc_id", "n_tokens")
    pieces = pieces.select(
        "size_id",
        "capacity_tokens",
        "doc_id",
        F.explode(F.expr("sequence(0, greatest(0, cast(ceil(n_tokens / capacity_tokens) as int) - 1))")).alias("part"),
        "n_tokens",
    ).select(
        "size_id",
        "capacity_tokens",
        "doc_id",
        "part",
        (F.col("part") * F.col("capacity_tokens")).alias("start_token"),
        F.least("capacity_tokens", F.col("n_tokens") - F.col("part") * F.col("capacity_tokens")).alias("n_tokens"),
        F.pmod(F.xxhash64("doc_id", "part"), F.lit(buckets)).cast("int").alias("bucket"),
    )
    # at most capacity x buckets rows for each size
    salted = scratch.cut(pieces.groupBy("size_id", "capacity_tokens", "n_tokens", "bucket").agg(F.count("*").alias("n")))
    slots = {}
    hist = salted.groupBy("size_id", "capacity_tokens", "n_tokens").agg(F.sum("n").alias("n")).where("n_tokens > 0").toPandas()
    for (size, capacity), part in hist.groupby(["size_id", "capacity_tokens"]):
        h = np.zeros(int(capacity) + 1, dtype=np.int64)
        h[part["n_tokens"].to_numpy()] = part["n"].to_numpy()
        slots[int(size)] = Slots(plan(h, int(capacity)))
    shared = spark.sparkContext.broadcast(slots)
    before = W.partitionBy("size_id", "n_tokens").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = salted.select("size_id", "n_tokens", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(W.partitionBy("size_id", "n_tokens", "bucket").orderBy("doc_id", "part"))
    ranked = (
        pieces.withColumn("r", rank)
        .join(offsets.hint("merge"), ["size_id", "n_tokens", "bucket"])  # both sides already lie by these keys
        .withColumn("rank", F.col("r") - 1 + F.col("offset"))
        .select("size_id", "capacity_tokens", "doc_id", "part", "start_token", "n_tokens", "rank")
    )

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            where = np.zeros(len(b), dtype=np.int64)
            rank = b["rank"].to_numpy()
            for (size, length), rows in b.groupby(["size_id", "n_tokens"]).indices.items():
                s = shared.value.get(int(size))
                if s is None:
                    continue
                where[rows] = s.of(int(length), rank[rows]) if length else rank[rows] % max(1, s.containers)
            yield b.drop(columns="rank").assign(container_id=where)

    kinds = {f.name: f.dataType.simpleString() for f in ranked.schema.fields if f.name != "rank"}
    schema = ", ".join(f"{n} {t}" for n, t in kinds.items()) + ", container_id bigint"
    return ranked.mapInPandas(place, schema)


def containers(items: DataFrame) -> DataFrame:
    """One row per container: its items in order of id, tokens used and the filled share."""
    item = F.struct("doc_id", "part", "start_token", "n_tokens")
    return (
        items.groupBy("size_id", "capacity_tokens", "container_id")
        .agg(F.array_sort(F.collect_list(item)).alias("items"), F.count("*").alias("n_items"), F.sum("n_tokens").alias("used_tokens"))
        .withColumn("fill", F.col("used_tokens") / F.col("capacity_tokens"))
    )


def fill_report(items: DataFrame) -> DataFrame:
    """Containers, tokens and unused share for each capacity, beside the least possible number of containers."""
    per = items.groupBy("size_id", "capacity_tokens").agg(
        F.count_distinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_items")
    )
    room = F.col("n_containers") * F.col("capacity_tokens")
    return per.withColumn("unused_share", 1 - F.col("n_tokens") / room).withColumn("least_containers", F.ceil(F.col("n_tokens") / F.col("capacity_tokens")))
