"""Graph analytics over vertices (id, type, ...) and edges (src, dst) as DataFrames.

Undirected measures use the simple graph: distinct neighbours, no loops. Iterative measures cut
their lineage by written tables each round and test convergence with one aggregate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators import bins as B
from weftline.plans.lineage import Scratch

#: Pairs of types, in either order, between which a missing link may be suggested (fixed values).
COMPATIBLE_TYPES = (
    ("PERSON", "PERSON"),
    ("PERSON", "PHONE"),
    ("PERSON", "VEHICLE"),
    ("PERSON", "LOCATION"),
    ("PERSON", "ORGANIZATION"),
    ("PERSON", "ACCOUNT"),
    ("ORGANIZATION", "ORGANIZATION"),
    ("ORGANIZATION", "ACCOUNT"),
    ("ORGANIZATION", "LOCATION"),
    ("PHONE", "PHONE"),
)
#: Adjacency rows (both directions) up to which a component is handled whole in a task: 400 MB of its memory, less than 100 MB packed.
MAX_ADJACENCY = 100_000_000
#: Cells (nodes times sources, or words of 64 sources) of each array that the measures over all sources keep at a time.
CELLS = 4_000_000
#: Nodes times rows of a bin beyond which, of two sides, the one with more nodes is not searched from (some hundred CPU seconds).
LARGE_WORK = 2 * 10**12
#: Nodes of such a bin up to which those of the other side are searched from one by one.
MAX_REST = 100_000
#: Nodes up to which their feature rows (some 200 bytes each) are broadcast.
MAX_FEATURE_ROWS = 200_000
#: Entity types of the one-hot part of the node features, in order (fixed values).
NODE_TYPES = ("PERSON", "PHONE", "VEHICLE", "LOCATION", "ORGANIZATION", "ACCOUNT", "DEVICE", "EVENT", "DOCUMENT")
#: Neighbour types whose shares are features, in order (fixed values).
SHARED_TYPES = ("PHONE", "VEHICLE", "LOCATION", "ACCOUNT")


def adjacency(edges: DataFrame) -> DataFrame:
    """Distinct (a, b) in both directions, without loops."""
    e = edges.where("src is not null and dst is not null and src <> dst")
    return e.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(e.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()


def subgraph(vertices: DataFrame, edges: DataFrame, limit: int | None = None, verified_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """Verified vertices (the first ``limit`` by id, if given) and the edges with both ends among them."""
    v = vertices.where("status = 'VERIFIED'") if verified_only else vertices
    v = v.orderBy("id").limit(limit) if limit else v
    ends = v.select("id")
    e = edges.join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return v, e


def degree(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree, normalised, in_degree, out_degree): distinct neighbours; edge rows by direction."""
    n = vertices.agg(F.greatest(F.count("*") - 1, F.lit(1)).alias("others"))
    near = adjacency(edges).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("degree"))
    out_ = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
    in_ = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
    zero = F.lit(0).cast("bigint")
    d = vertices.select("id").join(near, "id", "left").join(in_, "id", "left").join(out_, "id", "left").na.fill(0, ["degree", "in_degree", "out_degree"])
    return d.crossJoin(F.broadcast(n)).select("id", "degree", F.round(F.col("degree") / F.col("others"), 4).alias("normalised"), F.coalesce("in_degree", zero).alias("in_degree"), F.coalesce("out_degree", zero).alias("out_degree"))  # one row


def neighbourhood(edges: DataFrame, start: DataFrame, depth: int = 1) -> DataFrame:
    """(root, id, hops) of all nodes within ``depth`` (1 to 3) hops of the ids in ``start``."""
    adj = adjacency(edges)
    seen = front = start.select(F.col("id").alias("root"), "id", F.lit(0).alias("hops"))
    for k in range(1, max(1, min(3, depth)) + 1):
        step = front.join(adj, F.col("id") == F.col("a")).select("root", F.col("b").alias("id")).distinct()
        front = step.join(seen.select("root", "id"), ["root", "id"], "left_anti").withColumn("hops", F.lit(k))
        seen = seen.unionByName(front)
    return seen


def components(vertices: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component): least id of the component, by minimum labels with pointer jumping."""
    scratch = Scratch(vertices.sparkSession, "graph-components")
    adj = scratch.cut(adjacency(edges))
    lab = scratch.cut(vertices.select("id", F.col("id").alias("component")))
    for _ in range(max_rounds):
        least = adj.join(lab, F.col("b") == F.col("id")).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        low = lab.join(least, "id", "left").select("id", F.least("component", "m").alias("component"), F.col("component").alias("before"))
        up = low.select(F.col("id").alias("component"), F.col("component").alias("top"))
        new = scratch.cut(low.join(up, "component", "left").select("id", F.least("component", "top").alias("component"), "before"))
        scratch.drop(lab)
        lab = new
        if lab.where("component <> before").isEmpty():
            return lab.select("id", "component")
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")


def _contracted(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Fewer edges (src, dst) that connect the same ``vertices``."""
    inner = edges
    for end in ("src", "dst"):
        inner = inner.join(vertices.select(F.col("id").alias(end)), end, "left_semi")
    kind = vertices.schema["id"].dataType.simpleString()
    return Scratch(edges.sparkSession, "graph-contracted").cut(inner.select(F.col("src").alias("a"), F.col("dst").alias("b")).mapInArrow(B.contract, f"src {kind}, dst {kind}"))


def component_profile(vertices: DataFrame, edges: DataFrame, comp: DataFrame) -> DataFrame:
    """Nodes, edge rows and the three best-connected members of each component."""
    deg = adjacency(edges).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("degree"))
    c = comp.join(deg, "id", "left").na.fill(0, ["degree"])
    size = c.groupBy("component").agg(F.count("*").alias("n_nodes"))
    n_edges = edges.join(comp, F.col("src") == F.col("id")).groupBy("component").agg(F.count("*").alias("n_edges"))
    best = c.withColumn("r", F.row_number().over(W.partitionBy("component").orderBy(F.desc("degree"), "id"))).where("r <= 3")
    names = best.groupBy("component").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda s: s.id), ",").alias("top"))
    return size.join(n_edges, "component", "left").join(names, "component").na.fill(0, ["n_edges"])


def distances(vertices: DataFrame, edges: DataFrame, max_hops: int = 10_000) -> DataFrame:
    """(s, v, d, sigma) of all pairs in one component: distance and number of shortest paths.

    Breadth-first from all nodes at once, by joins: the way for graphs beyond ``MAX_ADJACENCY``. Its rows
    are quadratic in a component by definition; a path longer than ``max_hops`` raises rather than ends.
    """
    scratch = Scratch(vertices.sparkSession, "graph-distances")
    adj = scratch.cut(adjacency(edges))
    front = vertices.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(0).alias("d"), F.lit(1).cast("bigint").alias("sigma"))
    levels = [scratch.cut(front)]
    for k in range(1, max_hops + 2):
        step = levels[-1].join(adj, F.col("v") == F.col("a")).groupBy("s", F.col("b").alias("v")).agg(F.sum("sigma").alias("sigma"))
        for old in levels[-2:]:  # a neighbour of level k-1 lies on level k-2, k-1 or k
            step = step.join(old.select("s", "v"), ["s", "v"], "left_anti")
        new = scratch.cut(step.select("s", "v", F.lit(k).alias("d"), "sigma"))
        if new.isEmpty():
            break
        if k > max_hops:
            raise RuntimeError(f"paths longer than {max_hops} hops")
        levels.append(new)
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def _binned(edges: DataFrame) -> B.Bins | None:
    """The graph in bins of whole components, or None if one has more than ``MAX_ADJACENCY`` adjacency rows."""
    scratch = Scratch(edges.sparkSession, "graph-adjacency")
    e = edges.where("src is not null and dst is not null and src <> dst")
    pairs = scratch.cut(e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())
    graph = B.bins(pairs, MAX_ADJACENCY, components)
    scratch.drop(pairs)
    return graph


def _covers(vertices: DataFrame, graph: B.Bins) -> bool:
    """Whether ``vertices`` are all nodes of the graph, maybe others, and none twice."""
    return vertices.select("id").distinct().count() == vertices.count() and graph.comp.join(vertices, "id", "left_anti").isEmpty()


def _part(g: B.Csr, sources: np.ndarray) -> tuple[B.Csr, np.ndarray, Callable]:
    """(the graph with twins merged, its node of each of ours, this task's share of some of its nodes)."""
    q, least = g.merged()
    lo, hi = int(sources[0]), int(sources[-1]) + 1
    return q, least, lambda nodes: nodes[lo * len(nodes) // g.n : hi * len(nodes) // g.n]


def _at_once(q: B.Csr, nodes: np.ndarray) -> Iterator[np.ndarray]:
    size = 64 * max(1, min(32, CELLS // q.n))
    return (nodes[lo : lo + size] for lo in range(0, len(nodes), size))


def _of_twins(g: B.Csr, least: np.ndarray, done: np.ndarray, *columns: np.ndarray) -> list[pa.Array]:
    """Names and columns of our nodes whose merged node is ``done``."""
    at = np.flatnonzero(done[least])
    return [g.ids.take(pa.array(at)), *(pa.array(c[least[at]]) for c in columns)]


def _fewer(q: B.Csr) -> np.ndarray | None:
    """The side of the graph with fewer nodes, if it is one component of two sides."""
    return None if q.sides is None else q.sides if 2 * q.sides.sum() <= q.n else ~q.sides


def _from_fewer(graph: B.Bins, large: set[int], tasks: int) -> DataFrame:
    """(bin, id, reached, total, far, bar): of bins of two sides, all of the side with fewer nodes; of the other what lies
    on that side, the distances beyond four on its own, and the nodes of the fewer farther than three steps.

    All neighbours of a node more than four steps away are farther than three; so it has no more of them than ``far``,
    and where that is not above ``bar`` the distances beyond four are known from the nodes with so few.
    """

    def work(g, sources):
        q, least, share = _part(g, sources)
        few = _fewer(q)
        if few is None:
            return
        done, total, far = np.zeros((2, q.n), dtype=np.int64), np.zeros(q.n, dtype=np.int64), np.zeros(q.n, dtype=np.int64)
        bar = int(np.sort(q.count[~few])[few.sum() // 10]) - 1  # some tenth of the searches more
        some, poor = share(np.flatnonzero(few)), share(np.flatnonzero(~few & (q.count <= bar)))
        for x in _at_once(q, some):

            def met(rows, d, bits, x=x):
                total[rows] += d * q.sources_in(bits, x)
                if d > 3:
                    far[rows] += np.bitwise_count(bits).sum(axis=1, dtype=np.int64)

            done[:, x] = q.hops(x, met)
        for x in _at_once(q, poor):

            def beyond(rows, d, bits, x=x):
                if d > 4:
                    total[rows] += np.where(few[rows], 0, (d - 4) * q.sources_in(bits, x))

            q.hops(x, beyond)
        mine = np.zeros(q.n, dtype=bool)
        mine[some] = True
        weight = len(some) if q.weight is None else int(q.weight[some].sum())
        cols = _of_twins(g, least, mine | ~few, np.where(few, done[0], weight), np.where(few, done[1], total), np.where(few, 0, far))
        each = [pa.array(np.full(len(cols[0]), k, dtype=np.int32)) for k in (g.bin, bar)]
        yield pa.record_batch([each[0], *cols, each[1]], names=["bin", "id", "reached", "total", "far", "bar"])

    per = graph.each(work, f"bin int, id {graph.kind}, reached bigint, total bigint, far bigint, bar int", only=large, tasks=tasks)
    sums = [F.sum(c).alias(c) for c in ("reached", "total", "far")]
    return Scratch(graph.table.sparkSession, "graph-fewer").cut(per.groupBy("bin", "id").agg(*sums, F.max("bar").alias("bar")))


def hop_totals(vertices: DataFrame, edges: DataFrame, graph: B.Bins | None = None) -> DataFrame:
    """(id, reached, total): nodes in reach, itself included, and the sum of distances to them.

    Components of at most ``MAX_ADJACENCY`` adjacency rows are packed and their sources spread over the
    tasks, a word of bits holding 64 of them; with a larger one it goes by joins. Both are exact. Of a bin of more than
    ``LARGE_WORK`` with two sides the fewer nodes are searched from: most others are two or four steps from each
    other, which takes two steps to tell; the rest, if not too many, are searched from too.
    """
    graph = graph or _binned(edges)
    if graph is None:
        return distances(vertices, edges).groupBy(F.col("s").alias("id")).agg(F.count("*").alias("reached"), F.sum("d").cast("bigint").alias("total"))
    large, near, tasks, first, rest = {b for b, n, m in graph.sizes if n * m > LARGE_WORK}, set(), None, None, {}
    if large:  # each task gets its bin, so few of them
        slots = edges.sparkSession.sparkContext.defaultParallelism
        first, tasks = _from_fewer(graph, large, slots), slots
        near = {r[0] for r in first.groupBy("bin").agg(F.count_if(F.col("far") > F.col("bar"))).collect() if r[1] <= MAX_REST}
        for bin_ in near:
            rest[bin_] = [r.id for r in first.where((F.col("bin") == bin_) & (F.col("far") > F.col("bar"))).select("id").collect()]  # MAX_REST at most

    def work(g, sources):
        q, least, share = _part(g, sources)
        done = np.zeros((2, q.n), dtype=np.int64)
        if g.bin in near:
            more = ~_fewer(q)
            all_ = int(more.sum() if q.weight is None else q.weight[more].sum())
            far = np.zeros(q.n, dtype=bool)
            far[least[pc.index_in(pa.array(rest[g.bin], g.ids.type), value_set=g.ids).to_numpy()]] = True
            for x in _at_once(q, share(np.flatnonzero(more & ~far))):
                done[0, x], done[1, x] = all_, 4 * all_ - 2 * q.second(x) - 2
            for x in _at_once(q, share(np.flatnonzero(far))):
                done[:, x] = q.hops(x)
        else:
            for x in _at_once(q, share(np.arange(q.n))):
                done[:, x] = q.hops(x)
        yield pa.record_batch(_of_twins(g, least, done[0] > 0, *done), names=["id", "reached", "total"])

    done = graph.each(work, f"id {graph.kind}, reached bigint, total bigint", tasks=tasks)
    if near:
        done = done.unionByName(first.where(F.col("bin").isin(near) & (F.col("far") <= F.col("bar"))).select(*done.columns)).groupBy("id").agg(*(F.sum(c).alias(c) for c in ("reached", "total")))
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    return vertices.select("id").distinct().join(done, "id", "left").select("id", F.coalesce("reached", one).alias("reached"), F.coalesce("total", zero).alias("total"))


def path_shares(vertices: DataFrame, edges: DataFrame, graph: B.Bins | None = None) -> DataFrame:
    """(id, share): sum over ordered pairs of others of the share of their shortest paths through the node."""
    graph = graph or _binned(edges)
    if graph is None:
        n = vertices.count()
        scale = float(max(1, (n - 1) * (n - 2)))
        return betweenness(distances(vertices, edges), n, digits=None).select("id", (F.col("betweenness") * scale).alias("share"))

    def work(g, sources):
        q, least, share = _part(g, sources)
        total, at_once, sources = np.zeros(q.n), max(8, min(256, CELLS // q.n)), share(np.arange(q.n))
        for lo in range(0, len(sources), at_once):
            total += q.dependencies(sources[lo : lo + at_once])
        yield pa.record_batch(_of_twins(g, least, total > 0, total), names=["id", "share"])

    per = graph.each(work, f"id {graph.kind}, share double").groupBy("id").agg(F.sum("share").alias("share"))
    return vertices.select("id").distinct().join(per, "id", "left").na.fill(0.0, ["share"])


def closeness_of(vertices: DataFrame, edges: DataFrame, graph: B.Bins | None = None) -> DataFrame:
    """(id, closeness): (reached-1)/sum of distances, scaled by the share of nodes reached."""
    vertices = Scratch(vertices.sparkSession, "graph-closeness").cut(vertices.select("id").distinct())
    n = vertices.agg(F.greatest(F.count("*") - 1, F.lit(1)).alias("others"))
    c = F.when(F.col("total") > 0, (F.col("reached") - 1) / F.col("total") * (F.col("reached") - 1) / F.col("others")).otherwise(0.0)
    return hop_totals(vertices, edges, graph).crossJoin(F.broadcast(n)).select("id", F.round(c, 4).alias("closeness"))  # one row


def betweenness_of(vertices: DataFrame, edges: DataFrame, graph: B.Bins | None = None) -> DataFrame:
    """(id, betweenness) over ordered pairs, divided by (n-1)(n-2)."""
    n = vertices.select("id").distinct().agg(F.count("*").alias("n"))
    scale = F.greatest(F.lit(1), (F.col("n") - 1) * (F.col("n") - 2))
    return path_shares(vertices, edges, graph).crossJoin(F.broadcast(n)).select("id", F.round(F.col("share") / scale, 6).alias("betweenness"))  # one row


def closeness(dist: DataFrame, n: int) -> DataFrame:
    """(id, closeness): (reached-1)/sum of distances, scaled by the share of nodes reached."""
    g = dist.groupBy(F.col("s").alias("id")).agg(F.count("*").alias("r"), F.sum("d").alias("total"))
    c = F.when(F.col("total") > 0, (F.col("r") - 1) / F.col("total") * (F.col("r") - 1) / max(1, n - 1)).otherwise(0.0)
    return g.select("id", F.round(c, 4).alias("closeness"))


def betweenness(dist: DataFrame, n: int, digits: int | None = 6) -> DataFrame:
    """(id, betweenness) over ordered pairs, divided by (n-1)(n-2)."""
    left = dist.where("d > 0").select("s", "v", F.col("d").alias("d1"), F.col("sigma").alias("g1"))
    right = dist.where("d > 0").select(F.col("s").alias("v"), F.col("v").alias("t"), F.col("d").alias("d2"), F.col("sigma").alias("g2"))
    whole = dist.select("s", F.col("v").alias("t"), F.col("d").alias("d3"), F.col("sigma").alias("g3"))
    on_path = left.join(right, "v").where("s <> t").join(whole, ["s", "t"]).where("d1 + d2 = d3")
    part = on_path.groupBy(F.col("v").alias("id")).agg(F.sum(F.expr("cast(g1 as double) * g2 / g3")).alias("b"))
    scale = float(max(1, (n - 1) * (n - 2)))
    ids = dist.select(F.col("s").alias("id")).distinct()
    b = F.coalesce("b", F.lit(0.0)) / scale
    return ids.join(part, "id", "left").select("id", (b if digits is None else F.round(b, digits)).alias("betweenness"))


def _binned_ranks(vertices: DataFrame, graph: B.Bins, rounds: int, damping: float, tolerance: float) -> DataFrame | None:
    """``pagerank`` of each bin by itself, or None if the graph has nodes besides ``vertices`` or these have some twice.

    Only nodes without neighbours touch all others, and their rank is a number a round; so a first run sums
    up how far the ranks move in each round, and a second one goes as many rounds as that asks for.
    """
    n = vertices.count()
    if not n or not _covers(vertices, graph):
        return None
    alone, base, drift = n - sum(k for _, k, _ in graph.sizes), [1.0 / n], []
    for _ in range(rounds):
        base.append((1 - damping) / n + damping * alone * base[-1] / n)
        drift.append(alone * abs(base[-1] - base[-2]))

    def ranks(g, least):
        r = np.full(g.n, 1.0 / n)
        for b in least:
            old, r = r, b + damping * np.add.reduceat((r / g.count)[g.near], g.start[:-1])
            yield r, np.abs(r - old).sum()

    def moved(g, _):
        far = [m for _, m in ranks(g, base[1:])]
        yield pa.record_batch([pa.array(range(rounds), pa.int32()), pa.array(far)], names=["k", "m"])

    for k, m in sorted(graph.each(moved, "k int, m double", whole=True).groupBy("k").agg(F.sum("m")).collect()):
        drift[k] += m
    last = next((k + 1 for k, m in enumerate(drift) if m < tolerance), rounds)

    def ended(g, _):
        *_, (r, _) = ranks(g, base[1 : last + 1])
        yield pa.record_batch([g.ids, pa.array(r)], names=["id", "rank"])

    done = graph.each(ended, f"id {graph.kind}, rank double", whole=True)
    return vertices.select("id").join(done, "id", "left").select("id", F.coalesce("rank", F.lit(base[last])).alias("rank"))


def pagerank(vertices: DataFrame, edges: DataFrame, rounds: int = 50, damping: float = 0.85, tolerance: float | None = 1e-6, graph: B.Bins | None = None) -> DataFrame:
    """(id, rank) on the undirected simple graph; nodes without neighbours spread their rank evenly."""
    if graph is not None and tolerance is not None and (binned := _binned_ranks(vertices, graph, rounds, damping, tolerance)) is not None:
        return binned
    scratch = Scratch(vertices.sparkSession, "graph-pagerank")
    n = vertices.count()
    if not n:
        return vertices.select("id", F.lit(0.0).alias("rank"))
    adj = scratch.cut(adjacency(edges))
    deg = adj.groupBy("a").agg(F.count("*").alias("deg"))
    rank = scratch.cut(vertices.select("id").join(deg, F.col("id") == F.col("a"), "left").select("id", "deg", F.lit(1.0 / n).alias("rank"), F.lit(0.0).alias("old")))
    for _ in range(rounds):
        loose = rank.where("deg is null").agg(F.sum("rank")).first()[0] or 0.0
        flow = adj.join(rank, F.col("a") == F.col("id")).groupBy(F.col("b").alias("id")).agg(F.sum(F.col("rank") / F.col("deg")).alias("flow"))
        new = F.lit((1 - damping) / n + damping * loose / n) + damping * F.coalesce("flow", F.lit(0.0))
        nxt = scratch.cut(rank.select("id", "deg", "rank").join(flow, "id", "left").select("id", "deg", new.alias("rank"), F.col("rank").alias("old")))
        scratch.drop(rank)
        rank = nxt
        if tolerance is not None and (rank.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0.0) < tolerance:
            break
    return rank.select("id", "rank")


def communities(edges: DataFrame, comp: DataFrame, small: int = 4) -> DataFrame:
    """(id, community): small components whole; else each node with its best-connected neighbour of degree 2 or more."""
    adj = adjacency(edges)
    deg = adj.groupBy(F.col("a").alias("b")).agg(F.count("*").alias("deg"))
    best = adj.join(deg, "b").groupBy("a").agg(F.max("deg").alias("deg"), F.min_by("b", F.struct(-F.col("deg"), F.col("b"))).alias("lead"))
    size = comp.groupBy("component").agg(F.count("*").alias("n"))
    j = comp.join(size, "component").join(best, F.col("id") == F.col("a"), "left")
    key = F.when(F.col("n") <= small, F.col("component")).when(F.col("deg") >= 2, F.col("lead")).otherwise(F.col("id"))
    return j.select("id", "component", F.concat_ws("/", "component", key).alias("community"))


def shortest_hops(edges: DataFrame, pairs: DataFrame, max_hops: int = 6) -> DataFrame:
    """(start, goal, hops) for each wanted pair within ``max_hops`` (1 to 6); 0 for start = goal."""
    scratch = Scratch(edges.sparkSession, "graph-paths")
    max_hops = 6 if max_hops <= 0 else min(6, max_hops)
    adj = scratch.cut(adjacency(edges))
    want = scratch.cut(pairs.select("start", "goal").distinct())
    found = want.where("start = goal").withColumn("hops", F.lit(0))
    seen = scratch.cut(want.select("start", F.col("start").alias("at"), F.lit(0).alias("hops")).distinct())
    front = seen
    for k in range(1, max_hops + 1):
        step = front.join(adj, F.col("at") == F.col("a")).select("start", F.col("b").alias("at")).distinct()
        front = scratch.cut(step.join(seen.select("start", "at"), ["start", "at"], "left_anti").withColumn("hops", F.lit(k)))
        seen = seen.unionByName(front)
        found = found.unionByName(want.join(front.withColumnRenamed("at", "goal"), ["start", "goal"]).select("start", "goal", "hops"))
    return found


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_hops: int = 6) -> DataFrame:
    """(start, goal, hops, path) for each wanted pair within ``max_hops`` (1 to 6).

    Of several shortest paths the first in the order of its ids, node by node, is given.
    """
    scratch = Scratch(edges.sparkSession, "graph-paths")
    max_hops = 6 if max_hops <= 0 else min(6, max_hops)
    adj = scratch.cut(adjacency(edges))
    want = scratch.cut(pairs.select("start", "goal").distinct())
    front = scratch.cut(want.select("start", F.col("start").alias("at"), F.array("start").alias("path")).distinct())
    found = want.where("start = goal").select("start", "goal", F.lit(0).alias("hops"), F.array("start").alias("path"))
    seen = front.select("start", "at")
    for k in range(1, max_hops + 1):
        step = front.join(adj, F.col("at") == F.col("a")).groupBy("start", F.col("b").alias("at")).agg(F.min("path").alias("path"))
        front = scratch.cut(step.join(seen, ["start", "at"], "left_anti").select("start", "at", F.concat("path", F.array("at")).alias("path")))
        seen = seen.unionByName(front.select("start", "at"))
        found = found.unionByName(want.join(front.withColumnRenamed("at", "goal"), ["start", "goal"]).select("start", "goal", F.lit(k).alias("hops"), "path"))
    return found


def path_edges(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(start, goal, step, src, dst, ...): the stored edges, in either direction, between neighbouring nodes of each path."""
    pair = F.arrays_zip(F.expr("slice(path, 1, size(path) - 1)").alias("x"), F.expr("slice(path, 2, size(path) - 1)").alias("y"))
    legs = paths.where("size(path) > 1").select("start", "goal", F.posexplode(pair).alias("p", "leg")).select("start", "goal", (F.col("p") + 1).alias("step"), "leg.x", "leg.y")
    one = legs.join(edges, (F.col("x") == F.col("src")) & (F.col("y") == F.col("dst")))
    other = legs.join(edges, (F.col("x") == F.col("dst")) & (F.col("y") == F.col("src"))).where("src <> dst")
    return one.unionByName(other).drop("x", "y")


def neighbourhood_edges(near: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, src, dst, ...): the edges with both ends in the neighbourhood of each root."""
    ends = near.select("root", "id")
    return edges.join(ends.withColumnRenamed("id", "src"), "src").join(ends.withColumnRenamed("id", "dst"), ["root", "dst"])


def incident_edges(edges: DataFrame, nodes: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, direction, other, other_type, ...): the edges of each node of ``nodes``, seen from it; a loop counts once, as OUT."""
    ids, types = nodes.select("id").distinct(), vertices.select(F.col("id").alias("other"), F.col("type").alias("other_type"))
    out_ = edges.withColumnsRenamed({"src": "id", "dst": "other"}).withColumn("direction", F.lit("OUT"))
    in_ = edges.where("src <> dst").withColumnsRenamed({"dst": "id", "src": "other"}).withColumn("direction", F.lit("IN"))
    return out_.unionByName(in_).join(ids, "id").join(types, "other", "left")


def community_profile(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(community, n_nodes, n_edges, density): inner edge rows over the possible pairs, three places."""
    at = members.select("id", "community")
    inner = edges.join(at.select(F.col("id").alias("src"), F.col("community").alias("c1")), "src").join(at.select(F.col("id").alias("dst"), F.col("community").alias("c2")), "dst")
    n_edges = inner.where("c1 = c2").groupBy(F.col("c1").alias("community")).agg(F.count("*").alias("n_edges"))
    size = at.groupBy("community").agg(F.count("*").alias("n_nodes")).join(n_edges, "community", "left").na.fill(0, ["n_edges"])
    possible = F.col("n_nodes") * (F.col("n_nodes") - 1) / 2
    return size.withColumn("density", F.coalesce(F.round(F.when(possible > 0, F.col("n_edges") / possible), 3), F.lit(0.0)))


def analyse(vertices: DataFrame, edges: DataFrame, measures: tuple[str, ...] = ("closeness", "betweenness", "rank", "community")) -> DataFrame:
    """One row a node: type, degrees, component and the ``measures``, in one run that finds the components once."""
    scratch = Scratch(vertices.sparkSession, "graph-run")
    vertices, edges = scratch.cut(vertices.select("id", "type")), scratch.cut(edges.select("src", "dst"))
    graph = _binned(edges)
    if graph is not None and _covers(vertices, graph):
        comp = scratch.cut(vertices.select("id").join(graph.comp, "id", "left").select("id", F.coalesce("component", "id").alias("component")))
    else:
        comp = scratch.cut(components(vertices, _contracted(vertices, edges)))
    out = vertices.join(degree(vertices, edges), "id")
    if "closeness" in measures:
        out = out.join(closeness_of(vertices, edges, graph), "id", "left")
    if "betweenness" in measures:
        out = out.join(betweenness_of(vertices, edges, graph), "id", "left")
    if "rank" in measures:
        out = out.join(pagerank(vertices, edges, graph=graph).select("id", F.round("rank", 6).alias("rank")), "id", "left")
    return scratch.cut(out.join(communities(edges, comp) if "community" in measures else comp, "id", "left"))


#: Measures by which nodes may be ranked, and what breaks their ties.
METRICS = {"degree": ("degree",), "closeness": ("closeness",), "pagerank": ("rank",), "betweenness": ("betweenness", "degree")}


def top_nodes(run: DataFrame, metric: str = "betweenness", k: int = 20) -> DataFrame:
    """The first k nodes by a measure; an unknown one counts as betweenness; k below 1 keeps all."""
    by = METRICS.get(metric.lower(), METRICS["betweenness"])
    ordered = run.orderBy(*[F.desc(c) for c in by], "id")
    return ordered.limit(k) if k > 0 else ordered


def component_leads(run: DataFrame) -> DataFrame:
    """(component, n_nodes, types, top): members by type and the three with the most betweenness, then degree."""
    types = run.groupBy("component", F.upper("type").alias("type")).agg(F.count("*").alias("n"))
    said = types.groupBy("component").agg(F.sum("n").alias("n_nodes"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "type", "n"))), ",").alias("types"))
    rank = W.partitionBy("component").orderBy(F.desc("betweenness"), F.desc("degree"), "id")
    best = run.withColumn("r", F.row_number().over(rank)).where("r <= 3").groupBy("component").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda x: x.id), ",").alias("top"))
    return said.join(best, "component")


def statistics(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edge rows, average degree and density."""
    n, m = vertices.agg(F.count("*").alias("n_nodes")), edges.agg(F.count("*").alias("n_edges"))
    j = n.crossJoin(m)  # one row each
    pairs = F.col("n_nodes") * (F.col("n_nodes") - 1) / 2
    return j.select("n_nodes", "n_edges", F.round(F.when(F.col("n_nodes") > 0, 2 * F.col("n_edges") / F.col("n_nodes")), 2).alias("avg_degree"), F.round(F.when(pairs > 0, F.col("n_edges") / pairs), 6).alias("density"))


def average_path_length(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: mean distance of the ordered pairs that reach each other (two places, 0 without any)."""
    vertices = Scratch(vertices.sparkSession, "graph-lengths").cut(vertices.select("id").distinct())  # else read again beside the searches
    t = hop_totals(vertices, edges).agg(F.sum("total").alias("t"), F.sum(F.col("reached") - 1).alias("n"))
    return t.select(F.coalesce(F.round(F.when(F.col("n") > 0, F.col("t") / F.col("n")), 2), F.lit(0.0)).alias("avg_path_length"), F.col("n").alias("n_pairs"))


def two_hop(edges: DataFrame) -> DataFrame:
    """(a, b, shared), a < b: pairs with a common neighbour and no edge, and how many they share.

    A node's pairs are counted by the task that has its component, so paths are neither shuffled nor
    written; with a component of more than ``MAX_ADJACENCY`` adjacency rows it goes by joins.
    """
    graph = _binned(edges)
    if graph is None:
        adj = adjacency(edges)
        mid = adj.select(F.col("a").alias("m"), F.col("b").alias("x"))
        pairs = mid.join(mid.withColumnRenamed("x", "y"), "m").where("x < y").groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.count("*").alias("shared"))
        return pairs.join(adj, ["a", "b"], "left_anti")

    def batch(g, run):
        a = np.repeat([k for k, _, _ in run], [len(b) for _, b, _ in run])
        b, shared = (np.concatenate([r[i] for r in run]) for i in (1, 2))
        return pa.record_batch([g.ids.take(pa.array(a)), g.ids.take(pa.array(b)), pa.array(shared)], names=["a", "b", "shared"])

    def work(g, sources):
        run, rows = [], 0
        for k in sources:
            other, shared = g.two_hop(k)
            if len(other):
                run.append((k, other, shared))
                rows += len(other)
            if rows >= 100_000:
                yield batch(g, run)
                run, rows = [], 0
        if run:
            yield batch(g, run)

    return graph.each(work, f"a {graph.kind}, b {graph.kind}, shared bigint")


def fallback_leads(edges: DataFrame) -> DataFrame:
    """Two-hop pairs scored by shared neighbours alone, of which three score as much as more."""

    def score(n: int) -> Column:
        near = F.least(F.lit(0.95), 0.72 + 0.08 * F.lit(n))
        return F.least(F.lit(0.96), 0.50 * near + 0.35 * F.least(F.lit(1.0), 0.4 * F.lit(n)) + 0.10)

    return two_hop(edges).withColumn("score", F.when(F.col("shared") == 1, score(1)).when(F.col("shared") == 2, score(2)).otherwise(score(3)))


def node_features(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, f): type one-hot, degree, in and out share, neighbour-type shares, evidence, events, centrality.

    ``vertices`` may have n_evidence, n_events and betweenness; missing columns count as 1, 0 and 0.
    """
    opt = lambda c, v: F.coalesce(F.col(c).cast("double"), F.lit(v)) if c in vertices.columns else F.lit(v)
    v = vertices.select("id", F.upper("type").alias("type"), opt("n_evidence", 1.0).alias("ev"), opt("n_events", 0.0).alias("te"), opt("betweenness", 0.0).alias("bt"))
    types = v.select("id", "type")
    ends = edges.select(F.col("src").alias("id"), F.col("dst").alias("nb"), F.lit(1).alias("o")).unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("nb"), F.lit(0).alias("o")))
    shares = [F.avg((F.col("t") == t).cast("double")).alias(f"s_{t}") for t in SHARED_TYPES]
    near = ends.join(types.select(F.col("id").alias("nb"), F.col("type").alias("t")), "nb").groupBy("id").agg(F.count("*").alias("deg"), F.sum("o").alias("out"), *shares)
    n = v.agg(F.greatest(F.count("*") - 1, F.lit(1)).alias("others"))
    j = v.join(near, "id", "left").na.fill(0).crossJoin(F.broadcast(n))  # one row
    share = lambda x: F.when(F.col("deg") > 0, x / F.col("deg")).otherwise(0.0)
    parts: list[Column] = [(F.col("type") == t).cast("double") for t in NODE_TYPES]
    parts += [F.col("deg") / F.col("others"), share(F.col("deg") - F.col("out")), share(F.col("out"))]
    parts += [F.col(f"s_{t}") for t in SHARED_TYPES]
    parts += [F.least(F.lit(1.0), F.col("ev") / 10), F.least(F.lit(1.0), F.col("te") / 10), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("bt")))]
    return j.select("id", F.array(*parts).alias("f"))


def link_scores(vertices: DataFrame, edges: DataFrame, least: float = 0.5) -> DataFrame:
    """(a, b, shared, score): two-hop pairs of compatible types by feature cosine, shared neighbours and Jaccard overlap."""
    f = node_features(vertices, edges)
    deg = adjacency(edges).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("deg"))
    side = f.join(vertices.select("id", F.upper("type").alias("type")), "id").join(deg, "id", "left").na.fill(0, ["deg"])
    if vertices.count() <= MAX_FEATURE_ROWS:  # else the pairs are shuffled to the features
        side = F.broadcast(Scratch(vertices.sparkSession, "graph-features").cut(side))
    left = side.select(F.col("id").alias("a"), F.col("f").alias("fa"), F.col("type").alias("ta"), F.col("deg").alias("da"))
    right = side.select(F.col("id").alias("b"), F.col("f").alias("fb"), F.col("type").alias("tb"), F.col("deg").alias("db"))
    ok = F.concat_ws("~", "ta", "tb").isin(*{f"{x}~{y}" for p in COMPATIBLE_TYPES for x, y in (p, p[::-1])})
    pairs = two_hop(edges).join(left, "a").join(right, "b").where(ok)
    from weftline.operators.relational import cosine01

    jac = F.col("shared") / (F.col("da") + F.col("db") - F.col("shared"))
    raw = 0.50 * cosine01(F.col("fa"), F.col("fb")) + 0.35 * F.least(F.lit(1.0), 0.35 * F.col("shared")) + 0.15 * jac
    return pairs.select("a", "b", "shared", F.greatest(F.lit(0.10), F.least(F.lit(0.98), raw)).alias("score")).where(F.col("score") >= least)


def suggested_relation(a: Column, b: Column) -> Column:
    """Relation to suggest between two types; the first rule that fits."""
    either = lambda t: (F.upper(a) == t) | (F.upper(b) == t)
    return (
        F.when((F.upper(a) == "PERSON") & (F.upper(b) == "PERSON"), "ASSOCIATE_OF")
        .when(either("PHONE"), "COMMUNICATED_WITH")
        .when(either("VEHICLE"), "OPERATES")
        .when(either("LOCATION"), "LOCATED_AT")
        .when(either("ACCOUNT"), "TRANSFERRED_MONEY_TO")
        .when(either("ORGANIZATION"), "MEMBER_OF")
        .otherwise("ASSOCIATE_OF")
    )
