"""Bounded shortest paths from many sources to many targets: one operator, three physical strategies."""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopwise.lineage import checkpointed

#: Directed edges up to which a graph is sent whole to every executor, at 16 bytes an edge and 8 a node.
BROADCAST_EDGES = 5_000_000
#: Directed edges from which on a graph no longer passes through the driver, which took some 530 bytes an edge on check_l.
DEALT_FROM = 1_000_000
#: Directed edges up to which a graph is sent whole to the tasks that search, at 12 bytes an edge and 20 a node, twice that while it is read.
DEALT_EDGES = 40_000_000
#: Sources up to which one task searches.
SOURCES_A_TASK = 8
#: Searches of a graph that is dealt which one task does at most, and tasks that fewer are dealt to.
SEARCHES_A_TASK, TASKS_A_GRAPH = 2_000, 4


class Compact:
    """A graph as arrays: the edges of node i are at first[i] to first[i + 1]."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> None:
        self.nodes = np.unique(src)
        order = np.argsort(src, kind="stable")
        at = np.searchsorted(self.nodes, src[order])
        self.first = np.searchsorted(at, np.arange(len(self.nodes) + 1))
        self.dst = np.searchsorted(self.nodes, dst[order]).astype(np.int32)
        self.weight = weight[order]

    def __contains__(self, node: int) -> bool:
        return self.places(np.array([node]))[0] >= 0

    def places(self, nodes: np.ndarray) -> np.ndarray:
        """Where nodes are, -1 for those that are not there."""
        if not len(self.nodes):
            return np.full(nodes.shape, -1)
        i = np.minimum(np.searchsorted(self.nodes, nodes), len(self.nodes) - 1)
        return np.where(self.nodes[i] == nodes, i, -1)


class Parts:
    """A graph whose edges come in parts, sorted by src. It takes 16 bytes an edge while it is read, up to 28 while it is made and 12 then."""

    def __init__(self) -> None:
        self.nodes, self.first, self.dst, self.weight, self.edges, self.last = [], [], [], [], 0, None

    def add(self, src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> None:
        new = np.flatnonzero(np.diff(src, prepend=src[0] - 1 if self.last is None else self.last))
        self.nodes.append(src[new])
        self.first.append(new + self.edges)
        self.dst.append(dst.copy())  # what is held must not keep the batch that it is of
        self.weight.append(weight.copy())
        self.edges, self.last = self.edges + len(src), src[-1]

    def compact(self) -> Compact:
        """The graph; its parts go."""
        g = Compact.__new__(Compact)
        g.nodes = np.concatenate([*self.nodes, np.empty(0, np.int64)])
        g.first = np.concatenate([*self.first, [self.edges]]).astype(np.int64)
        g.dst, g.weight, to = np.empty(self.edges, np.int32), np.empty(self.edges), self.edges
        while self.dst:
            d, w = self.dst.pop(), self.weight.pop()
            g.dst[to - len(d) : to], g.weight[to - len(d) : to] = np.searchsorted(g.nodes, d), w
            to -= len(d)
        return g


class Search:
    """Searches of one graph, in arrays of its nodes that all searches share.

    A search settles the nearest open node again and again. When many are open, the nearest quarter of them is taken at
    once, until few are left; as a node may then be met again, this is for weights that are not below 0 only.
    """

    #: Open nodes from which on many are taken at once, down to which, and the most at once.
    WIDE, NARROW, AT_ONCE = 4096, 512, 1 << 17

    def __init__(self, graph: Compact, two_sided: bool = False) -> None:
        n = len(graph.nodes)
        self.g, self.best, self.done, self.wanted = graph, np.full(n, np.inf), np.zeros(n, bool), np.zeros(n, bool)
        self.mate = None
        if two_sided:  # the other side of a node's unitig
            self.mate = graph.places(graph.nodes ^ 1).astype(np.int32)
        self.steady = not (graph.weight < 0).any()

    def from_vertex(self, source: int, targets: np.ndarray, bound: float | None = None) -> np.ndarray:
        """Distances under the bound from a vertex to others, inf where there is none. A two-sided vertex starts from both sides and is reached when either is, so the search ends with the first side of the last target."""
        sides = (lambda v: np.stack([2 * v, 2 * v + 1], -1)) if self.mate is not None else (lambda v: v[..., None])
        starts = self.g.places(sides(np.array([source])))[0]
        return self.reach([(0.0, i) for i in starts.tolist() if i >= 0], self.g.places(sides(targets)), bound).min(axis=1)

    def reach(self, starts: list[tuple[float, int]], targets: np.ndarray, bound: float | None = None) -> np.ndarray:
        """Distances of an array of places (-1 for none) from the nearest start, each as far as it is itself. Of both sides of a unitig the nearer one's alone is sure to be right."""
        g, best, done, wanted, mate = self.g, self.best.data, self.done.data, self.wanted.data, None if self.mate is None else self.mate.data
        first, dst, weight, limit = g.first.data, g.dst.data, g.weight.data, float("inf") if bound is None else bound
        aims = np.unique(targets[targets >= 0])
        self.wanted[aims] = True
        left, heap, touched, wide = len(aims), [], array("q"), False
        for d, i in starts:
            if d < best[i]:
                best[i] = d
                touched.append(i)
                heap.append((d, i))
        heapq.heapify(heap)
        while heap and left:
            d, i = heapq.heappop(heap)
            if done[i]:
                continue
            done[i] = True
            if wanted[i]:
                wanted[i], left = False, left - 1
                if mate is not None and (m := mate[i]) >= 0 and wanted[m]:
                    wanted[m], left = False, left - 1
            for e in range(first[i], first[i + 1]):
                j, c = dst[e], d + weight[e]
                if c < limit and c < best[j] and not done[j]:
                    best[j] = c
                    touched.append(j)
                    heapq.heappush(heap, (c, j))
            if len(heap) > self.WIDE and self.steady:
                wide = True
                heap, left = self._wide(heap, aims, limit)
        found = np.where(targets >= 0, self.best[targets], np.inf) if len(g.nodes) else np.full(targets.shape, np.inf)
        self.wanted[aims] = False
        some = slice(None) if wide else np.frombuffer(touched, np.int64)
        self.best[some], self.done[some] = np.inf, False
        return found

    def _wide(self, heap: list[tuple[float, int]], aims: np.ndarray, limit: float) -> tuple[list[tuple[float, int]], int]:
        """Goes on from a heap until few nodes are open; they as a heap, and how many aims are not settled."""
        g, best = self.g, self.best
        near = np.unique(np.fromiter((i for _, i in heap), np.int64, len(heap)))
        near = near[~self.done[near]]
        heap.clear()
        waiting = np.zeros(len(best), bool)
        waiting[near] = True
        while True:
            d = best[near]
            low = d.min() if len(d) else np.inf
            aims = aims[self.wanted[aims]]
            settled = aims[best[aims] <= low]
            if len(settled):
                self.wanted[settled] = False
                if self.mate is not None:
                    mates = self.mate[settled]
                    self.wanted[mates[mates >= 0]] = False
                aims = aims[self.wanted[aims]]
            if not len(aims) or len(near) <= self.NARROW:
                out = list(zip(d.tolist(), near.tolist(), strict=True))
                heapq.heapify(out)
                return out, len(aims)
            upto = np.partition(d, len(d) // 4)[len(d) // 4]
            taken = np.flatnonzero(d <= upto)[: self.AT_ONCE]
            now = near[taken]
            waiting[now] = False
            lo, n = g.first[now], g.first[now + 1] - g.first[now]
            at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            c, j = np.repeat(best[now], n) + g.weight[at], g.dst[at]
            better = (c < best[j]) & (c < limit)
            c, j = c[better], j[better]
            np.minimum.at(best, j, c)
            j = np.unique(j)
            j = j[~waiting[j]]
            waiting[j] = True
            near = np.concatenate([np.delete(near, taken), j])


def by_source(jobs: pd.DataFrame, search: Search, bound: float | None) -> pd.DataFrame:
    found = [(np.empty(0, np.int64), np.empty(0))]
    for source, group in jobs.groupby("source", sort=False):
        d = search.from_vertex(int(source), group["target"].to_numpy(), bound)
        found.append((group["idx"].to_numpy()[np.isfinite(d)], d[np.isfinite(d)]))
    idx, d = zip(*found, strict=True)
    return pd.DataFrame({"idx": np.concatenate(idx), "distance": np.concatenate(d)}).astype({"idx": "int64", "distance": "float64"})


def broadcast_paths(graph: DataFrame, jobs: DataFrame, bound: float | None, two_sided: bool) -> DataFrame:
    """The graph goes to every executor; each task searches from its share of the sources. A graph of over BROADCAST_EDGES is refused."""
    few = graph.select("src", "dst", "weight").limit(BROADCAST_EDGES + 1)
    edges = few.toPandas()
    if len(edges) > BROADCAST_EDGES:
        raise ValueError(f"over {BROADCAST_EDGES} edges are not broadcast; use the dealt or the frontier strategy")
    compact = graph.sparkSession.sparkContext.broadcast(Compact(edges["src"].to_numpy(), edges["dst"].to_numpy(), edges["weight"].to_numpy(float)))
    n = max(1, jobs.select("source").distinct().count() // SOURCES_A_TASK)

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search, held = Search(compact.value, two_sided), None
        for f in frames:  # sorted by source; a source that a batch breaks off is carried on
            held = f if held is None else pd.concat([held, f])
            last = held["source"].iloc[-1] if len(held) else None
            yield by_source(held[held["source"] != last], search, bound)
            held = held[held["source"] == last]
        if held is not None and len(held):
            yield by_source(held, search, bound)

    dealt = jobs.repartition(min(n, 10_000), "source").sortWithinPartitions("source")
    return dealt.mapInPandas(run, "idx long, distance double")


def tasks_for(searches: Column) -> Column:
    """How many tasks so many searches of one graph, which each of them reads, are dealt to."""
    return F.greatest(F.ceil(searches / SEARCHES_A_TASK), F.least(F.ceil(searches / SOURCES_A_TASK), F.lit(TASKS_A_GRAPH))).cast("int")


#: Where a node is on a chain: (chain, first, last, to_first, to_last).
PLACE = "struct<chain: long, first: long, last: long, to_first: double, to_last: double>"
#: Rows of searches: first the edges of a task (kind 0: a, b, w), by a; then its jobs (kind 1: from a to b) by a, before each source's jobs one from it to itself, without idx. l, r: places of b's sides on chains.
DEALT = ("graph", "task", "kind", "a", "b", "w", "idx", "l", "r")


def dealt_rows(edges: DataFrame, jobs: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """DEALT of edges (graph, src, dst, weight) and jobs (graph, source, target, idx) of many graphs; places: graph, unitig, l, r."""
    many = jobs.select("graph", "source").distinct().groupBy("graph").agg(tasks_for(F.count("*")).alias("tasks"))
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    sent = edges.join(many, "graph").withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)))
    sent = sent.select("graph", "task", F.lit(0).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").alias("w"), none("idx", "long"), none("l", PLACE), none("r", PLACE))
    todo = jobs.select("graph", F.col("source").alias("a"), F.col("target").alias("b"), "idx")
    todo = todo.unionByName(jobs.select("graph", F.col("source").alias("a"), F.col("source").alias("b"), none("idx", "long")).distinct())
    todo = todo.join(many, "graph").withColumn("task", F.pmod(F.xxhash64("a"), F.col("tasks")).cast("int"))
    todo = todo.withColumns({"l": none("l", PLACE), "r": none("r", PLACE)}) if places is None else todo.join(places.withColumnRenamed("unitig", "b"), ["graph", "b"], "left")
    return sent.unionByName(todo.select("graph", "task", F.lit(1).alias("kind"), "a", "b", none("w", "double"), "idx", "l", "r"))


class _Task:
    """What a task has read of its rows: the graph in parts, then the jobs of one source."""

    def __init__(self, two_sided: bool, chains: bool, bound: float | None) -> None:
        self.two_sided, self.chains, self.bound = two_sided, chains, bound
        self.parts, self.search, self.jobs = Parts(), None, []

    def answers(self) -> tuple[np.ndarray, np.ndarray]:
        """idx and distances of the jobs read; the first of them is the source's own row."""
        if not self.jobs:
            return np.empty(0, np.int64), np.empty(0)
        if self.search is None:
            self.search = Search(self.parts.compact(), self.two_sided and not self.chains)
        source, target, idx, *on = (np.concatenate(x) for x in zip(*self.jobs, strict=True))
        self.jobs = []
        d = self._on_chains(target, on) if self.chains else self.search.from_vertex(int(source[0]), target[1:], self.bound)
        found = np.isfinite(d) if self.bound is None else d < self.bound
        return idx[1:][found], d[found]

    def _on_chains(self, target: np.ndarray, on: list[np.ndarray]) -> np.ndarray:
        """A side that is on a chain is left and reached by the chain's ends, or along the chain that both lie on."""
        node, off, sides = [], [], (on[:5], on[5:])
        for i, (chain, first, last, to_first, to_last) in enumerate(sides):
            there = chain >= 0
            node += [np.where(there, first, 2 * target + i), np.where(there, last, -1)]
            off += [np.where(there, to_first, 0.0), np.where(there, to_last, np.inf)]
        node, off = np.stack(node, 1), np.stack(off, 1)
        at = self.search.g.places(node)
        starts = [(o, i) for o, i in zip(off[0].tolist(), at[0].tolist(), strict=True) if i >= 0]
        ways = [(self.search.reach(starts, at[1:], self.bound) + off[1:]).min(axis=1)]
        for i in range(4):
            for j in range(4):  # an end that both have, though no edge may leave it
                ways.append(np.where((node[1:, j] == node[0, i]) & (node[0, i] >= 0), off[0, i] + off[1:, j], np.inf))
        for a in sides:
            for b in sides:
                ways.append(np.where((b[0][1:] == a[0][0]) & (a[0][0] >= 0), np.abs(b[3][1:] - a[3][0]), np.inf))
        return np.min(ways, axis=0)


def searched(rows: DataFrame, bound: float | None, two_sided: bool, chains: bool = False) -> DataFrame:
    """graph, idx, distance of DEALT rows. They are streamed: a task holds its graph in arrays and the jobs of one source."""

    def columns(batch: pa.RecordBatch) -> list[np.ndarray]:
        get = lambda x, none: x.fill_null(none).to_numpy(zero_copy_only=False)
        out = [get(batch.column(c), 0.0 if c == "w" else -1) for c in DEALT[:7]]
        for s in ("l", "r") if chains else ():
            out += [get(x, 0.0 if i > 2 else -1) for i, x in enumerate(batch.column(s).flatten())]
        return out

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, key, source = None, None, None

        def told() -> Iterator[pa.RecordBatch]:
            if task is not None:
                idx, d = task.answers()
                if len(idx):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(idx), key[0], np.int64)), pa.array(idx), pa.array(d)], ["graph", "idx", "distance"])

        for batch in batches:
            if not batch.num_rows:
                continue
            graph, at, kind, a, *more = columns(batch)
            new = (np.diff(graph) != 0) | (np.diff(at) != 0) | (np.diff(kind) != 0) | ((np.diff(a) != 0) & (kind[1:] == 1))
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(a)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if key != (graph[lo], at[lo]):
                    yield from told()
                    task, key, source = _Task(two_sided, chains, bound), (graph[lo], at[lo]), None
                if kind[lo] == 0:
                    task.parts.add(a[lo:hi], more[0][lo:hi], more[1][lo:hi])
                    continue
                if source != a[lo]:
                    yield from told()
                    source = a[lo]
                task.jobs.append((a[lo:hi], *(x[lo:hi] for x in (more[0], *more[2:]))))
        yield from told()

    dealt = rows.select(*DEALT).repartition("graph", "task").sortWithinPartitions("graph", "task", "kind", "a", F.col("idx").asc_nulls_first())
    return dealt.mapInArrow(run, "graph long, idx long, distance double")


def dealt_paths(graph: DataFrame, jobs: DataFrame, bound: float | None, two_sided: bool) -> DataFrame:
    """For graphs that a task can hold but the driver need not: the edges are shuffled to the tasks that search."""
    one = F.lit(0).cast("long").alias("graph")
    rows = dealt_rows(graph.select(one, "src", "dst", "weight"), jobs.select(one, "source", "target", "idx"))
    return searched(rows, bound, two_sided).select("idx", "distance")


def frontier_paths(graph: DataFrame, jobs: DataFrame, bound: float | None, two_sided: bool) -> DataFrame:
    """For graphs that no executor can hold: all searches advance together, one edge a round, as joins and minima.

    A round joins the nodes whose distance fell with their edges and keeps what improves. A source's search goes on only
    below its farthest target so far, once all its targets are reached.
    """
    node = F.explode(F.array(F.col("source") * 2, F.col("source") * 2 + 1)) if two_sided else F.col("source")
    vertex = F.shiftright("node", 1) if two_sided else F.col("node")
    best = jobs.select("source").distinct().select("source", node.alias("node")).withColumn("d", F.lit(0.0))
    frontier = best = checkpointed(best)
    reach = checkpointed(jobs.select("source", F.col("target").alias("vertex")).distinct().withColumn("d", F.lit(None).cast("double")))
    while True:
        # targets are reached by what fell last alone; what was known of them stays
        fell = frontier.withColumn("vertex", vertex).groupBy("source", "vertex").agg(F.min("d").alias("now"))
        reach = checkpointed(reach.join(fell, ["source", "vertex"], "left").select("source", "vertex", F.least("d", "now").alias("d")))
        limit = reach.groupBy("source").agg(F.when(F.count("d") == F.count("*"), F.max("d")).alias("limit"))
        step = frontier.join(graph, frontier["node"] == graph["src"]).select("source", F.col("dst").alias("node"), (F.col("d") + F.col("weight")).alias("d"))
        if bound is not None:
            step = step.where(F.col("d") < bound)
        step = step.groupBy("source", "node").agg(F.min("d").alias("d")).join(limit, "source").where(F.col("limit").isNull() | (F.col("d") < F.col("limit"))).drop("limit")
        known = best.select("source", "node", F.col("d").alias("old"))
        frontier = checkpointed(step.join(known, ["source", "node"], "left").where(F.col("old").isNull() | (F.col("d") < F.col("old"))).drop("old"))
        if not frontier.limit(1).count():
            break
        best = checkpointed(best.union(frontier).groupBy("source", "node").agg(F.min("d").alias("d")))
    found = reach.where("d is not null").select("source", F.col("vertex").alias("target"), F.col("d").alias("distance"))
    return jobs.join(found, ["source", "target"]).select("idx", "distance")


def shortest_paths(graph: DataFrame, jobs: DataFrame, max_distance: float | None = None, two_sided: bool = False, strategy: str = "auto", broadcast_edges: int = BROADCAST_EDGES) -> DataFrame:
    """idx, distance of the jobs (source, target, idx) whose target is reached at less than max_distance.

    strategy: broadcast, dealt, frontier, or auto, which counts the edges first.
    """
    if strategy == "auto":
        n = graph.count()
        strategy = "broadcast" if n <= min(broadcast_edges, DEALT_FROM) else "dealt" if n <= DEALT_EDGES else "frontier"
    run = {"broadcast": broadcast_paths, "dealt": dealt_paths, "frontier": frontier_paths}[strategy]
    return run(graph, jobs, max_distance, two_sided)
