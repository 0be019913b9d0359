"""Graphs whose chains of degree-2 nodes are one edge each, and searches that start, end and pass on chains."""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopwise.lineage import checkpointed, unsized


class Contracted:
    """A small graph whose chains of degree-2 nodes are one edge each; distances stay what they were.

    chain: node -> (chain, distance to its start, distance to its end, place); ends: chain -> (start, end, length).
    """

    def __init__(self, neighbours: dict[int, dict[int, float]]) -> None:
        self.chain: dict[int, tuple[int, float, float, int]] = {}
        self.ends: list[tuple[int, int, float]] = []
        self.graph: dict[int, dict[int, float]] = {}
        inner = {n for n, e in neighbours.items() if len(e) == 2}
        self.kept = {n for n in neighbours if n not in inner}
        for n in sorted(self.kept):
            for m, w in neighbours[n].items():
                if m in self.kept:
                    self._edge(n, m, w)
                elif m not in self.chain:
                    self._walk(neighbours, n, m, w)
        for n in sorted(inner):  # what is left are loops without a kept node: one node of each is kept
            if n not in self.chain and n not in self.kept:
                self.kept.add(n)
                m, w = next(iter(neighbours[n].items()))
                self._walk(neighbours, n, m, w)

    def _edge(self, a: int, b: int, w: float) -> None:
        for x, y in ((a, b), (b, a)):
            e = self.graph.setdefault(x, {})
            e[y] = min(e.get(y, w), w)

    def _walk(self, neighbours: dict[int, dict[int, float]], start: int, node: int, length: float) -> None:
        way, before, at = [], start, length
        while node not in self.kept:
            way.append((node, at))
            after, w = next((m, w) for m, w in neighbours[node].items() if m != before)
            before, node, at = node, after, at + w
        number = len(self.ends)
        self.ends.append((start, node, at))
        for place, (n, d) in enumerate(way, 1):
            self.chain[n] = (number, d, at - d, place)
        self.graph.setdefault(start, {})
        if start != node:
            self._edge(start, node, at)


class ChainSearch:
    """Searches of a two-sided contracted graph. edges: (src, dst, weight) between kept nodes; places: node on a chain -> (chain, first, last, to_first, to_last)."""

    def __init__(self, edges: Iterable[tuple[int, int, float]], places: dict[int, tuple[int, int, int, float, float]]) -> None:
        self.places, self.edges = places, {}
        for a, b, w in edges:
            self.edges.setdefault(a, []).append((b, w))

    def entries(self, node: int) -> tuple[tuple[int, float], ...]:
        """Kept nodes by which a node is left or reached, and how far they are: itself, or both ends of its chain."""
        if (p := self.places.get(node)) is None:
            return ((node, 0.0),)
        return ((p[1], p[3]), (p[2], p[4]))

    def distances(self, source: int, targets: Iterable[int], bound: float | None = None) -> dict[int, float]:
        """Distances under the bound from a vertex to those targets that it reaches, over both sides of each."""
        sides = lambda v: (2 * v, 2 * v + 1)
        targets = list(targets)
        best: dict[int, float] = {}
        for side in sides(source):
            for node, d in self.entries(side):
                best[node] = min(d, best.get(node, d))
        wanted = {node for t in targets for side in sides(t) for node, _ in self.entries(side)}
        done: dict[int, float] = {}
        heap = [(d, node) for node, d in best.items()]
        heapq.heapify(heap)
        while heap and wanted:
            d, node = heapq.heappop(heap)
            if node in done:
                continue
            done[node] = d
            wanted.discard(node)
            for other, w in self.edges.get(node, ()):
                c = d + w
                if (bound is None or c < bound) and c < best.get(other, float("inf")):
                    best[other] = c
                    heapq.heappush(heap, (c, other))
        out = {}
        for t in targets:
            ways = [done[node] + d for side in sides(t) for node, d in self.entries(side) if node in done]
            ways += [self.between(a, b) for a in sides(source) for b in sides(t) if self.same_chain(a, b)]
            if ways and (bound is None or min(ways) < bound):
                out[t] = min(ways)
        return out

    def same_chain(self, a: int, b: int) -> bool:
        return a in self.places and b in self.places and self.places[a][0] == self.places[b][0]

    def between(self, a: int, b: int) -> float:
        """The way along the chain that both lie on."""
        return abs(self.places[a][3] - self.places[b][3])


#: Rows of contracted graphs: an edge from `first` to `last` of length to_first, or, with a chain, a node on it and its place from the first.
CONTRACTED = "chain long, node long, first long, last long, to_first double, to_last double, place long"


def _walked(inner: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """Both ways out of each inner node (by, node, n0, w0, n1, w1: its neighbours, the smaller first, and their weights).

    by, node, way, tail, end, d, hops of those that end at a kept node: the last inner node before it, it, and how far it
    is; and by, node of those that never end. A way points to the one that goes on from the next inner node, and takes
    over what that one points to: so it doubles in every round, and no graph is held in a task.
    """
    out = F.explode(F.array(*[F.struct(F.lit(i).alias("way"), F.col(f"n{i}").alias("next"), F.col(f"w{i}").alias("d")) for i in (0, 1)]))
    ways = inner.select(by, "node", out.alias("x")).select(by, "node", "x.*")
    met = inner.select(by, F.col("node").alias("next"), "n0")
    ways = ways.join(met, [by, "next"], "left")
    over = F.col("n0").isNull()  # the next node is kept
    none = F.lit(None).cast("long")
    step = checkpointed(
        ways.select(
            by, "node", "way", F.when(over, none).otherwise(F.col("next")).alias("to"), F.when(over, none).otherwise((F.col("n0") == F.col("node")).cast("long")).alias("to_way"),
            F.when(over, F.col("node")).alias("tail"), F.when(over, F.col("next")).alias("end"), "d", F.when(over, 0).otherwise(1).cast("long").alias("hops"),
        )
    )
    ended, before = unsized(step.where("end is not null")), -1
    while True:
        going = unsized(step.where("end is null"))
        n = going.count()
        if n in (0, before):  # a way that ends makes one fewer in each round: the others go round
            return ended.drop("to", "to_way"), going.select(by, "node").distinct()
        before = n
        far = ended.unionByName(going).select(F.col(by), F.col("node").alias("to"), F.col("way").cast("long").alias("to_way"), *[F.col(c).alias(f"far_{c}") for c in ("to", "to_way", "tail", "end", "d", "hops")])
        step = checkpointed(
            going.select(by, "node", "way", "to", "to_way", "d", "hops").join(far, [by, "to", "to_way"]).select(
                by, "node", "way", F.col("far_to").alias("to"), F.col("far_to_way").alias("to_way"), F.col("far_tail").alias("tail"), F.col("far_end").alias("end"),
                (F.col("d") + F.col("far_d")).alias("d"), (F.col("hops") + F.col("far_hops")).alias("hops"),
            )
        )
        ended = ended.unionByName(unsized(step.where("end is not null")))


def _loops(inner: DataFrame, by: str) -> DataFrame:
    """by, node, least: of nodes on loops without a kept node, the least node of the loop."""
    out = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("way"), F.col(f"n{i}").alias("to")) for i in (0, 1)]))
    ways = inner.select(by, "node", out.alias("x")).select(by, "node", "x.*")
    ways = ways.join(inner.select(by, F.col("node").alias("to"), "n0"), [by, "to"])
    ways = checkpointed(ways.select(by, "node", "way", "to", (F.col("n0") == F.col("node")).cast("long").alias("to_way"), F.col("node").alias("least")))
    while True:
        ways = unsized(ways)
        far = ways.select(by, F.col("node").alias("to"), F.col("way").alias("to_way"), F.col("to").alias("far_to"), F.col("to_way").alias("far_way"), F.col("least").alias("far_least"))
        after = checkpointed(ways.join(far, [by, "to", "to_way"]).select(by, "node", "way", F.col("far_to").alias("to"), F.col("far_way").alias("to_way"), F.least("least", "far_least").alias("least"), (F.col("far_least") < F.col("least")).alias("fell")))
        ways = after.drop("fell")
        if not after.where("fell").limit(1).count():
            return ways.groupBy(by, "node").agg(F.min("least").alias("least"))


def _placed(ended: DataFrame, by: str) -> DataFrame:
    """by and CONTRACTED of the inner nodes, of both their ways: the smaller end first."""
    at = [F.max(F.when(F.col("way") == i, F.col(c))).alias(f"{c}{i}") for i in (0, 1) for c in ("tail", "end", "d", "hops")]
    both = ended.groupBy(by, "node").agg(*at)
    ahead = (F.col("end0") < F.col("end1")) | ((F.col("end0") == F.col("end1")) & (F.col("tail0") < F.col("tail1")))
    near = lambda c: F.when(ahead, F.col(f"{c}0")).otherwise(F.col(f"{c}1"))
    far = lambda c: F.when(ahead, F.col(f"{c}1")).otherwise(F.col(f"{c}0"))
    return both.select(by, F.least("tail0", "tail1").alias("chain"), "node", near("end").alias("first"), far("end").alias("last"), near("d").alias("to_first"), far("d").alias("to_last"), (near("hops") + 1).alias("place"))


def contracted(graphs: DataFrame, by: str = "genome_id", loops: bool = True) -> DataFrame:
    """by and CONTRACTED of each graph, by joins alone: no graph is taken as a whole. A loop without a node of another degree than 2 keeps its least node, or, without `loops`, is left out."""
    graphs = checkpointed(graphs.select(by, "src", "dst", "weight"))
    each = graphs.groupBy(by, F.col("src").alias("node")).agg(F.count("*").alias("degree"), *[f(c, "dst").alias(n) for n, f, c in (("w0", F.min_by, "weight"), ("w1", F.max_by, "weight"))], F.min("dst").alias("n0"), F.max("dst").alias("n1"))
    inner = unsized(checkpointed(each.where("degree = 2").select(by, "node", "n0", "w0", "n1", "w1")))
    ended, round_ = _walked(inner, by)
    if loops and round_.limit(1).count():
        closed = inner.join(round_, [by, "node"], "left_semi")
        ended = ended.unionByName(_walked(closed.join(_loops(closed, by), [by, "node"]).where("node <> least").drop("least"), by)[0])
    on = unsized(checkpointed(_placed(ended, by)))
    none = lambda kind: F.lit(None).cast(kind)
    kept = graphs.join(inner.select(by, F.col("node").alias("src")), [by, "src"], "left_anti").join(inner.select(by, F.col("node").alias("dst")), [by, "dst"], "left_anti")
    short = kept.where("src < dst").select(by, F.col("src").alias("a"), F.col("dst").alias("b"), "weight")
    short = short.unionByName(on.where("node = chain and first < last").select(by, F.col("first").alias("a"), F.col("last").alias("b"), (F.col("to_first") + F.col("to_last")).alias("weight")))
    short = short.groupBy(by, "a", "b").agg(F.min("weight").alias("weight"))
    both = F.explode(F.array(F.struct(F.col("a").alias("first"), F.col("b").alias("last")), F.struct(F.col("b").alias("first"), F.col("a").alias("last"))))
    edges = short.select(by, both.alias("e"), "weight").select(by, none("long").alias("chain"), none("long").alias("node"), "e.first", "e.last", F.col("weight").alias("to_first"), none("double").alias("to_last"), none("long").alias("place"))
    return edges.unionByName(on)


def contracted_edges(parts: DataFrame, by: str = "genome_id") -> DataFrame:
    """by, src, dst, weight of contracted graphs, in both directions."""
    return parts.where("chain is null").select(by, F.col("first").alias("src"), F.col("last").alias("dst"), F.col("to_first").alias("weight"))


def chain_places(parts: DataFrame, by: str = "genome_id") -> DataFrame:
    """by, node, first, last, to_first, to_last: the ends of each chain node's chain, the smaller first, and how far they are; of a chain that returns to one node the nearer way first."""
    same = F.col("first") == F.col("last")
    near, far = F.least("to_first", "to_last"), F.greatest("to_first", "to_last")
    return parts.where("chain is not null").select(
        by, "node", "first", "last", F.when(same, near).otherwise(F.col("to_first")).alias("to_first"), F.when(same, far).otherwise(F.col("to_last")).alias("to_last")
    )


def unitig_places(parts: DataFrame, by: str = "genome_id") -> DataFrame:
    """by, unitig, l, r: where its left and its right side are on chains, null of a side that is kept."""
    cols = ("chain", "first", "last", "to_first", "to_last")
    at = [F.max(F.when(F.col("node") % 2 == i, F.col(c))).alias(f"{s}_{c}") for i, s in enumerate("lr") for c in cols]
    each = parts.where("chain is not null").groupBy(by, F.shiftright("node", 1).alias("unitig")).agg(*at)
    side = lambda s: F.when(F.col(f"{s}_chain").isNotNull(), F.struct(*[F.col(f"{s}_{c}").alias(c) for c in cols])).alias(s)
    return each.select(by, "unitig", side("l"), side("r"))


def distances_on_chains(parts: DataFrame, pairs: DataFrame, by: str = "genome_id") -> DataFrame:
    """pairs (by, v, w, nodes) that lie on one chain, with the way along it: what lies between the nearer place and the farther one, below 0 where weights are."""
    at = lambda n: parts.where("chain is not null").select(by, "chain", F.col("node").alias(n), F.col("to_first").alias(f"at_{n}"), F.col("place").alias(f"place_{n}"))
    along = F.when(F.col("place_v") < F.col("place_w"), F.col("at_w") - F.col("at_v")).otherwise(F.col("at_v") - F.col("at_w"))
    return pairs.join(at("v"), [by, "v"]).join(at("w"), [by, "chain", "w"]).select(by, "v", "w", along.alias("distance"))
