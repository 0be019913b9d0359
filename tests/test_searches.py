"""Searches in arrays: many open nodes at once, edges in parts, and the memory that they take."""

import math
import random
import tracemalloc

import numpy as np
import pytest

from hopwise.operators import graph
from hopwise.operators.paths import Compact, Parts, Search, shortest_paths
from hopwise.plans.jobs import plan_jobs
from tests.test_graph import dijkstra


def edges_of(r, unitigs, links):
    some = {(2 * u, 2 * u + 1): float(r.randrange(30)) for u in range(unitigs)}
    some |= {tuple(sorted(r.sample(range(2 * unitigs), 2))): float(r.randrange(9)) for _ in range(links)}
    both = sorted([(a, b, w) for (a, b), w in some.items()] + [(b, a, w) for (a, b), w in some.items()])
    return [np.array(x) for x in zip(*both, strict=True)]


@pytest.mark.parametrize("seed", range(6))
def test_open_nodes_at_once_give_the_same_distances(seed):
    r = random.Random(seed)
    src, dst, weight = edges_of(r, 40, r.choice([30, 70]))
    full, parts = list(zip(src.tolist(), dst.tolist(), weight.tolist(), strict=True)), Parts()
    for at in range(0, len(src), 7):
        parts.add(src[at : at + 7], dst[at : at + 7], weight[at : at + 7])
    for g in (Compact(src, dst, weight), parts.compact()):
        search = Search(g, True)
        search.WIDE, search.NARROW, search.AT_ONCE = r.choice([(3, 1, 2), (3, 0, 1000), (4096, 512, 1000)])
        for source in range(8):
            targets = np.array([t for t in r.sample(range(42), 12) if t != source])
            want = dijkstra(full, source, True)
            for bound in (None, 12.0):
                assert search.from_vertex(source, targets, bound).tolist() == [d if (d := want.get(t, math.inf)) < (bound or math.inf) else math.inf for t in targets.tolist()]


def test_weights_below_0_end_a_search():
    g = Compact(np.array([0, 1, 1, 2]), np.array([1, 0, 2, 1]), np.array([-1.0, -1.0, 3.0, 3.0]))
    search = Search(g)
    search.WIDE = 0
    assert search.from_vertex(0, np.array([1, 2])).tolist() == [-1.0, 2.0]


def test_a_search_takes_a_few_bytes_an_edge():
    src, dst, weight = edges_of(random.Random(1), 20_000, 60_000)
    g = Compact(src, dst, weight)
    tracemalloc.start()
    assert np.isfinite(Search(g, True).from_vertex(0, np.arange(1, 20_000))).mean() > 0.9
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * len(src)  # some 200 when each node met kept its edges as tuples


@pytest.mark.parametrize("two_sided", [False, True])
def test_dealt_searches_agree_with_brute_force(spark, two_sided):
    r = random.Random(7)
    g = graph.normalised(spark.createDataFrame([(r.randrange(24), r.randrange(24), float(r.randrange(1, 9))) for _ in range(40)], "v long, w long, weight double"))
    both = [(e["src"], e["dst"], e["weight"]) for e in g.collect()]
    q = [(i, r.randrange(12), r.randrange(14)) for i in range(60)]
    jobs = plan_jobs(spark.createDataFrame(q, "idx long, v long, w long"))
    for bound in (None, 7.0):
        want = {i: d for i, v, w in q if v != w and (d := dijkstra(both, v, two_sided).get(w)) is not None and (bound is None or d < bound)}
        assert {x["idx"]: x["distance"] for x in shortest_paths(g, jobs, bound, two_sided, "dealt").collect()} == want
