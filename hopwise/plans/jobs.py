"""Planning pair queries as single-source searches."""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries up to which the driver plans greedily; beyond, each pair is oriented by counts in the cluster.
GREEDY = 50_000


def query_counts(queries: DataFrame) -> DataFrame:
    """vertex, n: queries that each vertex takes part in, over both places."""
    return queries.select(F.explode(F.array("v", "w")).alias("vertex")).groupBy("vertex").agg(F.count("*").alias("n"))


def oriented_jobs(queries: DataFrame) -> DataFrame:
    """source, target, idx: every pair is searched from the end with more queries, the larger id of equals. Pairs of a vertex with itself have no job."""
    n = query_counts(queries)
    q = queries.where("v <> w").select("idx", "v", "w")
    q = q.join(n.select(F.col("vertex").alias("v"), F.col("n").alias("nv")), "v").join(n.select(F.col("vertex").alias("w"), F.col("n").alias("nw")), "w")
    forward = F.struct("nv", "v") > F.struct("nw", "w")
    return q.select(F.when(forward, F.col("v")).otherwise(F.col("w")).alias("source"), F.when(forward, F.col("w")).otherwise(F.col("v")).alias("target"), "idx")


def greedy_plan(pairs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(source, target, idx) of pairs (idx, v, w): again and again the vertex with most pairs left, the largest id of equals, takes all of them."""
    left: dict[int, dict[int, int]] = defaultdict(dict)
    size: dict[int, int] = defaultdict(int)
    for idx, v, w in pairs:
        if v != w:
            left[v][idx] = w
            left[w][idx] = v
        size[v] += 1
        size[w] += 1
    heap = [(-n, -v) for v, n in size.items()]
    heapq.heapify(heap)
    jobs = []
    while heap:
        n, v = heapq.heappop(heap)
        v = -v
        if -n != size[v]:
            if size[v] > 0:
                heapq.heappush(heap, (-size[v], -v))
            continue
        for idx, w in left.pop(v, {}).items():
            jobs.append((v, w, idx))
            del left[w][idx]
            size[w] -= 1
        size[v] = 0
    return jobs


def plan_jobs(queries: DataFrame, greedy: int = GREEDY) -> DataFrame:
    """source, target, idx. Few queries are planned greedily for the fewest searches; the distances are the same either way."""
    rows = queries.select("idx", "v", "w").limit(greedy + 1).collect()
    if len(rows) > greedy:
        return oriented_jobs(queries)
    return queries.sparkSession.createDataFrame(greedy_plan([tuple(r) for r in rows]), "source long, target long, idx long")
