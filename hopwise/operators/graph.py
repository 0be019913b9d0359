"""Graphs as edge tables: src, dst, weight, both directions of every edge, one row each.

A two-sided graph has two nodes for a unitig u, 2u on its left and 2u + 1 on its right, joined by an edge of the
unitig's length less k.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopwise.functions.expressions import left_node, right_node, source_side, target_side, unitig_of


def normalised(edges: DataFrame, *by: str, v: str = "v", w: str = "w", weight: str = "weight") -> DataFrame:
    """Undirected edges without loops, parallel ones as their least weight, in both directions; `by` keeps graphs apart.

    The least weight is taken over unordered pairs, so it combines map-side and only one direction is shuffled.
    """
    one = edges.where(F.col(v) != F.col(w)).groupBy(*by, F.least(v, w).alias("a"), F.greatest(v, w).alias("b")).agg(F.min(weight).alias("weight"))
    both = F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))
    return one.select(*by, both.alias("e"), "weight").select(*by, "e.src", "e.dst", "weight")


def links(edges: DataFrame, *by: str) -> DataFrame:
    """v, w, weight of the kept links of a de Bruijn graph between sides; a link of overlap 0 is none."""
    kept = edges.where(F.col("overlap").isNull() | (F.col("overlap") != 0))
    return kept.select(*by, source_side(F.col("v"), F.col("edge_type")).alias("v"), target_side(F.col("w"), F.col("edge_type")).alias("w"), F.lit(1.0).alias("weight"))


def self_edges(unitigs: DataFrame, *by: str) -> DataFrame:
    """The edge between the two sides of each unitig."""
    u = F.col("unitig")
    return unitigs.select(*by, left_node(u).alias("v"), right_node(u).alias("w"), F.col("self_weight").cast("double").alias("weight"))


def cdbg(unitigs: DataFrame, edges: DataFrame) -> DataFrame:
    """The two-sided graph of unitigs (unitig, self_weight) and edges (v, w, edge_type, overlap)."""
    return normalised(self_edges(unitigs).unionByName(links(edges)))


def genome_members(edges: DataFrame) -> DataFrame:
    """genome_id, unitig: unitigs that a kept link of the genome touches."""
    kept = edges.where(F.col("overlap").isNull() | (F.col("overlap") != 0))
    return kept.select("genome_id", F.explode(F.array("v", "w")).alias("unitig")).distinct()


def genome_graphs(unitigs: DataFrame, edges: DataFrame) -> DataFrame:
    """genome_id, src, dst, weight: of every genome its kept links and its unitigs, whose weights are the whole graph's."""
    own = genome_members(edges).join(self_weights(unitigs, edges), "unitig")
    return normalised(self_edges(own, "genome_id").unionByName(links(edges, "genome_id")), "genome_id")


def self_weights(unitigs: DataFrame, edges: DataFrame) -> DataFrame:
    """unitig, self_weight: the weight of the unitig itself."""
    return unitigs.select("unitig", "self_weight")


def degrees(graph: DataFrame) -> DataFrame:
    """node, degree."""
    return graph.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def profile(graph: DataFrame, two_sided: bool) -> DataFrame:
    """One row: connected_nodes, edges, avg_degree, max_degree. Two-sided: both sides of a unitig as one, without the edge between them."""
    d = degrees(graph)
    if two_sided:
        d = d.groupBy(unitig_of(F.col("node")).alias("node")).agg(F.sum("degree").alias("degree"))
        d = d.select(F.when(F.col("degree") >= 2, F.col("degree") - 2).otherwise(F.col("degree")).alias("degree"))
    d = d.where("degree > 0")
    total = F.coalesce(F.sum("degree"), F.lit(0))
    return d.agg(
        F.count("*").alias("connected_nodes"), F.floor(total / 2).cast("long").alias("edges"), F.coalesce(F.avg("degree"), F.lit(0.0)).alias("avg_degree"), F.coalesce(F.max("degree"), F.lit(0)).cast("long").alias("max_degree")
    )


def contains(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes (node) with connected: whether an edge touches the node."""
    return nodes.join(graph.select(F.col("src").alias("node")).distinct().withColumn("connected", F.lit(True)), "node", "left").fillna(False, ["connected"])


def has_edges(graph: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (v, w) with the weight of the edge between them, or null."""
    return pairs.join(graph.select(F.col("src").alias("v"), F.col("dst").alias("w"), "weight"), ["v", "w"], "left")


def without_edges(graph: DataFrame, pairs: DataFrame) -> DataFrame:
    """The graph without the edges between pairs (v, w), in both directions."""
    gone = pairs.select(F.col("v").alias("src"), F.col("w").alias("dst"))
    return graph.join(gone.union(gone.select("dst", "src")).distinct(), ["src", "dst"], "left_anti")


def without_nodes(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """The graph without the edges of nodes (node)."""
    n = nodes.select("node").distinct()
    return graph.join(n.withColumnRenamed("node", "src"), "src", "left_anti").join(n.withColumnRenamed("node", "dst"), "dst", "left_anti").select(*graph.columns)


def with_edges(graph: DataFrame, edges: DataFrame) -> DataFrame:
    """The graph with edges (v, w, weight) put in, in both directions; of parallel ones the least weight stays. A node comes with its first edge."""
    old = graph.where("src < dst").select(F.col("src").alias("v"), F.col("dst").alias("w"), "weight")
    return normalised(old.unionByName(edges.select("v", "w", F.col("weight").cast("double").alias("weight"))))
