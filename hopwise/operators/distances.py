"""Distances of query pairs in a whole graph and over many genomes' graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopwise.lineage import checkpointed, unsized
from hopwise.operators.chains import contracted, contracted_edges, unitig_places
from hopwise.operators.graph import genome_members
from hopwise.operators.paths import dealt_rows, searched, shortest_paths
from hopwise.plans.jobs import plan_jobs


def with_distances(queries: DataFrame, found: DataFrame) -> DataFrame:
    """All queries with what was found for their idx, null where nothing was."""
    return queries.drop("distance", "count").join(found, "idx", "left")


def graph_distances(graph: DataFrame, queries: DataFrame, max_distance: float | None = None, two_sided: bool = False, strategy: str = "auto") -> DataFrame:
    """queries with distance, null where there is none below max_distance, as for a vertex with itself."""
    return with_distances(queries, shortest_paths(graph, plan_jobs(queries), max_distance, two_sided, strategy))


def genome_pair_distances(graphs: DataFrame, edges: DataFrame, queries: DataFrame, max_distance: float | None = None) -> DataFrame:
    """genome_id, idx, distance of each pair in each genome that connects it.

    graphs: genome_id, src, dst, weight; edges: the genomes' links, which say what unitigs a genome has. Each genome's
    graph is contracted once: chains of nodes with two neighbours become edges. Then all genomes are one job: the
    contracted edges are streamed to the tasks that search the genome, followed by its searches, each with the places of
    its own nodes on chains. What is longest in a genome, its chains, is never sent to a search.
    """
    members = genome_members(edges)
    jobs = plan_jobs(queries)
    here = jobs.join(members.withColumnRenamed("unitig", "source"), "source").join(members.withColumnRenamed("unitig", "target"), ["genome_id", "target"])
    here = checkpointed(here.select(F.col("genome_id").alias("graph"), "source", "target", "idx"))
    parts = checkpointed(contracted(graphs))
    rows = dealt_rows(contracted_edges(parts).withColumnRenamed("genome_id", "graph"), unsized(here), unitig_places(parts).withColumnRenamed("genome_id", "graph"))
    return searched(rows, max_distance, True, True).withColumnRenamed("graph", "genome_id")


def summarised(pairs: DataFrame) -> DataFrame:
    """idx, distance (mean), count, m2, min_distance, max_distance over the genomes that connect the pair; any parts of the rows merge."""
    return pairs.groupBy("idx").agg(
        F.avg("distance").alias("distance"), F.count("distance").alias("count"), F.regr_sxx("distance", "distance").alias("m2"), F.min("distance").alias("min_distance"), F.max("distance").alias("max_distance")
    )


def genome_distances(graphs: DataFrame, edges: DataFrame, queries: DataFrame, max_distance: float | None = None) -> DataFrame:
    """queries with the summary of their distances over the genomes; count is 0 and the rest null where none connects the pair."""
    found = summarised(genome_pair_distances(graphs, edges, queries, max_distance))
    return with_distances(queries, found).withColumn("count", F.coalesce("count", F.lit(0)))


def variance(summary: DataFrame) -> DataFrame:
    """With variance, m2 / (count - 1), null for fewer than two genomes."""
    return summary.withColumn("variance", F.when(F.col("count") > 1, F.col("m2") / (F.col("count") - 1)))


def average_sizes(graphs: DataFrame) -> DataFrame:
    """One row: avg_nodes and avg_edges over the genomes, whole numbers."""
    each = graphs.groupBy("genome_id").agg(F.countDistinct("src").alias("nodes"), (F.count("*") / 2).cast("long").alias("edges"))
    return each.agg(F.floor(F.avg("nodes")).cast("long").alias("avg_nodes"), F.floor(F.avg("edges")).cast("long").alias("avg_edges"))
