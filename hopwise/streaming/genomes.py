"""Summaries of distances that grow as genomes arrive, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merged_summaries(a: DataFrame, b: DataFrame) -> DataFrame:
    """One summary per idx of two sets of genomes, each with a row an idx at most. Means merge by weight and squares by the difference of the means, so any grouping of the genomes gives the same."""
    one = a.unionByName(b).where("count > 0")
    n, mean = F.col("count"), F.col("distance")
    whole = one.groupBy("idx").agg(
        F.sum("count").alias("n"), (F.sum(n * mean) / F.sum(n)).alias("mean"), F.sum("m2").alias("m2"), F.collect_list(F.struct("count", "distance")).alias("parts"), F.min("min_distance").alias("min_distance"), F.max("max_distance").alias("max_distance")
    )
    apart = F.aggregate("parts", F.lit(0.0), lambda x, p: x + p["count"] * (p["distance"] - F.col("mean")) * (p["distance"] - F.col("mean")))
    return whole.select("idx", F.col("mean").alias("distance"), F.col("n").alias("count"), (F.col("m2") + apart).alias("m2"), "min_distance", "max_distance")
