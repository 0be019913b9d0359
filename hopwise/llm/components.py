"""Connected components of a link table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopwise.lineage import unsized
from hopwise.llm.common import checkpointed


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of the links, root being the smallest node that it reaches.

    Each round takes the smallest root next to a node, hangs the node's own root below it and halves the paths to the
    roots, so the rounds grow with the logarithm of the longest chain. Labels stay in the cluster and are cut from their
    lineage in every round; a hub of many links is reduced map-side and met in joins whose large keys can be split.
    """
    pair = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    pair = checkpointed(pair.union(pair.select("b", "a")).distinct())
    label = checkpointed(pair.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).withColumn("root", F.least("node", "root")))
    while True:
        near = pair.join(label, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        seen = label.join(near.withColumnRenamed("a", "node"), "node").select("node", "root", F.least("root", "near").alias("low"))
        hung = seen.groupBy("root").agg(F.min("low").alias("hung"))
        low = seen.join(hung, "root").select("node", "root", F.least("low", "hung").alias("low"))
        low = checkpointed(low)
        up = low.select(F.col("node").alias("low"), F.col("low").alias("top"))
        after = checkpointed(low.join(up, "low").select("node", "root", F.col("top").alias("now")))
        moved = after.where("now <> root").limit(1).count()
        label = unsized(after.select("node", F.col("now").alias("root")))
        if not moved:
            return label


def dealt_out(rooted: DataFrame, node: str, rows: int) -> DataFrame:
    """rooted: key, root and more of the members of buckets. Of buckets with several roots each row, with group, slice, main and own.

    Those of a bucket's commonest root (main) are dealt out to its slices of about so many rows, each to its own; the
    others go to all slices. So where most of a large bucket is connected, what is sent grows with it and not with its
    square. Pairs of others meet in every slice; the slice that is the own one of the smaller counts.
    """
    each = rooted.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key")
    several = each.agg(F.sum("n").alias("n"), F.count("*").alias("roots"), F.max_by("root", "n").alias("most")).where("roots > 1")
    several = checkpointed(several.select("key", "most", F.expr(f"cast(ceil(n / {rows}) as int)").alias("slices")))
    out = rooted.join(several, "key").withColumn("main", F.col("root") == F.col("most"))
    out = out.withColumn("own", F.pmod(F.xxhash64(F.lit(1), node), F.col("slices")).cast("int"))
    out = out.withColumn("slice", F.explode(F.when(F.col("main"), F.array("own")).otherwise(F.sequence(F.lit(0), F.col("slices") - 1))))
    return out.withColumn("group", F.xxhash64("key", "slice")).drop("most", "slices")
