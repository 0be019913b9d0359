"""Proportional stratified interleaving of rows into shards, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hopwise.llm.common import checkpointed, picked

SHARDS = 24
SEED = 20_240_601
#: Buckets that a rank is counted in: 2**12 for the shuffle within a source, as many for the fractional rank.
BUCKET_HEX = 3


def interleaved_shards(df: DataFrame, shards: int = SHARDS, seed: int = SEED, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Rows of a source are shuffled by a seeded digest of doc_id and ranked; (rank - 1/2) / rows of the source orders all
    rows, and the order is cut into shards whose row counts differ by one at most. Each source then has in every shard
    its share of the rows, to within one.

    No window spans a source or the table. A rank is a count of the rows in earlier buckets (a small table: buckets by
    sources) plus a rank within a bucket, so a source with a third of all rows is spread over 4096 groups.
    Null sources are a source of their own; a null doc_id is shuffled as an empty one; rows alike in doc_id, size and
    checksum are interchangeable; a null text has size 8; an empty table gives an empty result.
    """
    buckets = 16**BUCKET_HEX
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = picked(df, doc_id=doc_id, text=text, source=source).select(
        "doc_id",
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("stratum"),
        F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("shuffled"),
    )
    rows = checkpointed(rows.withColumn("bucket", F.conv(F.substring("shuffled", 1, BUCKET_HEX), 16, 10).cast("int")))
    tie = ["shuffled", "doc_id", "size", "text_crc32"]

    upto = Window.partitionBy("stratum").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        rows.groupBy("stratum", "bucket").count()
        .select("stratum", "bucket", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("before"), F.sum("count").over(Window.partitionBy("stratum")).alias("of"))
    )
    within = F.row_number().over(Window.partitionBy("stratum", "bucket").orderBy(*tie))
    ranked = rows.withColumn("nth", within).join(before, ["stratum", "bucket"])
    part = (F.col("before") + F.col("nth") - F.lit(0.5)) / F.col("of")
    ranked = checkpointed(ranked.select("doc_id", "size", "text_crc32", "stratum", "shuffled", part.alias("part"), F.floor(part * buckets).cast("int").alias("cell")))

    cells = ranked.groupBy("cell").count()
    earlier = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # over one row a cell, 4096 at most
    cells = cells.select("cell", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("ahead"), F.sum("count").over(Window.partitionBy(F.lit(0))).alias("total"))
    place = F.col("ahead") + F.row_number().over(Window.partitionBy("cell").orderBy("part", "stratum", *tie)) - 1
    shard = F.expr(f"cast((place * {shards}) div total as int)")
    return (
        ranked.join(cells, "cell").withColumn("place", place).withColumn("shard", shard)
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                F.expr(f"place - (shard * total + {shards - 1}) div {shards}").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
