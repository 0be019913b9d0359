"""Exact deduplication by a tree-merge of sorted digest runs, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopwise.llm.common import RID, checkpointed, only, picked, row_key

#: Runs merged into one in a round: four binomial steps.
FAN_IN_BITS = 4

_SPACE = r"[\x20\x09-\x0D]+"


def exact_dedup(df: DataFrame, text: str = "text", doc_id: str = "doc_id", fan_in_bits: int = FAN_IN_BITS, keyed: bool = False) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256; with keyed, the row's key too.

    Texts are equal when they are identical without ``[\\x20\\x09-\\x0D]``; of equal texts the row with the most code
    points stays, then the smallest doc_id. Each input partition is one run: sorted by digest, one row for each text.
    In every round up to 2**fan_in_bits neighbouring runs become one; the merge keeps the smallest identifier of each
    text and adds the counts. A run is spread over the cluster by digest, so no task holds a whole run. Texts count as
    equal only if SHA-256, a second 64-bit hash and the length all agree, which is checked at every level.

    A hot text costs one row a run before the first exchange, and the copies meet their group again in a plain join,
    whose large keys can be split.

    Texts of any length are compared whole. Null texts are empty; a null doc_id comes after all others; of rows alike in
    everything one stays; an empty table gives an empty result; other columns are not looked at.
    """
    norm = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), _SPACE, "")
    key = [row_key("doc_id", "text").alias(RID)] if keyed else []
    rows = picked(df, doc_id=doc_id, text=text)
    rows = rows.select(
        *key, F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("chars"), norm.alias("norm"), F.spark_partition_id().alias("run")
    )
    rows = checkpointed(rows.select("*", F.sha2("norm", 256).alias("digest"), F.xxhash64("norm").alias("proof"), F.octet_length("norm").alias("size")).drop("norm"))
    same = ["digest", "proof", "size"]
    best = F.struct((-F.col("chars")).alias("fewer"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row"))
    runs = rows.groupBy("run", *same).agg(F.min(best).alias("best"), F.count("*").alias("n"))
    last = rows.agg(F.max("run")).first()[0] or 0
    while True:
        last >>= fan_in_bits
        runs = runs.groupBy(F.shiftright("run", fan_in_bits).alias("run"), *same).agg(F.min("best").alias("best"), F.sum("n").alias("n"))
        if not last:
            break
    kept = checkpointed(runs.select(*same, F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"), F.col("n").alias("group_size")))
    return rows.join(kept, same).select(
        *([RID] if keyed else []), "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("digest").alias("text_sha256")
    )


def survivors(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of df that stay, with all their columns."""
    return only(df, exact_dedup(df, text, doc_id, keyed=True).where("kept").select(RID), doc_id, text)
