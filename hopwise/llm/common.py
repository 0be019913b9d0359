"""What the training-data operators share: row ids, lineage cuts and byte-level words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopwise.lineage import checkpointed as checkpointed

#: Name of the internal row key; inputs may carry any other column.
RID = "__rid"


def row_key(doc_id: str, text: str) -> Column:
    """128 bits of doc_id, its length before it, and text. Unlike a row number it stays the same when a lost executor's files are split anew; rows alike in both share it."""
    said = F.col(f"`{doc_id}`").cast("string")
    key = F.unhex(F.md5(F.concat(F.coalesce(F.concat(F.length(said).cast("string"), F.lit("|"), said), F.lit("n")), F.lit("|"), F.coalesce(F.col(f"`{text}`"), F.lit("")))))
    return F.coalesce(key, F.lit(b""))  # never null, as the plan can see


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def picked(df: DataFrame, **columns: str | Column) -> DataFrame:
    """The named input columns only, under internal names; whatever else the input carries can't clash."""
    return df.select(*[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(n) for n, c in columns.items()])


def fresh(df: DataFrame, name: str) -> str:
    """The name, or one like it that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def only(df: DataFrame, kept: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows of df whose key is in kept, with all their columns; of rows with the same key one."""
    key = fresh(df, RID)
    return df.withColumn(key, row_key(doc_id, text)).join(kept.withColumnRenamed(RID, key), key, "left_semi").dropDuplicates([key]).drop(key)


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [b if b is not None else b"" for b in column.cast(pa.binary()).to_pylist()]


def arrow(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def rows_at_a_time(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of at most so many rows, so that what is computed for each text stays small beside the batch."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def by_group(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by group, a whole group at a time."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        at = 0
        while at < b.num_rows:
            group = b["group"].to_numpy()
            end = at + int(np.searchsorted(group[at:], group[at], "right"))
            if held and held[0]["group"][0].as_py() != group[at]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(at, end - at))
            at = end
    if held:
        yield pa.Table.from_batches(held)
