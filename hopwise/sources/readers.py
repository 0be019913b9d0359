"""Readers of the header-less, single-space text formats. Every one checks what it reads and numbers rows in file order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopwise.functions.expressions import fields, weight_or_one

#: The query formats, by number: fewest fields, and the places of score, flag and count.
FORMATS = {
    0: (2, None, None, None),
    1: (3, 2, None, None),
    2: (4, 3, None, None),
    3: (5, 4, 3, None),
    4: (5, 3, None, 4),
    5: (6, 4, 3, 5),
}
#: Fields of a format's rows in words.
FORMAT_NAMES = {0: "v w", 1: "v w score", 2: "v w distance score", 3: "v w distance flag score", 4: "v w distance score count", 5: "v w distance flag score count"}


class FormatError(ValueError):
    """A file that does not have the rows it should have."""


def deduce_format(line: str, outliers_only: bool) -> int | None:
    """The query format that the first line has, by its number of fields."""
    n = len(line.split(" ")) - line.endswith(" ")
    if n == 5:
        return 4 if outliers_only else 3
    return {2: 0, 3: 1, 4: 2, 6: 5}.get(n)


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(idx, value): each line and its place in the file, or in the files of a folder in the order of their names.

    A line's place is the sum of the lines in the blocks before it, which are counted once, and its place in its own
    block; so the file is never gathered.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    start, total = [], 0
    for file, block, low, n in sorted(tuple(r) for r in lines.groupBy("file", "block").agg(F.min("id"), F.count("*")).collect()):  # a row for each block
        start.append((file, block, total - low))
        total += n
    if not start:
        return spark.createDataFrame([], "idx long, value string")
    before = F.broadcast(spark.createDataFrame(start, "file string, block long, before long"))
    return lines.join(before, ["file", "block"]).select((F.col("id") + F.col("before")).alias("idx"), "value")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(idx, f): each line's place in the file, or in the files of a folder in the order of their names, and its fields."""
    return _numbered(spark, path).select("idx", fields(F.col("value")).alias("f"))


def _checked(lines: DataFrame, least: int, path: str, *bad: Column) -> DataFrame:
    wrong = F.size("f") < least
    for b in bad:
        wrong = wrong | F.coalesce(b, F.lit(True))
    first = lines.where(wrong).orderBy("idx").limit(1).collect() if "idx" in lines.columns else lines.where(wrong).limit(1).collect()
    if first:
        raise FormatError(f"{path}: a line with too few or wrong fields: {' '.join(first[0]['f'])!r}")
    return lines


def _long(i: int) -> Column:
    return F.get("f", F.lit(i)).try_cast("long")


def _ids(base: int) -> list[Column]:
    return [_long(0) < base, _long(1) < base]


def read_general_edges(spark: SparkSession, path: str, one_based: bool = False) -> DataFrame:
    """v, w, weight; the weight is 1 where the third field is no number."""
    lines = spark.read.text(path).select(fields(F.col("value")).alias("f"))
    base = int(one_based)
    weight = weight_or_one(F.coalesce(F.get("f", F.lit(2)), F.lit("")))
    _checked(lines, 2, path, *_ids(base), weight < 0)
    return lines.select((_long(0) - base).alias("v"), (_long(1) - base).alias("w"), weight.alias("weight"))


def read_unitigs(spark: SparkSession, path: str, k: int) -> DataFrame:
    """unitig, self_weight: the line's place and the bytes of the sequence less k."""
    lines = numbered_lines(spark, path)
    weight = F.octet_length(F.get("f", F.lit(1))).cast("long") - k
    _checked(lines, 2, path, weight < 0)
    return lines.select(F.col("idx").alias("unitig"), weight.alias("self_weight"))


def _links(lines: DataFrame, path: str, one_based: bool, *also: str) -> DataFrame:
    base, overlap = int(one_based), F.get("f", F.lit(3))
    _checked(lines, 3, path, *_ids(base), overlap.isNotNull() & overlap.try_cast("long").isNull())
    return lines.select(*also, (_long(0) - base).alias("v"), (_long(1) - base).alias("w"), F.get("f", F.lit(2)).alias("edge_type"), overlap.try_cast("long").alias("overlap"))


def read_cdbg_edges(spark: SparkSession, path: str, one_based: bool = False) -> DataFrame:
    """v, w, edge_type, overlap."""
    return _links(spark.read.text(path).select(fields(F.col("value")).alias("f")), path, one_based)


def read_genome_paths(spark: SparkSession, path: str) -> list[str]:
    """One path a line; a path listed twice is two genomes."""
    paths = [r["value"] for r in spark.read.text(path).coalesce(1).collect()]  # a list of file names
    if not paths:
        raise FormatError(f"{path}: no genomes")
    if any(not p for p in paths):
        raise FormatError(f"{path}: an empty line")
    return paths


def _raw_path(spark: SparkSession, path: str) -> str:
    """The path without scheme and host, as Spark reports it of a row's file."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toUri().getRawPath()


def read_genome_edges(spark: SparkSession, paths: list[str], one_based: bool = False) -> DataFrame:
    """genome_id, v, w, edge_type, overlap of all files, or folders of them, in one scan."""
    for p in set(paths):
        check_file(spark, p)
    name = F.regexp_replace(F.col("_metadata.file_path"), r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?(?=/)", "")
    own = F.explode(F.array(name, F.regexp_replace(name, "/[^/]*$", ""))).alias("path")  # a line is of its file, and of the folder that this is in
    lines = spark.read.text(sorted(set(paths))).select(own, fields(F.col("value")).alias("f"))
    listed = spark.createDataFrame([(i, _raw_path(spark, p)) for i, p in enumerate(paths)], "genome_id long, path string")
    return _links(lines.join(F.broadcast(listed), "path").select("genome_id", "f"), "genome edges", one_based, "genome_id")  # one row a genome


def read_queries(spark: SparkSession, path: str, fmt: int | None = None, one_based: bool = False, n: int | None = None, outliers_only: bool = False) -> DataFrame:
    """idx, v, w and what the format has of flag, score, and, for outliers alone, distance and count."""
    numbered = _numbered(spark, path)
    head = numbered.where("idx = 0").take(1)
    if not head:
        raise FormatError(f"{path}: no queries")
    fmt = deduce_format(head[0]["value"], outliers_only) if fmt is None else fmt
    if fmt is None:
        raise FormatError(f"{path}: the format can't be told from the first line")
    if outliers_only and fmt not in (4, 5):
        raise FormatError(f"{path}: outliers alone need format 4 or 5")
    least, score, flag, count = FORMATS[fmt]
    lines = numbered.select("idx", fields(F.col("value")).alias("f"))
    if n is not None and n > 0:
        lines = lines.where(F.col("idx") < n)
    base = int(one_based)
    number = lambda i: F.get("f", F.lit(i)).try_cast("double")
    _checked(lines, least, path, *_ids(base), *([number(score).isNull()] if score else []))
    cols = [F.col("idx"), (_long(0) - base).alias("v"), (_long(1) - base).alias("w")]
    if outliers_only:
        cols.append(F.when(number(2) >= 0, F.floor(number(2)).cast("double")).alias("distance"))
    if flag:
        cols.append((F.coalesce(_long(flag), F.lit(0)) != 0).alias("flag"))
    if score:
        cols.append(number(score).alias("score"))
    if outliers_only and count:
        cols.append(_long(count).alias("count"))
    return lines.select(*cols)


def query_columns(rows: DataFrame, fmt: int, n: int | None = None, outliers_only: bool = False) -> DataFrame:
    """The columns that a format has, of a table that has them all and an idx: the Parquet twin of read_queries."""
    _, score, flag, count = FORMATS[fmt]
    rows = rows if n is None or n <= 0 else rows.where(F.col("idx") < n)
    kept = ["idx", "v", "w"] + ["distance"] * outliers_only + ["flag"] * bool(flag) + ["score"] * bool(score) + ["count"] * bool(count and outliers_only)
    return rows.select(*kept)


def check_file(spark: SparkSession, path: str) -> None:
    """Raises FileNotFoundError unless Spark can see the file."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        raise FileNotFoundError(path)


def read_plot_rows(spark: SparkSession, path: str, counts: str | None = None, n: int = 0) -> DataFrame:
    """idx, v, w, distance (null for -1), flag, score of written results of formats 3 and 5, and count from a file with one on each line.

    n: rows to read, 0 for all. Counts that are fewer than the rows are left out.
    """
    lines = numbered_lines(spark, path)
    lines = lines.where(F.col("idx") < n) if n > 0 else lines
    number = lambda i: F.get("f", F.lit(i)).try_cast("double")
    _checked(lines, 5, path, number(2).isNull(), number(4).isNull())
    rows = lines.select("idx", _long(0).alias("v"), _long(1).alias("w"), F.when(number(2) >= 0, number(2)).alias("distance"), (_long(3) != 0).alias("flag"), number(4).alias("score"))
    if counts is None:
        return rows
    each = numbered_lines(spark, counts).select("idx", _long(0).alias("count"))
    each = each.where(F.col("idx") < n) if n > 0 else each  # as many as there are rows at most: no other is joined
    return rows.join(each, "idx") if each.count() >= rows.count() else rows
