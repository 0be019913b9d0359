"""Writers of the text formats and of typed results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopwise.functions.expressions import LARGEST_DOUBLE, fixed_distance, printed
from hopwise.operators.outliers import Parameters

_SUMMARY = ("m2", "min_distance", "max_distance")


def result_rows(rows: DataFrame, one_based: bool = False, bound: float | None = None) -> DataFrame:
    """Typed results: idx, v, w, the distance cut to a whole number or -1, flag, score and count where there are any, and the summary; -1 in the summary of no genomes."""
    base, mean = int(one_based), "count" in rows.columns
    cols = [F.col("idx"), (F.col("v") + base).alias("v"), (F.col("w") + base).alias("w"), fixed_distance(F.col("distance"), bound).cast("long").alias("distance")]
    cols += [F.col("flag").cast("int").alias("flag")] * ("flag" in rows.columns) + [F.col("score")] * ("score" in rows.columns) + [F.col("count")] * mean
    if mean and "m2" in rows.columns:
        cols += [F.coalesce(c, F.lit(-1.0)).alias(c) for c in _SUMMARY]
    else:
        cols += [F.lit(0.0).alias("m2"), F.col("distance").alias("min_distance"), F.col("distance").alias("max_distance")]
    return rows.select(*cols)


def result_lines(rows: DataFrame, one_based: bool = False, bound: float | None = None) -> DataFrame:
    """idx, line: v w distance [flag] [score] [count] m2 min max, as the text format spells them.

    A pair without a distance in the whole graph has as least and largest distance the bound, or the largest double
    where there is none or nothing was searched, and one at distance 0 the largest double as least.
    """
    typed = result_rows(rows, one_based, bound)
    mean = "count" in rows.columns
    parts = [F.col(c).cast("string") for c in ("v", "w", "distance")]
    parts += [F.col("flag").cast("string")] * ("flag" in typed.columns) + [printed(F.col("score"))] * ("score" in typed.columns) + [F.col("count").cast("string")] * mean
    most = F.lit(LARGEST_DOUBLE)
    none = most if bound is None else F.when(F.col("v") == F.col("w"), most).otherwise(printed(F.lit(float(bound))))
    if mean and "m2" in rows.columns:
        parts += [printed(F.col(c)) for c in _SUMMARY]
    else:
        least, largest = F.col("min_distance"), F.col("max_distance")
        parts += [F.lit("0"), F.when(least.isNull(), none).when(least == 0, most).otherwise(printed(least)), F.coalesce(printed(largest), none)]
    return typed.select("idx", F.concat_ws(" ", *parts).alias("line"))


def write_results(rows: DataFrame, path: str, one_based: bool = False, bound: float | None = None, single: bool = False) -> None:
    """Text in the order of the queries, in as many part files as the sort makes, to be read in the order of their names; single: in one, for readers of one file."""
    lines = result_lines(rows, one_based, bound).orderBy("idx").select("line")
    (lines.coalesce(1) if single else lines).write.mode("overwrite").text(path)


def stats_line(p: Parameters) -> str:
    return f"{p.ld_distance} {p.outlier_threshold:.6g} {p.extreme_threshold:.6g} {p.count_threshold}"


def stats_frame(like: DataFrame, p: Parameters) -> DataFrame:
    """One row: ld_distance, outlier_threshold, extreme_outlier_threshold, count_threshold."""
    return like.sparkSession.createDataFrame([(p.ld_distance, p.outlier_threshold, p.extreme_threshold, p.count_threshold)], "ld_distance long, outlier_threshold double, extreme_outlier_threshold double, count_threshold long")


def write_outliers(outliers: DataFrame, p: Parameters, path: str, stats_path: str, one_based: bool = False) -> bool:
    """Both files, or neither if there is no outlier."""
    if not outliers.limit(1).count():
        return False
    write_results(outliers, path, one_based)
    outliers.sparkSession.createDataFrame([(stats_line(p),)], "line string").coalesce(1).write.mode("overwrite").text(stats_path)
    return True
