"""Outliers among scored pairs: the largest score of each vertex beyond a distance, its quartiles, fences, and the distance itself.

rows: idx, v, w, distance (null where there is none), score and, for means, count.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopwise.functions.expressions import fixed_distance
from hopwise.lineage import checkpointed, stored

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Parameters:
    """What the search for outliers has settled; -1 where it has not."""

    ld_distance: int = -1
    outlier_threshold: float = -1.0
    extreme_threshold: float = -1.0
    count_threshold: int = 0
    coverage: int = 0
    max_score: float = 0.0
    q1: float | None = None
    q3: float | None = None
    probes: int = 0


def counted(rows: DataFrame, threshold: int) -> DataFrame:
    """Rows of enough genomes; rows without counts are not means and all stay."""
    return rows.where(F.col("count") >= threshold) if threshold > 0 and "count" in rows.columns else rows


def beyond(rows: DataFrame, ld: int, bound: float | None = None) -> DataFrame:
    """Rows at least ld apart. bound: the distance that rows without one count as, if they count as far."""
    far = F.coalesce("distance", F.lit(-1.0 if bound is None else float(bound)))
    return rows.where(far >= ld)


def vertex_scores(rows: DataFrame, ld: int, count_threshold: int = 0, bound: float | None = None) -> DataFrame:
    """vertex, score: the largest score over 0 of each vertex, at either place of a row."""
    kept = beyond(counted(rows, count_threshold), ld, bound)
    return kept.select(F.explode(F.array("v", "w")).alias("vertex"), "score").groupBy("vertex").agg(F.max("score").alias("score")).where("score > 0")


def _at(name: str, n: int, place: int) -> Column:
    """The value at a place of the ascending order, counted from 0: no interpolation, and no collected list."""
    return F.expr(f"percentile_disc({(place + 0.5) / n}D) WITHIN GROUP (ORDER BY {name})")


def quartile_places(n: int, nth: int) -> tuple[int, int, int]:
    """Where the first and third quartile and the nth largest value (from 0) stand in n ascending values."""
    return min(n - 1, n // 4), min(n - 1, 3 * n // 4), n - 1 - min(n - 1, nth)


def distribution(scores: DataFrame, nth: int) -> tuple[int, float, float, float] | None:
    """(vertices, q1, q3, nth largest) of vertex scores, or None if there are none."""
    n = scores.count()
    if not n:
        return None
    a, b, c = quartile_places(n, nth)
    row = scores.agg(_at("score", n, a).alias("q1"), _at("score", n, b).alias("q3"), _at("score", n, c).alias("nth")).first()
    return n, row["q1"], row["q3"], row["nth"]


def calculated(rows: DataFrame, ld: int, p: Parameters, nth: int, bound: float | None = None) -> Parameters:
    """p with the fences for rows at least ld apart. With no scores only max_score changes, to 0."""
    found = distribution(checkpointed(vertex_scores(rows, ld, p.count_threshold, bound)), nth)
    if found is None:
        return replace(p, ld_distance=ld, max_score=0.0)
    n, q1, q3, top = found
    return replace(p, ld_distance=ld, coverage=n, q1=q1, q3=q3, max_score=top, outlier_threshold=q3 + 1.5 * (q3 - q1), extreme_threshold=q3 + 3.0 * (q3 - q1))


def query_values(rows: DataFrame) -> DataFrame:
    """One row: largest_score, n_vertices, largest_vertex."""
    ends = rows.select(F.explode(F.array("v", "w")).alias("vertex")).agg(F.countDistinct("vertex").alias("n_vertices"), F.max("vertex").alias("largest_vertex"))
    return rows.agg(F.greatest(F.lit(0.0), F.max("score")).alias("largest_score")).join(F.broadcast(ends))  # one row each


def largest_distance(rows: DataFrame, count_threshold: int = 0, bound: float | None = None) -> float:
    far = F.coalesce("distance", F.lit(-1.0 if bound is None else float(bound)))
    return counted(rows, count_threshold).agg(F.greatest(F.lit(0.0), F.max(far))).first()[0] or 0.0


def automatic_ld(rows: DataFrame, low: int, high: int, required: float, p: Parameters, nth: int, bound: float | None = None) -> Parameters:
    """Bisect [low, high]: at a middle where the nth largest vertex score is under `required` the upper end moves there, else the lower.

    What the last middle gave stays, whichever way it went. What decides is known of each vertex in one pass: its
    largest distance of all, and its largest with a score of `required` or more. Where more than nth vertices reach a
    middle, the nth largest score is high enough if more than nth do with such a score; where fewer do, if all do. So
    the nth + 1 largest of either kind settle every step, and the scores are read again for the last middle alone.
    """
    far = F.coalesce("distance", F.lit(-1.0 if bound is None else float(bound)))
    kept = counted(rows, p.count_threshold).where("score > 0").select(F.explode(F.array("v", "w")).alias("vertex"), "score", far.alias("far"))
    each = kept.groupBy("vertex").agg(F.max("far").alias("far"), F.max(F.when(F.col("score") >= required, F.col("far"))).alias("enough"))
    each = each.cache()
    try:
        enough = [r[0] for r in each.where("enough is not null").orderBy(F.desc("enough")).limit(nth + 1).select("enough").collect()]
        farthest = [(r[0], r[1]) for r in each.orderBy(F.desc("far")).limit(nth + 1).select("far", "enough").collect()]
    finally:
        each.unpersist()

    def low_score(mid: int) -> bool:
        there = [x for d, x in farthest if d >= mid]
        if required <= 0 or not there:
            return required > 0
        return not all(x is not None and x >= mid for x in there) if len(there) <= nth else not (len(enough) > nth and enough[nth] >= mid)

    middles = []
    while high - low > 1:
        middles.append((low + high) // 2)
        low, high = (low, middles[-1]) if low_score(middles[-1]) else (middles[-1], high)
    if not middles:
        log.warning("no distance to search; every row with a score of -1 or more is an outlier")
        return p
    scored = [m for m in middles if farthest and farthest[0][0] >= m]  # a middle without scores leaves the fences as they were
    q = calculated(rows, scored[-1], p, nth, bound) if scored else p
    if not scored or scored[-1] != middles[-1]:
        q = replace(q, ld_distance=middles[-1], max_score=0.0)
    return replace(q, probes=len(middles))


def parameters(rows: DataFrame, ld: int | None = None, ld_min: int = 1000, ld_score: float = 0.8, nth: int = 10, threshold: float | None = None, count_threshold: int = 0, bound: float | None = None) -> Parameters:
    """The settled parameters. Without ld it is searched for, and a given threshold counts only if there is nothing to search."""
    fixed = {} if threshold is None else {"outlier_threshold": threshold, "extreme_threshold": threshold}
    p = Parameters(count_threshold=count_threshold, **fixed)
    if ld is not None:
        return replace(p, ld_distance=ld) if threshold is not None else calculated(rows, ld, p, nth, bound)
    # the rows are passed over three times, but joined or read once
    with stored(rows.select("v", "w", "distance", "score", *["count"] * (count_threshold > 0 and "count" in rows.columns))) as rows:
        top = rows.agg(F.greatest(F.lit(0.0), F.max("score"))).first()[0] or 0.0
        high = int(largest_distance(rows, count_threshold, bound))
        return automatic_ld(rows, 0 if high < ld_min else ld_min, high, ld_score * top, p, nth, bound)


def collected(rows: DataFrame, p: Parameters, bound: float | None = None) -> DataFrame:
    """The outliers: enough genomes, far enough apart, a score of the outlier threshold or more."""
    return beyond(counted(rows, p.count_threshold), p.ld_distance, bound).where(F.col("score") >= p.outlier_threshold)


def coverage(scores: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: vertices with a score, all vertices of the queries, percent."""
    return scores.agg(F.count("*").alias("covered")).join(F.broadcast(query_values(rows).select("n_vertices"))).withColumn("percent", F.when(F.col("n_vertices") > 0, 100.0 * F.col("covered") / F.col("n_vertices")))


def value_summary(rows: DataFrame, ld: int, count_threshold: int = 0, bound: float | None = None) -> DataFrame:
    """What coverage() and query_values() say together, of one pass over the rows: one row of covered, n_vertices, percent, largest_score, largest_vertex."""
    far = F.coalesce("distance", F.lit(-1.0 if bound is None else float(bound)))
    kept = (F.col("count") >= count_threshold) & (far >= ld) if count_threshold > 0 and "count" in rows.columns else far >= ld
    ends = rows.select(F.explode(F.array("v", "w")).alias("vertex"), "score", F.when(kept, F.col("score")).alias("counts"))
    each = ends.groupBy("vertex").agg(F.max("score").alias("score"), F.max("counts").alias("counts"))
    one = each.agg(F.count(F.when(F.col("counts") > 0, 1)).alias("covered"), F.count("vertex").alias("n_vertices"), F.greatest(F.lit(0.0), F.max("score")).alias("largest_score"), F.max("vertex").alias("largest_vertex"))
    percent = F.when(F.col("n_vertices") > 0, 100.0 * F.col("covered") / F.col("n_vertices")).alias("percent")
    return one.select("covered", "n_vertices", percent, "largest_score", "largest_vertex")


def plot_points(rows: DataFrame, count_threshold: int = 0) -> DataFrame:
    """Rows of enough genomes for a plot: distance, score, direct, connected."""
    d = fixed_distance(F.col("distance"))
    direct = F.col("flag") if "flag" in rows.columns else F.lit(False)
    return counted(rows, count_threshold).select("idx", "v", "w", d.alias("distance"), "score", direct.alias("direct"), (d >= 0).alias("connected"))


def plot_summary(points: DataFrame) -> DataFrame:
    """One row: rows and connected, disconnected, direct ones in thousands, score range, largest distance and its axis exponent."""
    k = lambda c: F.floor(F.count(F.when(c, 1)) / 1000).cast("long")
    far = F.max(F.when(F.col("connected"), F.col("distance")))
    one = points.agg(
        k(F.lit(True)).alias("rows_k"), k(F.col("connected")).alias("connected_k"), k(~F.col("connected")).alias("disconnected_k"), k(F.col("direct")).alias("direct_k"),
        F.min("score").alias("min_score"), F.max("score").alias("max_score"), far.alias("max_distance"),
    )
    return one.withColumn("exponent", F.when(F.col("max_distance") > 0, F.round(F.log10(F.when(F.col("max_distance") > 0, F.col("max_distance")))).cast("long") - 1))
