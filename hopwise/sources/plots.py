"""A picture of scores over distances: the points counted in cells by Spark, the cells drawn as SVG."""

from __future__ import annotations

from dataclasses import dataclass
from math import floor, log10
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopwise.operators.outliers import plot_summary

#: Cells of a picture each way; so what is drawn, and sent to the driver, is bounded whatever the number of points.
COLUMNS, ROWS = 480, 270
#: Pixels of a cell, and of the margins.
CELL, MARGIN = 4, 70

# The colours of the plot.
INDIRECT, DIRECT, LINE, OTHER_LINE = "rgb(192,192,192)", "rgb(0,115,190)", "red", "hotpink"


@dataclass(frozen=True)
class Marks:
    """Lines of a plot; 0 for none."""

    ld_distance: float = 0
    outlier: float = 0
    extreme: float = 0

    def lines(self) -> list[tuple[str, float, str]]:
        return [x for x in (("x", self.ld_distance, ""), ("y", self.outlier, "*"), ("y", self.extreme, "**")) if x[1] > 0]


def plot_cells(points: DataFrame, columns: int = COLUMNS, rows: int = ROWS) -> DataFrame:
    """col, row, direct, n: how many connected points fall into each cell, from distance 0 and the least score up."""
    there = points.where("connected")
    ends = there.agg(F.max("distance").alias("far"), F.min("score").alias("low"), F.max("score").alias("high"))  # one row
    cell = lambda at, size, n: F.when(size > 0, F.least(F.floor(at / size * n), F.lit(n - 1))).otherwise(F.lit(0)).cast("int")
    at = there.join(F.broadcast(ends)).select(
        cell(F.col("distance"), F.col("far"), columns).alias("col"), cell(F.col("score") - F.col("low"), F.col("high") - F.col("low"), rows).alias("row"), "direct"
    )
    return at.groupBy("col", "row", "direct").agg(F.count("*").alias("n"))


def plot_svg(points: DataFrame, title: str = "", score_name: str = "Score", marks: Marks = Marks(), other: Marks = Marks(), below_count: int = 0) -> str:
    """The picture. Indirect points first, direct ones over them; below_count: rows that a count threshold has left out, for the legend."""
    s = plot_summary(points).first()
    width, height = COLUMNS * CELL, ROWS * CELL
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width + 2 * MARGIN}" height="{height + 2 * MARGIN}" font-family="sans-serif" font-size="16">', f'<rect width="100%" height="100%" fill="white"/><g transform="translate({MARGIN},{MARGIN})">']
    if s["max_distance"] is not None:
        far, low, high = s["max_distance"] or 1.0, s["min_score"], s["max_score"]
        x = lambda d: width * d / far
        y = lambda v: height - (height * (v - low) / (high - low) if high > low else 0)
        cells = sorted((r["direct"], r["col"], r["row"]) for r in plot_cells(points).collect())  # 2 * COLUMNS * ROWS at most
        out += [f'<rect x="{c * CELL}" y="{height - (r + 1) * CELL}" width="{CELL}" height="{CELL}" fill="{DIRECT if direct else INDIRECT}"/>' for direct, c, r in cells]
        for some, colour in ((marks, LINE), (other, OTHER_LINE)):
            for axis, at, sign in some.lines():
                ends = (x(at), 0, x(at), height) if axis == "x" else (0, y(at), width, y(at))
                out.append('<line x1="{:.1f}" y1="{:.1f}" x2="{:.1f}" y2="{:.1f}" stroke="{}" stroke-dasharray="8 6"/>'.format(*ends, colour))
                out += [f'<text x="-14" y="{y(at):.1f}" fill="{colour}">{sign}</text>'] * bool(sign)
        exponent = s["exponent"] if s["exponent"] is not None else 0
        for i in range(floor(far / 10.0**exponent) + 1):
            out.append(f'<text x="{x(i * 10.0**exponent):.1f}" y="{height + 24}" text-anchor="middle">{i}</text>')
        step = 10.0 ** floor(log10(high - low)) if high > low else 1.0
        for i in range(floor(low / step), floor(high / step) + 1):
            if low <= i * step <= high:
                out.append(f'<text x="-20" y="{y(i * step):.1f}" text-anchor="end">{i * step:g}</text>')
        out.append(f'<text x="{width}" y="{height + 50}" text-anchor="end">x10^{exponent}</text>')
        said = [f"#Connected: {s['connected_k']}K", f"#Disconnected: {s['disconnected_k']}K"] + [f"#Filtered: {below_count // 1000}K"] * bool(below_count)
        for i, (text, colour) in enumerate([("Indirect", INDIRECT), ("Direct", DIRECT), *((t, "black") for t in said)]):
            out.append(f'<text x="{0.9 * width:.0f}" y="{40 + 22 * i}" fill="{colour}">{text}</text>')
    out.append(f'<text x="{width // 2}" y="{height + 50}" text-anchor="middle">Distance</text><text x="{width // 2}" y="-20" text-anchor="middle">{escape(title)}</text>')
    out.append(f'<text transform="translate(-50,{height // 2}) rotate(-90)" text-anchor="middle">{escape(score_name)}</text></g></svg>')
    return "\n".join(out)


def write_plot(points: DataFrame, path: str, **how) -> None:
    """The picture as a text of one part."""
    svg = plot_svg(points, **how)
    points.sparkSession.createDataFrame([(svg,)], "value string").coalesce(1).write.mode("overwrite").text(path)
