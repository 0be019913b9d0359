"""Golden cases of the outlier tools."""

import pytest

from hopwise.operators import outliers as O
from hopwise.plans.options import Options
from hopwise.plans.run import run
from tests.test_graph import lines

F4 = ["0 1 500 .90 12", "0 2 1500 .30 12", "1 3 2500 .35 12", "2 4 3000 .40 12", "3 5 4000 .32 12", "4 6 5000 .28 12", "5 7 6000 .95 12", "6 8 -1 .99 12", "7 9 7000 .31 3", "8 9 8000 .33 12"]
F4B = [x if not x.startswith("7 9") else "7 9 7000 .70 3" for x in F4]


def frame(spark, text):
    parts = [x.split() for x in text]
    return spark.createDataFrame([(i, int(v), int(w), None if d == "-1" else float(d), float(s), int(c)) for i, (v, w, d, s, c) in enumerate(parts)], "idx long, v long, w long, distance double, score double, count long")


@pytest.mark.parametrize(
    ("text", "options", "expected", "found"),
    [
        (F4, dict(ld=1000), (0.33, 0.40, 0.505, 0.61, 1000), [(5, 7)]),
        (F4, dict(ld=1000, count_threshold=10), (0.33, 0.40, 0.505, 0.61, 1000), [(5, 7)]),
        (F4, dict(), (0.33, 0.40, 0.505, 0.61, 1001), [(5, 7)]),
        (F4, dict(nth=1), (0.33, 0.95, 1.88, 2.81, 6000), []),
        (F4, dict(nth=2), (0.33, 0.40, 0.505, 0.61, 1001), [(5, 7)]),
        (F4B, dict(ld=1000), (0.33, 0.70, 1.255, 1.81, 1000), []),
        (F4B, dict(ld=1000, count_threshold=10), (0.33, 0.40, 0.505, 0.61, 1000), [(5, 7)]),
    ],
)
def test_parameters(spark, text, options, expected, found):
    rows = frame(spark, text)
    p = O.parameters(rows, **options)
    assert (p.q1, p.q3, p.outlier_threshold, p.extreme_threshold, p.ld_distance) == pytest.approx(expected)
    assert [(r["v"], r["w"]) for r in O.collected(rows, p).collect()] == found
    if "ld" not in options:
        assert p.probes == (13 if options.get("nth") == 1 else 12)


def test_nothing_to_search_makes_every_row_an_outlier(spark):
    rows = frame(spark, ["0 1 -1 .5 12", "1 2 -1 .2 12"])
    p = O.parameters(rows)
    assert p.ld_distance == -1 and O.collected(rows, p).count() == 2
    assert O.collected(rows, O.parameters(rows, threshold=0.3)).count() == 1


def test_a_given_threshold_is_overruled_by_the_search(spark):
    assert O.parameters(frame(spark, F4), threshold=0.1).outlier_threshold == pytest.approx(0.505)
    p = O.parameters(frame(spark, F4), ld=1000, threshold=0.35)
    assert (p.outlier_threshold, p.extreme_threshold) == (0.35, 0.35)


def test_no_scores_keep_the_thresholds_before(spark):
    rows = frame(spark, F4)
    p = O.calculated(rows, 1000, O.Parameters(), 10)
    q = O.calculated(rows, 100_000, p, 10)
    assert (q.max_score, q.outlier_threshold, q.ld_distance) == (0.0, p.outlier_threshold, 100_000)


def test_quartile_places_are_not_interpolated():
    assert O.quartile_places(4, 10) == (1, 3, 0)
    assert O.quartile_places(1, 0) == (0, 0, 0)
    assert O.quartile_places(12, 10) == (3, 9, 1)


def test_outliers_alone_and_files(spark, write, tmp_path):
    o = Options(queries=write("q", *F4), outliers=True, ld_distance=1000, output=str(tmp_path / "out"))
    files = run(spark, o)
    assert lines(files["outliers"]) == ["5 7 6000 0.95 12 0 6000 6000"]
    assert lines(files["stats"]) == ["1000 0.505 0.61 10"]
    none = Options(queries=o.queries, outliers=True, ld_nth=1, output=str(tmp_path / "none"))
    assert run(spark, none) == {}


def test_compatible_threshold_needs_genomes(spark, write, tmp_path):
    o = Options(queries=write("q", *F4B), outliers=True, ld_distance=1000, output=str(tmp_path / "out"))
    assert o.counted == 10 and Options(queries="q", outliers=True, compat=True).counted == 0
    assert lines(run(spark, o)["outliers"]) == ["5 7 6000 0.95 12 0 6000 6000"]


def test_rows_without_a_distance_count_as_far_on_request(spark):
    rows = frame(spark, F4)
    assert O.collected(rows, O.Parameters(5000, 0.9, 0.9), 5000.0).count() == 2
    assert O.collected(rows, O.Parameters(5000, 0.9, 0.9)).count() == 1


def test_plot_frames(spark):
    p = O.plot_points(frame(spark, F4), 10)
    assert p.count() == 9 and p.where("not connected").count() == 1
    one = O.plot_summary(p).first()
    assert (one["rows_k"], one["max_distance"], one["exponent"]) == (0, 8000.0, 3)


def test_coverage_and_values(spark):
    rows = frame(spark, F4)
    one = O.coverage(O.vertex_scores(rows, 1000), rows).first()
    assert (one["covered"], one["n_vertices"]) == (10, 10)
    assert tuple(O.query_values(rows).first()) == (0.99, 10, 9)


def test_plot_rows_and_their_counts(spark, write):
    from hopwise.sources.readers import read_plot_rows

    p = write("r", "0 1 1500 1 0.5", "1 2 -1 0 0.7", "2 3 9 0 0.1")
    full = read_plot_rows(spark, p, write("c", "3", "20", "30"))
    assert sorted(tuple(r) for r in O.plot_points(full, 10).select("idx", "distance", "direct", "connected").collect()) == [(1, -1.0, False, False), (2, 9.0, False, True)]
    assert "count" not in read_plot_rows(spark, p, write("d", "3")).columns
    assert read_plot_rows(spark, p, n=2).count() == 2


def test_plot_is_drawn(spark, tmp_path):
    import xml.etree.ElementTree as ET

    from hopwise.sources.plots import Marks, plot_cells, plot_svg, write_plot

    rows = [(0, 1, 2, 0.0, 0.1, False), (1, 1, 3, 1000.0, 0.9, True), (2, 2, 3, 500.0, 0.5, False), (3, 2, 4, None, 0.7, False), (4, 2, 5, 500.0, 0.5, False)]
    points = O.plot_points(spark.createDataFrame(rows, "idx long, v long, w long, distance double, score double, flag boolean"))
    assert sorted(tuple(r) for r in plot_cells(points, 10, 10).collect()) == [(0, 0, False, 1), (5, 5, False, 2), (9, 9, True, 1)]
    svg = plot_svg(points, "a < b", "Score", Marks(200, 0.6, 0.8), Marks(outlier=0.3))
    root = ET.fromstring(svg)
    kinds = [e.tag.split("}")[1] for e in root.iter()]
    assert kinds.count("line") == 4 and kinds.count("rect") == 1 + 3 and "a &lt; b" in svg and "#Disconnected: 0K" in svg
    ET.fromstring(plot_svg(points.where("false")))
    write_plot(points, str(tmp_path / "plot"))
    assert "".join(open(p).read() for p in (tmp_path / "plot").glob("part-*")).startswith("<svg")
