"""How often rows are computed for what is settled of them."""

from hopwise.operators import outliers as O
from tests.test_outliers import F4, frame


def seen(spark, rows):
    """The rows, and a count of how many were computed."""
    n = spark.sparkContext.accumulator(0)

    def run(frames):
        for f in frames:
            n.add(len(f))
            yield f

    return rows.mapInPandas(run, rows.schema), n


def test_the_automatic_distance_computes_rows_once(spark):
    rows, n = seen(spark, frame(spark, F4))
    p = O.parameters(rows, count_threshold=10)
    assert n.value == len(F4)  # five times before
    assert p == O.parameters(frame(spark, F4).cache(), count_threshold=10) and p.ld_distance == 1001


def test_the_summary_computes_rows_once(spark):
    rows, n = seen(spark, frame(spark, F4))
    one = O.value_summary(rows, 1000, 10).first()
    assert n.value == len(F4)
    scores, plain = O.vertex_scores(frame(spark, F4), 1000, 10), frame(spark, F4)
    c, v = O.coverage(scores, plain).first(), O.query_values(plain).first()
    assert one.asDict() == c.asDict() | v.asDict() and one["covered"] == 10
    none = O.value_summary(frame(spark, F4).where("false"), 1000).first()
    assert (none["covered"], none["n_vertices"], none["percent"], none["largest_vertex"]) == (0, 0, None, None)
