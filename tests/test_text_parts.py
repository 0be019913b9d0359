"""Text files in many parts: written so, and read in the order of their names."""

import glob

from pyspark.sql import functions as F

from hopwise import queries
from hopwise.sources import readers
from tests.test_graph import rows


def folder(tmp_path, name, *parts):
    """The largest part last, as Spark reads the largest first."""
    (tmp_path / name).mkdir()
    for i, lines in enumerate(parts):
        (tmp_path / name / f"part-{i:05d}").write_text("".join(f"{x}\n" for x in lines))
    return str(tmp_path / name)


def test_lines_are_numbered_in_the_order_of_the_parts(spark, tmp_path):
    text = [f"{i} {i + 1} 5 {i % 7} {i % 50}" for i in range(400)]
    p = folder(tmp_path, "q", text[:1], [], text[1:30], text[30:])
    q = readers.read_queries(spark, p, outliers_only=True)
    assert rows(q.select("idx", "v", "count")) == [(i, i, i % 50) for i in range(400)]
    c = folder(tmp_path, "c", [str(i) for i in range(25)], [str(i) for i in range(25, 400)])
    assert rows(readers.read_plot_rows(spark, p, c, 40).select("idx", "count")) == [(i, i) for i in range(40)]
    assert "count" not in readers.read_plot_rows(spark, p, folder(tmp_path, "few", ["1"] * 39), 40).columns


def test_the_format_is_told_from_the_first_part(spark, tmp_path):
    p = folder(tmp_path, "q", ["0 1"], ["1 2 0.5 9"] * 50)
    assert readers.read_queries(spark, p).columns == ["idx", "v", "w"]


def test_blocks_of_one_file_are_numbered(spark, write):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        p = write("q", *[f"{i} {i + 1}" for i in range(500)])
        assert rows(readers.read_queries(spark, p).select("idx", "v")) == [(i, i) for i in range(500)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_sorted_text_is_not_gathered_in_one_part(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        lines = spark.range(1000).select("id", F.col("id").cast("string").alias("line"))
        p = queries._file(spark, lines.repartition(7), "id")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted(glob.glob(f"{p}/part-*".removeprefix("file:")))
    assert len(parts) > 1
    assert [x for n in parts for x in open(n).read().split()] == [str(i) for i in range(1000)]
    assert rows(readers.numbered_lines(spark, p).select("idx", F.col("f")[0].cast("long"))) == [(i, i) for i in range(1000)]


def test_a_folder_of_links_is_a_genome(spark, tmp_path, write):
    a = folder(tmp_path, "a", ["0 1 FF 2"], ["1 2 FR 2"])
    b = write("b", "2 3 RF 2")
    got = rows(readers.read_genome_edges(spark, [a, b, a]).select("genome_id", "v", "w"))
    assert got == [(0, 0, 1), (0, 1, 2), (1, 2, 3), (2, 0, 1), (2, 1, 2)]
