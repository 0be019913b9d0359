"""Golden cases of the formats, the distances and the genomes."""

import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from hopwise.operators import chains, distances, graph
from hopwise.operators import paths
from hopwise.operators.paths import frontier_paths, shortest_paths
from hopwise.plans.jobs import greedy_plan, oriented_jobs, plan_jobs
from hopwise.plans.options import Mode, Options, parse
from hopwise.plans.run import run
from hopwise.sources import readers
from hopwise.sources.writers import result_lines

F1 = ("0 1 2.0", "1 2 3.5", "2 3", "0 3 10", "3 3 1", "1 0 1.5", "4 5 FF", "6 7 0")
Q1 = ("0 3", "0 2", "4 5", "0 4", "1 1", "3 0", "6 7")
UNITIGS = ("u0 ACGTA", "u1 CGT", "u2 TTTTTTT", "u3 GGGG")
F2 = ("0 1 FF 2", "1 2 FR 2", "2 3 RF 2", "0 3 FF 0", "0 2 RR 2")
Q2 = ("0 1", "0 2", "0 3", "1 3", "1 1", "3 2")
NONE = "1.79769e+308"


def lines(path):
    import glob

    return [x for p in sorted(glob.glob(f"{path}/part-*")) for x in open(p).read().splitlines()]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(
    ("bound", "expected"),
    [
        (None, ["0 3 6 0 6 6", "0 2 5 0 5 5", "4 5 1 0 1 1", f"0 4 -1 0 {NONE} {NONE}", f"1 1 -1 0 {NONE} {NONE}", "3 0 6 0 6 6", f"6 7 0 0 {NONE} 0"]),
        (6.0, ["0 3 -1 0 6 6", "0 2 5 0 5 5", "4 5 1 0 1 1", "0 4 -1 0 6 6", f"1 1 -1 0 {NONE} {NONE}", "3 0 -1 0 6 6", f"6 7 0 0 {NONE} 0"]),
    ],
)
def test_general(spark, write, tmp_path, bound, expected):
    o = Options(edges=write("e", *F1), queries=write("q", *Q1), max_distance=bound, output=str(tmp_path / "out"))
    assert lines(run(spark, o)["distances"]) == expected


def test_two_sided_and_one_based(spark, write, tmp_path):
    expected = ["0 1 1 0 1 1", "0 2 1 0 1 1", "0 3 6 0 6 6", "1 3 6 0 6 6", f"1 1 -1 0 {NONE} {NONE}", "3 2 1 0 1 1"]
    o = Options(edges=write("e", *F2), unitigs=write("u", *UNITIGS), k=3, queries=write("q", *Q2), output=str(tmp_path / "out"))
    assert lines(run(spark, o)["distances"]) == expected
    up = lambda x: " ".join([str(int(t) + 1) if i < 2 else t for i, t in enumerate(x.split())])
    one = parse(["-E", write("e1", *map(up, F2)), "-U", o.unitigs, "-k", "3", "-Q", write("q1", *map(up, Q2)), "-1", "-o", str(tmp_path / "one")])
    assert lines(run(spark, one)["distances"]) == [up(x) for x in expected]


def test_the_log_of_a_run(spark, write, tmp_path, caplog):
    from hopwise.plans.log import duration, grouped, ratio

    assert [grouped(n) for n in (0, 999, 1000, 1234567)] == ["0", "999", "1 000", "1 234 567"] and ratio(7, 3) == "2.33" and ratio(1, 50) == "0.02"
    assert [duration(s) for s in (0.5, 61, 3600, 90000, 59.9996)] == ["0.500s", "1m 1s", "1h 0m", "1d 1h", "59.999s"]
    files = {"edges": write("e", *F2), "unitigs": write("u", *UNITIGS), "queries": write("q", *Q2), "genomes": write("g", write("g0", *F2)), "k": 3}
    with caplog.at_level("INFO", "hopwise"):
        run(spark, Options(**files, output=str(tmp_path / "quiet")))
        assert not caplog.records
        run(spark, Options(**files, output=str(tmp_path / "loud"), verbose=True))
    text = caplog.text
    for said in ("read 6 queries", "planned searches from", "built the graph", "contracted 1 genomes", "wrote distances over 1 genomes", "wrote distances in the whole graph"):
        assert said in text, said


def test_genomes(spark, write, tmp_path):
    a, b, c = write("a", *F2[:3]), write("b", F2[4], F2[2]), write("c", F2[0])
    o = Options(edges=write("e", *F2), unitigs=write("u", *UNITIGS), k=3, genomes=write("g", a, b, c), genomes_only=True, queries=write("q", *Q2), output=str(tmp_path / "out"))
    files = run(spark, o)
    assert "distances" not in files
    assert lines(files["genome_distances"]) == ["0 1 1 2 0 1 1", "0 2 1 2 0.5 1 2", "0 3 6 2 0.5 6 7", "1 3 6 1 0 6 6", "1 1 -1 0 -1 -1 -1", "3 2 1 2 0 1 1"]


def test_a_genome_listed_twice_counts_twice(spark, write, tmp_path):
    a = write("a", *F2[:3])
    o = Options(edges=write("e", *F2), unitigs=write("u", *UNITIGS), k=3, genomes=write("g", a, a), genomes_only=True, queries=write("q", "0 1"), output=str(tmp_path / "out"))
    assert lines(run(spark, o)["genome_distances"]) == ["0 1 1 2 0 1 1"]


@pytest.mark.parametrize(
    ("files", "error"),
    [
        ({"e": ("0",), "q": ("0 1",)}, readers.FormatError),
        ({"e": ("0 1", "", "1 2"), "q": ("0 1",)}, readers.FormatError),
        ({"e": ("0 1 -2",), "q": ("0 1",)}, readers.FormatError),
        ({"e": ("0 1",), "q": ("0 1 2 3 4 5 6",)}, readers.FormatError),
        ({"e": ("0 1",), "q": ("0 1", "", "0 1")}, readers.FormatError),
        ({"e": ("0 1 FF",), "q": ("0 1",), "u": ("u0 AC", "u1 ACGT")}, readers.FormatError),
        ({"e": ("0 9 FF",), "q": ("0 1",), "u": ("u0 ACGT", "u1 ACGT")}, readers.FormatError),
        ({"e": ("0 1 FF",), "q": ("0 1",), "u": ("u0 ACGT", "u1 ACGT"), "g": ("",)}, readers.FormatError),
        ({"e": ("0 1 FF",), "q": ("0 1",), "u": ("u0 ACGT", "u1 ACGT"), "g": ("/no/such/file",)}, FileNotFoundError),
    ],
)
def test_bad_files(spark, write, tmp_path, files, error):
    p = {k: write(k, *v) for k, v in files.items()}
    o = Options(edges=p["e"], queries=p["q"], unitigs=p.get("u"), k=3 * ("u" in p), genomes=p.get("g"), output=str(tmp_path / "out"))
    with pytest.raises(error):
        run(spark, o)


def test_a_genome_of_dropped_links_is_refused(spark, write, tmp_path):
    o = Options(edges=write("e", *F2), unitigs=write("u", *UNITIGS), k=3, genomes=write("g", write("a", "0 1 FF 0")), queries=write("q", "0 1"), output=str(tmp_path / "out"))
    with pytest.raises(readers.FormatError):
        run(spark, o)


@pytest.mark.parametrize("bad", [dict(), dict(queries="q"), dict(queries="q", edges="e", unitigs="u"), dict(queries="q", edges="e", queries_format=6), dict(queries="q", outliers=True, queries_format=3), dict(queries="q", edges="e", partitions=0)])
def test_bad_options(bad):
    with pytest.raises(ValueError):
        Options(**bad).check()


def test_modes_and_names():
    assert Options(queries="q", outliers=True).mode == Mode.OUTLIERS
    assert Options(edges="e", genomes="g").mode == Mode.GENERAL
    assert Options(edges="e", unitigs="u", genomes="g", outliers=True).mode == Mode.CDBG | Mode.GENOMES | Mode.OUTLIERS
    o = Options(output="x", output_one_based=True)
    assert [o.path(), o.path(True), o.path(False, True), o.path(True, True)] == ["x.ud_1_based", "x.ud_sgg_1_based", "x.ud_outliers_1_based", "x.ud_sgg_outliers_1_based"]
    assert parse(["-Q", "q", "-E", "e", "-l", "-1"]).ld_distance is None


@pytest.mark.parametrize(("line", "alone", "fmt"), [("1 2", False, 0), ("1 2 .5", False, 1), ("1 2 3 .5", False, 2), ("1 2 3 1 .5", False, 3), ("1 2 3 .5 4", True, 4), ("1 2 3 1 .5 4", False, 5), ("1", False, None), ("1 2 3 4 5 6 7", True, None)])
def test_format_is_told_from_the_fields(line, alone, fmt):
    assert readers.deduce_format(line, alone) == fmt


def test_queries_keep_file_order_and_limit(spark, write):
    p = write("q", *[f"{i} {i + 1} 7.9 1 0.5 12" for i in range(50)])
    q = readers.read_queries(spark, p, n=20)
    assert q.columns == ["idx", "v", "w", "flag", "score"] and sorted(r["idx"] for r in q.collect()) == list(range(20))
    alone = readers.read_queries(spark, p, outliers_only=True).orderBy("idx").first()
    assert (alone["distance"], alone["count"], alone["flag"]) == (7.0, 12, True)


def test_repeated_spaces_are_empty_fields(spark, write):
    with pytest.raises(readers.FormatError):
        readers.read_general_edges(spark, write("e", "0  1"))
    assert rows(readers.read_general_edges(spark, write("f", "0 1 "))) == [(0, 1, 1.0)]


def dijkstra(edges, source, two_sided):
    starts = [2 * source, 2 * source + 1] if two_sided else [source]
    best = dict.fromkeys(starts, 0.0)
    for _ in range(len(edges) + 1):
        for a, b, w in edges:
            if a in best and best[a] + w < best.get(b, math.inf):
                best[b] = best[a] + w
    out = {}
    for n, d in best.items():
        k = n >> 1 if two_sided else n
        out[k] = min(d, out.get(k, math.inf))
    return out


@pytest.mark.parametrize("two_sided", [False, True])
def test_strategies_agree_with_brute_force(spark, two_sided):
    r = random.Random(5)
    edges = [(r.randrange(24), r.randrange(24), float(r.randrange(1, 9))) for _ in range(40)]
    g = graph.normalised(spark.createDataFrame(edges, "v long, w long, weight double"))
    both = [(e["src"], e["dst"], e["weight"]) for e in g.collect()]
    n = 12 if two_sided else 24
    q = [(i, r.randrange(n), r.randrange(n + 2)) for i in range(60)]
    jobs = plan_jobs(spark.createDataFrame(q, "idx long, v long, w long"))
    for bound in (None, 7.0):
        expected = {}
        for i, v, w in q:
            d = dijkstra(both, v, two_sided).get(w)
            if d is not None and v != w and (bound is None or d < bound):
                expected[i] = d
        for strategy in ("broadcast", "frontier"):
            assert {x["idx"]: x["distance"] for x in shortest_paths(g, jobs, bound, two_sided, strategy).collect()} == expected


def test_planning_variants_cover_each_pair_once(spark):
    r = random.Random(1)
    q = [(i, r.randrange(9), r.randrange(9)) for i in range(80)]
    df = spark.createDataFrame(q, "idx long, v long, w long")
    want = {(i, frozenset((v, w))) for i, v, w in q if v != w}
    for jobs in (oriented_jobs(df).select("source", "target", "idx").collect(), greedy_plan(q)):
        assert len(jobs) == len(want) and {(j[2], frozenset(j[:2])) for j in jobs} == want
    assert greedy_plan([(0, 1, 2), (1, 1, 3), (2, 4, 4)]) == [(1, 2, 0), (1, 3, 1)]


@settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.lists(st.tuples(st.integers(0, 11), st.integers(0, 11), st.integers(1, 5)), min_size=1, max_size=22))
def test_contraction_keeps_distances(raw):
    n = {}
    for a, b, w in raw:
        if a != b:
            for x, y in ((a, b), (b, a)):
                n.setdefault(x, {})[y] = min(w, n.get(x, {}).get(y, w))
    c = chains.Contracted(n)
    flat = lambda g: [(a, b, float(w)) for a, e in g.items() for b, w in e.items()]
    for s in c.kept:
        full, short = dijkstra(flat(n), s, False), dijkstra(flat(c.graph), s, False)
        assert all(short.get(t, math.inf if t != s else 0) == full.get(t, math.inf) for t in c.kept)
        for node, (chain, to_start, to_end, _) in c.chain.items():
            a, b, length = c.ends[chain]
            assert to_start + to_end == length
            assert min(short.get(a, math.inf) + to_start, short.get(b, math.inf) + to_end) == full.get(node, math.inf)


@settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.lists(st.tuples(st.integers(0, 11), st.integers(0, 11), st.integers(1, 5)), min_size=1, max_size=18), st.sampled_from([None, 4.0, 9.0]))
def test_search_on_chains_is_that_of_the_whole_graph(raw, bound):
    n = {}
    for a, b, w in [*raw, *((2 * u, 2 * u + 1, 3) for u in range(6))]:
        if a != b:
            for x, y in ((a, b), (b, a)):
                n.setdefault(x, {})[y] = min(w, n.get(x, {}).get(y, w))
    c = chains.Contracted(n)
    flat = [(a, b, float(w)) for a, e in n.items() for b, w in e.items()]
    places = {node: (k, *c.ends[k][:2], to_first, to_last) for node, (k, to_first, to_last, _) in c.chain.items()}
    search = chains.ChainSearch([(a, b, w) for a, e in c.graph.items() for b, w in e.items()], places)
    for v in range(6):
        full = dijkstra(flat, v, True)
        want = {t: d for t, d in full.items() if t != v and (bound is None or d < bound)}
        assert search.distances(v, [t for t in range(6) if t != v], bound) == want


def test_chain_tables(spark):
    """A chain 1-4-5-6-2 between nodes of three neighbours, and a closed loop 20-21-22."""
    links = [(1, 2, 9), (1, 3, 1), (2, 3, 1), (1, 4, 2), (4, 5, 3), (5, 6, 4), (6, 2, 5), (20, 21, 1), (21, 22, 2), (22, 20, 4)]
    g = graph.normalised(spark.createDataFrame([(0, a, b, float(w)) for a, b, w in links], "genome_id long, v long, w long, weight double"), "genome_id")
    parts = chains.contracted(g).cache()
    assert rows(chains.contracted_edges(parts).where("src < dst")) == [(0, 1, 2, 2.0)]  # 1-3-2 is the shortest of three ways
    assert [r[1:] for r in rows(chains.chain_places(parts))] == [(3, 1, 2, 1.0, 1.0), (4, 1, 2, 2.0, 12.0), (5, 1, 2, 5.0, 9.0), (6, 1, 2, 9.0, 5.0), (21, 20, 20, 1.0, 6.0), (22, 20, 20, 3.0, 4.0)]
    pairs = spark.createDataFrame([(0, 4, 6), (0, 3, 6), (0, 22, 21)], "genome_id long, v long, w long")
    assert rows(chains.distances_on_chains(parts, pairs)) == [(0, 4, 6, 7.0), (0, 22, 21, 2.0)]


def test_a_large_graph_is_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(paths, "BROADCAST_EDGES", 3)
    g = graph.normalised(spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0)], "v long, w long, weight double"))
    jobs = spark.createDataFrame([(0, 2, 0)], "source long, target long, idx long")
    with pytest.raises(ValueError, match="broadcast"):
        shortest_paths(g, jobs, strategy="broadcast").count()
    assert rows(shortest_paths(g, jobs, broadcast_edges=3)) == [(0, 2.0)]


def test_general_merge_of_summaries_and_genome_tasks(spark, monkeypatch):
    from hopwise.streaming.genomes import merged_summaries

    pairs = spark.createDataFrame([(0, float(d)) for d in (3, 5, 11, 4)] + [(1, 2.0)], "idx long, distance double")
    whole = distances.summarised(pairs)
    parts = merged_summaries(distances.summarised(pairs.where("distance > 4")), distances.summarised(pairs.where("distance <= 4")))
    a, b = ({r["idx"]: r for r in x.collect()} for x in (whole, parts))
    assert a.keys() == b.keys()
    for i in a:
        for c in ("distance", "count", "m2", "min_distance", "max_distance"):
            assert a[i][c] == pytest.approx(b[i][c])
    assert a[0]["m2"] == pytest.approx(38.75)


def test_frontier_takes_a_graph_with_no_edges(spark):
    g = spark.createDataFrame([], "src long, dst long, weight double")
    jobs = spark.createDataFrame([(0, 1, 0)], "source long, target long, idx long")
    assert frontier_paths(g, jobs, None, False).count() == 0


def test_graph_helpers(spark):
    g = graph.normalised(spark.createDataFrame([(0, 1, 2.0), (1, 2, 3.0), (2, 2, 1.0)], "v long, w long, weight double"))
    nodes = spark.createDataFrame([(0,), (7,)], "node long")
    assert rows(graph.contains(g, nodes)) == [(0, True), (7, False)]
    assert rows(graph.has_edges(g, spark.createDataFrame([(1, 2), (0, 2)], "v long, w long"))) == [(0, 2, None), (1, 2, 3.0)]
    assert rows(graph.without_edges(g, spark.createDataFrame([(1, 0)], "v long, w long"))) == [(1, 2, 3.0), (2, 1, 3.0)]
    assert rows(graph.without_nodes(g, nodes)) == [(1, 2, 3.0), (2, 1, 3.0)]
    assert rows(graph.with_edges(g, spark.createDataFrame([(2, 1, 1.0), (5, 0, 4.0), (3, 3, 1.0)], "v long, w long, weight double")).where("src < dst")) == [(0, 1, 2.0), (0, 5, 4.0), (1, 2, 1.0)]
    assert tuple(graph.profile(g, False).first()) == (3, 2, pytest.approx(4 / 3), 2)


def test_numbers_are_printed_with_six_digits(spark):
    from pyspark.sql import functions as F

    from hopwise.functions.expressions import printed

    v = [0.0, 1.0, -1.0, 100.0, 0.5, 34.666666, 123456.0, 1234567.0, 0.0001, 0.00001234, 1e-300, 999999.5, 1.7976931348623157e308, -2.5, 1e20]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, x double").orderBy("i").select(printed(F.col("x"))).collect()]
    assert got == ["%g" % x for x in v]
    assert result_lines(spark.createDataFrame([(0, 0, 1, 2.7, 0.123456789)], "idx long, v long, w long, distance double, score double")).first()["line"] == "0 1 2 0.123457 0 2.7 2.7"
