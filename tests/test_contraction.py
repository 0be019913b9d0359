"""Contraction by joins, against the plain form of one graph in memory."""

import random

from hopwise.operators import chains, graph
from tests.test_graph import rows


def links(spark, some):
    return graph.normalised(spark.createDataFrame([(g, a, b, float(w)) for g, a, b, w in some], "genome_id long, v long, w long, weight double"), "genome_id")


def test_the_way_along_a_chain_has_the_sign_of_its_weights(spark):
    """The unitig 4-5 is shorter than k, so the edge between its sides is below 0."""
    parts = chains.contracted(links(spark, [(0, 1, 4, 2), (0, 4, 5, -1), (0, 5, 2, 3)]))
    pairs = spark.createDataFrame([(0, 4, 5), (0, 5, 4)], "genome_id long, v long, w long")
    assert rows(chains.distances_on_chains(parts, pairs)) == [(0, 4, 5, -1.0), (0, 5, 4, -1.0)]


def test_contraction_by_joins_is_that_of_the_plain_form(spark):
    """Sparse graphs with long chains, chains that return to one node and loops of all lengths."""
    r = random.Random(1)
    some = [(g, a, a + 1, r.randrange(1, 9)) for g in range(2) for a in range(60) if r.random() < 0.93]
    some += [(g, r.randrange(61), r.randrange(61), r.randrange(1, 9)) for g in range(2) for _ in range(6)]
    for k, n in enumerate((3, 4, 7)):
        at = 100 * (k + 1)
        some += [(k % 2, at + i, at + (i + 1) % n, r.randrange(1, 9)) for i in range(n)]
    g = links(spark, some)
    parts = chains.contracted(g).cache()
    neighbours = {}
    for e in g.collect():
        neighbours.setdefault(e["genome_id"], {}).setdefault(e["src"], {})[e["dst"]] = e["weight"]
    plain = {k: chains.Contracted(n) for k, n in neighbours.items()}
    assert rows(chains.contracted_edges(parts)) == sorted((k, a, b, w) for k, c in plain.items() for a, e in c.graph.items() for b, w in e.items())
    places = []
    for k, c in plain.items():
        for node, (chain, to_start, to_end, _) in c.chain.items():
            (a, x), (b, y) = sorted([(c.ends[chain][0], to_start), (c.ends[chain][1], to_end)])
            places.append((k, node, a, b, x, y))
    assert rows(chains.chain_places(parts)) == sorted(places)
    together = {}
    for x in parts.where("chain is not null").collect():
        together.setdefault((x["genome_id"], x["chain"]), set()).add(x["node"])
    want = {}
    for k, c in plain.items():
        for node, (chain, *_) in c.chain.items():
            want.setdefault((k, chain), set()).add(node)
    assert sorted(map(sorted, together.values())) == sorted(map(sorted, want.values()))
    open_ones = chains.contracted(g, loops=False)
    assert open_ones.where("chain is not null").count() < len(places)  # SQL walks from nodes of another degree than 2
    assert "Pandas" not in open_ones._jdf.queryExecution().toString()
