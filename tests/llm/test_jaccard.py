"""The pipeline's near-duplicate stage against all pairs' Jaccard similarity of five-word shingles."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from hopwise.llm import jaccard
from tests.llm.conftest import COLUMNS


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_kept(rows):
    """Rows (doc_id, text) whose doc_id is the smallest of those connected at 0.8."""
    s, root = {i: shingles(t) for i, t, *_ in rows}, {i: i for i, *_ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(s), 2):
        if 5 * len(s[a] & s[b]) >= 4 * len(s[a] | s[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i for i in root if find(i) == i}


@pytest.fixture(scope="module")
def near():
    """Copies with one to eight words changed of texts of 12 to 400 words, a chain, a large group, and passages that many share."""
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    texts = []
    for n in (12, 30, 60, 61, 100, 150, 250, 400) * 3:
        w = [word() for _ in range(n)]
        texts.append(w)
        for changed in range(1, 9):
            c = list(w)
            for at in r.sample(range(n), changed):
                c[at] = word()
            texts.append(c)
    c = [word() for _ in range(300)]
    for _ in range(12):
        c = [*c[18:], *(word() for _ in range(18))]
        texts.append(c)
    w, shared = [word() for _ in range(150)], [word() for _ in range(40)]
    texts += [[*w[:i], word(), *w[i + 1 :]] for i in range(40)] + [[*(word() for _ in range(60)), *shared] for _ in range(40)]
    r.shuffle(texts)
    return [(i, " ".join(t), "en", "s", 0) for i, t in enumerate(texts)]


@pytest.mark.parametrize("slice_", [1024, 8])
def test_near_stage_finds_all_of_a_similarity_of_four_fifths(spark, near, slice_, monkeypatch):
    monkeypatch.setattr(jaccard, "SLICE", slice_)
    df = spark.createDataFrame(near, COLUMNS).repartition(4)
    assert {r["doc_id"] for r in corpus_pipeline.simhash_near_dedup(spark, df, "").collect()} == brute_kept(near)


def test_near_stage_on_the_corpus(spark, docs, rows):
    assert {r["doc_id"] for r in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()} == brute_kept([x for x in rows if (x[1] or "").split()]) | {min(x[0] for x in rows if not (x[1] or "").split())}


def test_similar_documents_of_odd_tables(odd, empty):
    out = jaccard.similar_documents(odd).collect()
    assert len(out) == 18 and all((r["component_id"] is None) <= (r["doc_id"] is None) for r in out)
    assert jaccard.without_similar(empty).count() == 0 and jaccard.without_similar(odd).columns == odd.columns


def test_shingle_sets_in_blocks():
    w = [b"%d" % (i % 57) for i in range(200)]
    assert all(jaccard.shingle_set(w, 5, n).tolist() == jaccard.shingle_set(w, 5).tolist() for n in (1, 3, 64)) and len(jaccard.shingle_set(w, 5)) == 57
    assert len(jaccard.shingle_set([], 5)) == 0 and len(jaccard.shingle_set(w[:3], 5)) == 1


def test_simhash_bands_alone_make_candidates(spark):
    """Of sets with all shingles in common those are linked whose fingerprints have a band alike, small ones too."""
    def linked(flipped):
        word = np.arange(jaccard.WORDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        bits = [word.tobytes(), (word ^ flipped).tobytes()]
        nodes = spark.createDataFrame([(i, 12, bytearray(b), []) for i, b in enumerate(bits)], "node long, size long, bits binary, few array<long>")
        sets = spark.createDataFrame([(i, bytearray(np.arange(12, dtype=np.uint32).tobytes())) for i in range(2)], "node long, shingles binary")
        return jaccard.similar_links(nodes, sets).distinct().count()

    assert linked(np.uint64(0x0001_0000_0001_0001)) == 1  # a band of each word is alike
    assert linked(np.uint64(0x0001_0001_0001_0001)) == 0  # none is
    assert linked(np.uint64(0x0000_FFFF_FFFF_FFFF)) == 0  # too many of the bits differ


def test_similar_sets_have_a_band_alike():
    r = np.random.default_rng(1)
    for common, one, other in [(16, 2, 2), (40, 5, 5), (160, 20, 20), (160, 0, 40)] * 50:
        h = r.integers(0, 1 << 63, common + one + other, dtype=np.uint64)
        a, b = (jaccard.set_fingerprint(x) for x in (h[: common + one], np.r_[h[:common], h[common + one :]]))
        assert (a.view(np.uint16) == b.view(np.uint16)).any() and np.bitwise_count(a ^ b).sum() <= jaccard.FAR_ALL


def test_sets_of_few_shingles_meet_without_one():
    h = np.arange(1, 10, dtype=np.uint64)
    assert all(set(jaccard.without_one(h[:n])) & set(jaccard.without_one(np.delete(h[:n], i))) for n in range(5, 10) for i in range(n))
    assert jaccard.without_one(h[:0]) == [] and jaccard.without_one(np.arange(10, dtype=np.uint64)) == []


def test_candidates_of_a_group_grow_with_its_rows():
    """Of a bucket of rows that are all near no more rows and links go out than it has, and cells hold each pair of a cluster once."""
    n, r = 300, np.random.default_rng(2)
    words = np.repeat(r.integers(0, 1 << 63, (1, jaccard.WORDS), dtype=np.uint64), n, axis=0)
    words[:, 20] = np.arange(n)
    node = np.arange(n)
    columns = {"group": node * 0, "node": node, "root": node, "seen": node, "size": node * 0 + 100}
    first = {"first": words[:, 0].view(np.int64), "second": words[:, 1].view(np.int64)}
    near = list(jaccard._promising(False)([pa.RecordBatch.from_pydict(columns | first)]))
    assert sum(b.num_rows for b in near) == n
    bits = [w[: jaccard.MORE].tobytes() for w in words]
    links = list(jaccard._clustered(False)([pa.RecordBatch.from_pydict(columns | {"bits": bits})]))
    assert sum(b.num_rows for b in links) == n - 1
    compared = list(jaccard._clustered(False)([pa.RecordBatch.from_pydict(columns | {"seen": node * 0, "bits": bits})]))
    assert sum(b.num_rows for b in compared) == 0


def test_cells_hold_each_pair_of_a_cluster_once(spark):
    rows = [(c, 1000 * c + i, 7 if i < main else 1000 * c + i, 0) for c, n, main in [(1, 300, 0), (2, 200, 150), (3, 5, 2)] for i in range(n)]
    cells = {}
    for x in jaccard.in_cells(spark.createDataFrame(rows, "cluster long, node long, root long, seen long")).collect():
        cells.setdefault(x["group"], []).append(x)
    met = [frozenset((a["node"], b["node"])) for c in cells.values() for a, b in combinations(c, 2) if a["root"] != b["root"] and (a["same"] or a["own"] != b["own"])]
    assert len(met) == len(set(met)) == 300 * 299 // 2 + 50 * 49 // 2 + 50 * 150 + 3 + 3 * 2
    assert max(map(len, cells.values())) < 300
