"""The corpus pipeline against brute force, stage by stage, and the registry."""

import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from hopwise.llm import bpe, quality, repeats
from tests.llm.test_jaccard import brute_kept
from tests.llm.test_operators import brute_base


def brute_stages(rows, model):
    """(doc_id, text) after each stage but the last."""
    text = {i: t for i, t, *_ in rows}
    stages = []
    text = {i: t for i, t in text.items() if not brute_base(t)[-1] and quality._ruled((t or "").encode(), model, quality.KEEP_AT)[-1]}
    stages.append(text)
    best = {}
    for i, t in text.items():
        k = re.sub(r"[\x20\x09-\x0D]", "", t)
        best[k] = min(best.get(k, (1, 0)), (-len(t), i))
    text = {i: text[i] for _, i in best.values()}
    stages.append(text)
    kept = brute_kept([(i, t) for i, t in text.items()])
    text = {i: t for i, t in text.items() if i in kept}
    stages.append(text)
    raw = {i: t.encode() for i, t in text.items()}
    count = Counter(t[i : i + 200] for t in raw.values() for i in range(len(t) - 199))
    out = {}
    for i, t in raw.items():
        step = np.zeros(len(t) + 1, int)
        for j in range(len(t) - 199):
            if count[t[j : j + 200]] > 1:
                step[j] += 1
                step[j + 200] -= 1
        edge = np.flatnonzero(np.diff(np.r_[0, (np.cumsum(step) > 0).astype(int), 0]))
        out[i] = repeats.without(t, repeats.whole_characters(t, list(zip(edge[::2], edge[1::2], strict=True)))).decode()
    stages.append(out)
    return stages


@pytest.fixture(scope="module")
def folder(spark, docs, labels, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{d}/documents.parquet")
    labels.write.parquet(f"{d}/labels.parquet")
    return d


def test_stages_and_run(spark, folder, rows):
    model = quality.fit_ngram_model(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    want = brute_stages(rows, model)
    sizes = [len(rows), *map(len, want)]
    assert all(a > b for a, b in zip(sizes[:4], sizes[1:4], strict=False)) and want[3] != want[2]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for (name, stage), expected in zip(corpus_pipeline.STAGES, want, strict=False):
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        got = {r["doc_id"]: r for r in docs.collect()}
        assert {i: r["text"] for i, r in got.items()} == expected, name
        if name == "suffix_array_dedup":
            assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    t = Tokenizer.from_file(bpe.TOKENIZER)
    ids = {i: [*t.encode(x, add_special_tokens=False).ids, 1] for i, x in want[3].items()}
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in pieces} == set(ids) and sum(r["length"] for r in pieces) == sum(map(len, ids.values()))
    for r in pieces:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(struct.pack(f"<{len(part)}I", *part)) == r["ids_crc32"]


def test_stages_take_odd_tables(spark, folder, odd, empty):
    for df in (odd, empty):
        docs = df
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, folder)
            assert docs.columns == df.columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() >= 0


def test_registry():
    q = entry.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in q) == 1
    assert q["pipeline"] is corpus_pipeline.run and set(entry.oracle_sql()) <= set(q)
