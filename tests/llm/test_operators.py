"""The operators against brute force, and their defined results for odd input."""

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from hopwise.llm import bpe, lines, packing, quality, repeats, simhash
from hopwise.llm.exact_dedup import exact_dedup, survivors
from hopwise.llm.sharding import interleaved_shards

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def table(df):
    return [r.asDict() for r in df.collect()]


def by_id(df):
    return {r["doc_id"]: r for r in table(df)}


# ---- exact deduplication


@pytest.mark.parametrize("bits", [1, 4])
def test_exact_dedup(docs, rows, bits):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    want = {i: (min(g)[1], len(g), i == min(g)[1], hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, i in g}
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in table(exact_dedup(docs, fan_in_bits=bits))}
    assert got == want


def test_exact_dedup_odd(odd, empty):
    out = table(exact_dedup(odd))
    assert len(out) == 18 and sum(r["kept"] for r in out) == len({r["text_sha256"] for r in out})
    kept = survivors(odd)
    assert kept.columns == odd.columns and kept.count() == len({r["text_sha256"] for r in out})
    assert exact_dedup(empty).count() == survivors(empty).count() == 0


# ---- sharding


def test_sharding(docs, rows):
    out = table(interleaved_shards(docs, shards=7))
    assert sorted(r["doc_id"] for r in out) == [r[0] for r in rows]
    text = {i: (t or "").encode() for i, t, *_ in rows}
    of = {i: s for i, _, _, s, _ in rows}
    shards = defaultdict(list)
    for r in out:
        assert r["size"] == len(text[r["doc_id"]]) + 8 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]]) and r["law"] == "rows" and r["grown_shard"] is None
        shards[r["shard"]].append(r)
    assert sorted(shards) == [*range(7)] and max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    for some in shards.values():
        assert sorted(r["slot"] for r in some) == [*range(len(some))]
    total = Counter(of.values())
    for some in shards.values():
        mix = Counter(of[r["doc_id"]] for r in some)
        assert all(abs(mix[s] - n / 7) <= 1.5 for s, n in total.items())
    assert out != [] and sorted(map(str, out)) == sorted(map(str, table(interleaved_shards(docs.repartition(2), shards=7))))


def test_sharding_odd(odd, empty):
    out = table(interleaved_shards(odd))
    assert sorted(r["shard"] for r in out) == sorted({r["shard"] for r in out}) and len(out) == 18
    assert interleaved_shards(empty).count() == 0


# ---- SimHash


def brute_components(fp, bits):
    root = {i: i for i in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fp)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if bin(fp[a] ^ fp[b]).count("1") <= bits and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def brute_fingerprint(t, k=4):
    w = [x.lower() for x in WORD.findall((t or "").encode())]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize(("bits", "words"), [(4, 4), (6, 5)])
def test_simhash(docs, rows, bits, words):
    fp = {i: brute_fingerprint(t, words) for i, t, *_ in rows}
    want = brute_components(fp, bits)
    out = by_id(simhash.near_duplicates(docs, bits, shingle_words=words))
    assert {i: r["fingerprint"] for i, r in out.items()} == {i: f"{x:016x}" for i, x in fp.items()}
    assert {i: r["component_id"] for i, r in out.items()} == want
    assert len(set(want.values())) < len(want)
    kept = simhash.representatives(docs, bits, shingle_words=words)
    assert {r["doc_id"] for r in table(kept)} == set(want.values())


def test_simhash_links_in_sliced_buckets_and_chains(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SLICE", 8)
    r = np.random.default_rng(3)
    fps = [0x0123456789ABCDEF]
    for _ in range(120):  # a chain whose ends are far apart, and a dense heap
        x = fps[-1]
        for b in r.choice(64, 4, replace=False):
            x ^= 1 << int(b)
        fps.append(x)
    fps += [fps[0] ^ (1 << int(a)) ^ (1 << int(b)) for a, b in r.integers(0, 64, (60, 2))] + [int(x) for x in r.integers(0, 1 << 63, 200)]
    fps = sorted(set(fps))
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    from hopwise.llm.components import components

    label = {x["node"]: x["root"] for x in components(simhash.linked_fingerprints(df)).collect()}
    want = brute_components(dict(enumerate(fps)), 4)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    mine = defaultdict(set)
    theirs = defaultdict(set)
    for i, x in enumerate(signed):
        mine[label.get(x, x)].add(x)
        theirs[want[i]].add(x)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_simhash_odd(odd, empty):
    assert len(table(simhash.near_duplicates(odd))) == 18
    groups = brute_components({n: brute_fingerprint(r["text"]) for n, r in enumerate(table(odd))}, 4)
    kept = simhash.representatives(odd)
    assert kept.columns == odd.columns and kept.count() == len(set(groups.values()))
    assert simhash.near_duplicates(empty).count() == simhash.representatives(empty).count() == 0


def test_pivots_only_discard_what_is_far():
    r = np.random.default_rng(1)
    fps = r.integers(0, 1 << 63, 300).astype(np.uint64)
    fps[150:] = fps[:150] ^ np.uint64(0b1011)
    t = simhash.PivotTable(fps, 4)
    i, j = np.triu_indices(300, 1)
    assert set(t.close(i, j)) == set(np.flatnonzero(np.bitwise_count(fps[i] ^ fps[j]) <= 4))


# ---- quality


def brute_base(t):
    t = t or ""
    w = WORD.findall(t.encode())
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line.encode()):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), dup, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def test_quality_rules(docs, labels, rows):
    model = quality.fit_ngram_model(docs, labels)
    out = by_id(quality.quality_rules(docs, model))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert {i: tuple(r[n] for n in names) for i, r in out.items()} == {i: brute_base(t) for i, t, *_ in rows}
    assert all(not (r["kept"] and r["base_failed"]) and 0 <= r["probability"] <= 1 for r in out.values())
    junk = [i for i, t, *_ in rows if t and "%%%" in t]
    assert not any(out[i]["kept"] for i in junk) and sum(r["kept"] for r in out.values()) > 40
    assert {r["doc_id"] for r in table(quality.rule_keepers(docs, model))} == {i for i, r in out.items() if r["kept"]}


def test_quality_without_labels_keeps_what_passes(docs, labels, odd, empty):
    model = quality.fit_ngram_model(docs, labels.where("false"))
    assert all(r["kept"] != r["base_failed"] for r in table(quality.quality_rules(docs, model)))
    assert quality.rule_keepers(odd, model).columns == odd.columns
    assert len(table(quality.quality_rules(odd, model))) == 18 and quality.quality_rules(empty, model).count() == 0
    assert quality.fit_ngram_model(empty, labels).shift == quality.NgramModel().shift


def test_factor_machine(docs, labels, rows, odd, empty):
    out = by_id(quality.factor_scores(docs, quality.fit_factor_machine(docs, labels)))
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for i, r in out.items())
    know = {r["doc_id"]: r["quality"] for r in table(labels)}
    right = [out[i]["predicted"] == q for i, q in know.items() if i in out and q is not None]
    assert sum(right) > 0.9 * len(right)
    plain = quality.FactorMachine()
    assert len(table(quality.factor_scores(odd, plain))) == 18 and quality.factor_scores(empty, plain).count() == 0


def test_factor_machine_pairs_in_linear_time():
    m = quality.FactorMachine()
    m.w[:], m.w0 = np.random.default_rng(0).normal(size=len(m.w)), 0.1
    m.square = (m.v**2).sum(1)
    at, x = m.features(b"some words and more words, here.", 32)
    pairs = sum(m.v[at[i]] @ m.v[at[j]] * x[i] * x[j] for i in range(len(at)) for j in range(i))
    assert m.score(at, x) == pytest.approx(1 / (1 + np.exp(-(m.w0 + x @ m.w[at] + pairs))), abs=1e-5)


def plain_hash(word):
    """The polynomial hash of a word's bytes, by the definition."""
    mask = (1 << 64) - 1

    def mix(x):
        x = ((x ^ (x >> 33)) * 0xFF51AFD7ED558CCD) & mask
        x = ((x ^ (x >> 33)) * 0xC4CEB9FE1A85EC53) & mask
        return x ^ (x >> 33)

    base, total = 0x9E3779B97F4A7C15, 0
    for i, b in enumerate(word):
        total += mix(((b + 1) * 0x9E3779B97F4A7C15) & mask) * pow(base, i, 1 << 64)
    return mix((total + len(word)) & mask)


def plain_ngram_score(model, t):
    """The model's probability: the mean weight of each family's members, member by member."""
    w = [plain_hash(x) for x in WORD.findall(t.encode())]
    mask, top = (1 << 64) - 1, 1 << model.BITS
    families = [[h >> (64 - model.BITS) for h in w]]
    families.append([(((a * 0xD6E8FEB86659FD93 + b) & mask) * 0x9E3779B97F4A7C15 & mask) >> (64 - model.BITS) for a, b in zip(w, w[1:], strict=False)])
    for n in model.SIZES:
        members = []
        for i in range(len(t) - n + 1):
            g = 0
            for c in t[i : i + n]:
                g = (g * 0x01000193 + ord(c)) & 0xFFFFFFFF
            members.append(((g * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - model.BITS))
        families.append(members)
    z = model.bias + sum(sum(float(model.w[f * top + m]) for m in members) / len(members) for f, members in enumerate(families) if members)
    return 1 / (1 + np.exp(-np.clip(model.slope * z + model.shift, -40, 40)))


def test_quality_verdict_is_the_model_s(docs, labels, rows):
    model = quality.fit_ngram_model(docs, labels)
    out, near = by_id(quality.quality_rules(docs, model)), 0
    for i, t, *_ in rows:
        p = plain_ngram_score(model, t or "")
        assert out[i]["probability"] == pytest.approx(p, abs=1e-6)
        near += abs(p - quality.KEEP_AT) < 1e-6
        assert out[i]["kept"] == (not out[i]["base_failed"] and p >= quality.KEEP_AT) or near
    assert near == 0


def test_long_texts_are_not_learnt_from(docs, labels, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 300)
    rows, counts = quality.labelled_sample(docs.select("doc_id", "text", "n_chars"), labels.selectExpr("doc_id", "quality label"), 1000)
    assert rows and all(len((t or "").encode()) <= 300 for t, _, _ in rows) and sum(counts.values()) > len(rows)


def plain_factor_score(m, t, n_chars):
    """The machine's score by all pairs of features, the features told from the text by the definition."""
    t = t or ""
    raw = t.encode()
    words = WORD.findall(raw)
    at = sorted({plain_hash(w) >> (64 - m.BITS) for w in words})
    n, lines = max(1, len(t)), raw.count(b"\n") + 1
    log = lambda x: min(m.BINS - 1, int(np.log2(1 + max(0, x))))
    part = lambda a, b: min(m.BINS - 1, int(m.BINS * (a / max(1, b)) ** 0.5))
    has = lambda chars: sum(raw.count(c.encode()) for c in chars)
    full = [x for x in raw.split(b"\n") if x.strip()]
    bins = [
        log(len(words)), part(len(at), len(words)), min(m.BINS - 1, int(n / max(1, len(words)))), part(sum("A" <= c <= "Z" for c in t), n), part(sum("0" <= c <= "9" for c in t), n),
        part(has("#*$%&|<>"), n), part(has("!"), n), part(has("!,.:;?"), n), part(len(full) - len(set(full)), lines), log(len(words) // lines), part(sum(ord(c) > 127 for c in t), n), log(n_chars if n_chars is not None else len(t)),
    ]
    places = at + [(1 << m.BITS) + i * m.BINS + b for i, b in enumerate(bins)]
    x = np.array([1 / np.sqrt(max(1, len(at)))] * len(at) + [1 / np.sqrt(len(bins))] * len(bins))
    v = m.v[places].astype(float) * x[:, None]
    z = m.w0 + float(x @ m.w[places]) + sum(float(v[i] @ v[i + 1 :].sum(axis=0)) for i in range(len(v) - 1))
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def test_factor_machine_scores_by_all_pairs(docs, labels, rows):
    machine = quality.fit_factor_machine(docs, labels)
    out = by_id(quality.factor_scores(docs, machine))
    for i, t, _, _, n in rows:
        assert out[i]["score"] == pytest.approx(plain_factor_score(machine, t, n), abs=1e-5), i


def test_held_out_rows_teach_nothing(docs, labels):
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.fit_factor_machine(docs, x) for x in (labels, turned))
    assert turned.exceptAll(labels).count() > 3 and a.w0 == b.w0 and (a.w == b.w).all() and (a.v == b.v).all()


# ---- byte-pair encoding


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(bpe.TOKENIZER)


def test_bpe(docs, rows, tokenizer):
    out = by_id(bpe.bpe_digests(docs))
    for i, t, *_ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        assert (out[i]["n_tokens"], out[i]["ids_sha256"], out[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def test_transducer_is_exact_on_long_words_and_byte_level_files(tokenizer):
    import random

    import public_tokenizers

    r = random.Random(4)
    e = bpe.encoder_of(open(bpe.TOKENIZER, encoding="utf-8").read())
    assert e.lookahead and e.lookahead < 2000
    for alphabet in ("theinganderstion", "ab", "inthaerou", "é中a"):
        t = "".join(r.choice(alphabet) for _ in range(12_000))
        assert e.encode(t) == tokenizer.encode(t, add_special_tokens=False).ids
    path = public_tokenizers.path("byte_bpe_50k.json")
    other, mine = Tokenizer.from_file(path), bpe.Encoder(open(path, encoding="utf-8").read())
    for t in ("Hello  wörld\n\n it's 😀 <|endoftext|>x  ", "a" * 5000, ""):
        ids = other.encode(t, add_special_tokens=False).ids
        d = bpe.Decoder(mine, True)
        assert mine.encode(t) == ids and "".join(map(d.feed, ids)) + d.finish() == other.decode(ids, skip_special_tokens=False)
    d = bpe.Decoder(mine, True)
    assert "".join(map(d.feed, other.encode("😀").ids[:1])) + d.finish() == other.decode(other.encode("😀").ids[:1])


def test_bpe_goes_through_the_transducer_and_the_decoder(tokenizer, monkeypatch):
    import random

    r, seen = random.Random(9), Counter()
    push, feed = bpe.Transducer.push, bpe.Decoder.feed

    def counted(self, raw):
        out = push(self, raw)
        seen["words" if not out else "early"] += 1
        seen["held"] = max(seen["held"], len(self.held))
        return out

    monkeypatch.setattr(bpe.Transducer, "push", counted)
    monkeypatch.setattr(bpe.Decoder, "feed", lambda self, i: (seen.update(["feeds"]), feed(self, i))[1])
    source = open(bpe.TOKENIZER, encoding="utf-8").read()
    e, known = bpe.Encoder(source), bpe.Remembered(None, 1000)
    ids_of = bpe.UnitEncoder(e)
    known.made = lambda unit: bpe._remembered_spelling(e, ids_of(unit))
    texts = ["some plain words, and some more words", "".join(r.choice("theinganders") for _ in range(900_000)), "x" * 300_000 + " y " + "!" * 300_000, "a<|endoftext|>" * 30_000, "e\u0301\uac00" * 100_000]
    for t in texts:
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        seen["feeds"] = 0
        got = bpe.digests(e, False, known, t.encode())
        assert got == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
        assert len(t) < 1000 or seen["feeds"] >= min(len(ids), 1000)
    assert seen["early"] > 100 and seen["words"] > 5 and seen["held"] < e.lookahead + 3 * bpe.Transducer.BLOCK


def test_bpe_stream_in_any_pieces(tokenizer, monkeypatch):
    import random

    r = random.Random(1)
    e = bpe.encoder_of(open(bpe.TOKENIZER, encoding="utf-8").read())
    kinds = ["theinganderstion", "ab'sretvlmd", "é中aáé́x", "0123", "!!''..", "<|endoftext|>", "가각각", "Σσς", "ẞİIi"]
    for _ in range(200):
        monkeypatch.setattr(bpe, "PIECE", r.choice([1, 2, 7, 50, 1000]))
        monkeypatch.setattr(bpe, "OPEN", r.choice([9, 20, 256]))
        t = "".join("".join(r.choice(a) for _ in range(r.randint(1, 60))) if r.random() < 0.9 else "<|startoftext|>" for a in r.choices(kinds, k=r.randint(1, 12)))
        assert [i for part in bpe.streamed(e, memoryview(t.encode())) for i in part] == tokenizer.encode(t, add_special_tokens=False).ids


def test_bpe_odd(odd, empty):
    out = table(bpe.bpe_digests(odd))
    assert len(out) == 18 and sum(r["n_tokens"] == 0 for r in out) == 2 and bpe.bpe_digests(empty).count() == 0


def test_remembered_is_bounded():
    m = bpe.Remembered(lambda k: k, 10)
    assert all(m[bytes([i % 200])] == bytes([i % 200]) for i in range(1000)) and len(m) + len(m.older) <= 10


# ---- packing


@pytest.mark.parametrize("most", [2, 128])
def test_packing(docs, rows, tokenizer, most, monkeypatch):
    monkeypatch.setattr(packing, "MEET", 2)
    out = table(packing.packed(docs, most=most))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert sorted(pieces) == [r[0] for r in rows]
    for i, t, *_ in rows:
        ids, at = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            part = ids[at : at + r["length"]]
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
            at += r["length"]
        assert at == len(ids)
    for some in sequences.values():
        at = 0
        for r in sorted(some, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.SIZE
    if most > 2:
        assert len(sequences) <= -(-sum(r["length"] for r in out) // packing.SIZE) + 2


def test_packing_with_a_file_that_keeps_white_space(spark):
    import public_tokenizers

    path, t = public_tokenizers.path("byte_bpe_50k.json"), "two  words\n and 3"
    ids = [*Tokenizer.from_file(path).encode(t).ids, 1]
    (row,) = table(packing.packed(spark.createDataFrame([(1, t)], "doc_id long, text string"), path=path))
    assert (row["doc_tokens"], row["ids_crc32"]) == (len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))


def test_packing_odd(odd, empty):
    assert sum(r["start"] == 0 for r in table(packing.packed(odd))) == 18
    assert packing.packed(empty).count() == 0


def test_packer_holds_no_more_windows_than_it_may():
    p, out = packing.BoundedPacker(10, 3), []
    for i, n in enumerate([6, 7, 8, 5, 3, 2, 9, 4, 4, 1, 10]):
        out += p.add((i, n), n)
        assert len(p.windows) <= 3
    out += p.rest()
    assert sorted(i for w in out for i, _ in w) == [*range(11)] and all(sum(n for _, n in w) <= 10 for w in out)


# ---- repeats


def brute_repeats(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        step = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                step[i] += 1
                step[i + length] -= 1
        gone = np.cumsum(step[:-1]) > 0
        out.append((len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "anchor", "array"), [(200, 64, 8192), (200, 64, 1), (24, 9, 8192), (24, 9, 3)])
def test_repeats(docs, rows, length, anchor, array, monkeypatch):
    monkeypatch.setattr(repeats, "ARRAY", array)
    want = brute_repeats([(t or "").encode() for _, t, *_ in rows], length)
    out = by_id(repeats.remove_repeats(docs, length=length, anchor=anchor))
    assert [tuple(out[i][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for i, *_ in rows] == want
    assert sum(w[1] for w in want) > 0


def test_repeats_in_texts_over_a_piece(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE_BITS", 9)
    import random

    r = random.Random(2)
    a = "".join(r.choice("abcdefgh") for _ in range(2000))
    texts = [a, a[300:1500] + "".join(r.choice("ijkl") for _ in range(700)), "z" * 900]
    out = by_id(repeats.remove_repeats(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").coalesce(1), length=60, anchor=20))
    want = brute_repeats([t.encode() for t in texts], 60)
    assert [tuple(out[i][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for i in range(3)] == want


def test_repeat_groups_have_all_occurrences(spark):
    import random

    r = random.Random(7)
    noise = lambda n: "".join(r.choice("abcdefghij") for _ in range(n))
    p = noise(60)
    texts = [noise(50) + p + noise(50), noise(30) + p + noise(80), p[:45] + noise(60), noise(20)]
    rows = spark.createDataFrame([(bytes([i]), t) for i, t in enumerate(texts)], "__rid binary, text string")
    got = defaultdict(set)
    for g in repeats.Repeats(rows, 40, 16).groups().collect():
        got[g["k"], g["nth"]].add((g["__rid"][0], g["start"], g["size"]))
    for some in got.values():
        assert len({texts[i][s : s + n] for i, s, n in some}) == 1
    covered = {i: set() for i in range(4)}
    for some in got.values():
        for i, s, n in some:
            covered[i] |= set(range(s, s + n))
    assert covered[0] >= set(range(50, 110)) and covered[1] >= set(range(30, 90)) and covered[2] >= set(range(45)) and not covered[3]
    assert any({i for i, *_ in some} == {0, 1, 2} for some in got.values())


def test_repeat_groups_around_a_crowded_anchor(spark, monkeypatch):
    """The sets that share a string of the length, each over all that it shares, whether a task may hold them or not."""
    import random

    r = random.Random(8)
    noise = lambda n: "".join(r.choice("abcdefghij") for _ in range(n))
    p = noise(60)
    texts = [noise(30) + p + noise(30) for _ in range(6)] + [noise(10) + p[5:50] + noise(20) for _ in range(3)]
    rows = spark.createDataFrame([(bytes([i]), t) for i, t in enumerate(texts)], "__rid binary, text string")

    def found(array):
        monkeypatch.setattr(repeats, "ARRAY", array)
        got = defaultdict(set)
        for g in repeats.Repeats(rows, 40, 16).groups().collect():
            got[g["k"], g["nth"]].add((g["__rid"][0], g["start"], g["size"]))
        return {frozenset(x) for x in got.values()}

    few, crowded = found(8192), found(1)
    for some in (few, crowded):
        assert all(len({texts[i][s : s + n] for i, s, n in group}) == 1 for group in some)
        assert {9, 6} <= {len({i for i, *_ in group}) for group in some}
    covered = [{(i, at) for group in some for i, s, n in group for at in range(s, s + n)} for some in (few, crowded)]
    assert covered[0] == covered[1]


def test_ids_that_hold_the_separator(spark):
    """A row is known by its id's length too: ("a|z", t) is not ("a", "z|" + t)."""
    t = "one two three " * 30
    df = spark.createDataFrame([("a|z", t), ("a", "z|" + t), (None, t), ("n", t)], "doc_id string, text string")
    out = {r["doc_id"]: r for r in repeats.remove_repeats(df).collect()}
    assert all(r["n_removed"] <= r["n_bytes"] for r in out.values()) and out["a"]["n_bytes"] == len(t) + 2
    assert {r["doc_id"] for r in lines.repeated_units(df, units="lines").collect()} <= {"a|z", "n", None}
    assert {r["doc_id"] for r in table(survivors(df))} == {"a", "a|z"}
    assert {r["component_id"] for r in simhash.near_duplicates(df).collect()} <= {"a", "a|z", "n"} and simhash.representatives(df).count() >= 1


def test_intervals_of_the_common_prefix_tree():
    words = sorted(["banana"[i:] for i in range(6)])
    lcp = [repeats._common(a.encode(), b.encode()) for a, b in zip(words, words[1:], strict=False)]
    assert sorted(repeats.intervals(lcp)) == [(1, 0, 2), (2, 4, 5), (3, 1, 2)]


def test_repeats_odd(odd, empty, rows):
    out = table(repeats.remove_repeats(odd))
    assert len(out) == 18
    again = [r for r in out if r["doc_id"] == 1]
    assert len(again) == 3 and all(r["n_removed"] == r["n_bytes"] for r in again if r["n_bytes"] >= 200)
    cut = repeats.trimmed(odd)
    assert cut.columns == odd.columns and cut.count() == 18 and repeats.trimmed(empty).count() == repeats.remove_repeats(empty).count() == 0


def test_trimmed_keeps_characters_whole():
    t = "aé中b".encode()
    for s in range(len(t)):
        for e in range(s, len(t) + 1):
            repeats.without(t, repeats.whole_characters(t, [(s, e)])).decode()


# ---- lines


def plain_units(t, kind):
    """(number, start, end, normalised text) of each unit, by the definition."""
    if kind == "lines":
        at = 0
        for line in t.split("\n"):
            if w := re.findall(r"[^\x20\x09-\x0D]+", line):
                yield at, at + len(line), " ".join(w)
            at += len(line) + 1
        return
    found = list(re.finditer(r"[^\x20\x09-\x0D]+", t))
    words = [re.sub("[A-Z]", lambda x: x[0].lower(), m[0]) for m in found]
    v = [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in words]
    value = {i: (5 * v[i - 1] + 3 * v[i]) % 2**32 for i in range(1, len(v))}
    near = range(1, lines.REACH + 1)
    cut = [0, *(i for i in value if all(value[i] < value.get(i - d, 2**32) and value[i] <= value.get(i + d, 2**32) for d in near)), len(words)]
    many = min(lines.LINES, len(cut) - 1)
    for a, b in zip(cut, cut[many:], strict=False) if words else ():
        yield found[a].start(), found[b - 1].end(), " ".join(words[a:b])


@pytest.mark.parametrize("kind", ["lines", "reflowed"])
def test_lines(docs, rows, kind):
    first, want = {}, []
    for i, t, *_ in rows:
        for n, (s, e, unit) in enumerate(plain_units(t or "", kind)):
            key = re.sub("[A-Z]", lambda m: m[0].lower(), unit)
            if key in first:
                want.append((i, n, s, e, hashlib.md5(key.encode()).hexdigest(), *first[key]))
            else:
                first[key] = (i, s)
    got = [(r["doc_id"], r["unit"], r["start"], r["end"], r["digest"], r["first_doc_id"], r["first_start"]) for r in table(lines.repeated_units(docs, units=kind))]
    assert sorted(got) == sorted(want) and want
    left = by_id(lines.without_repeated_units(docs, units=kind))
    spans = defaultdict(list)
    for i, _, s, e, *_ in want:
        if spans[i] and s <= spans[i][-1][1]:
            spans[i][-1][1] = max(e, spans[i][-1][1])
        else:
            spans[i].append([s, e])
    for i, t, *_ in rows:
        keep, at = "", 0
        for s, e in spans[i]:
            keep, at = keep + t[at:s], min(e + 1, len(t))
        assert left[i]["text"] == (keep + t[at:] if spans[i] else t)
        assert [[s["start"], s["end"]] for s in left[i]["removed_spans"] or []] == spans[i]


def test_lines_passage_in_lines(spark):
    """A passage that begins and ends inside lines is found but for a few words at its ends."""
    import random

    r = random.Random(3)
    words = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    passage = words(60)
    texts = [f"{words(40)} {passage} {words(40)}", f"{words(7)}\n{words(9)} {passage.replace(' ', chr(10), 3).upper()} {words(30)}", words(100)]
    left = by_id(lines.without_repeated_units(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert left[0]["text"] == texts[0] and left[2]["text"] == texts[2]
    gone = len(texts[1]) - len(left[1]["text"])
    assert 0.6 * len(passage) < gone <= len(passage) + 1


def test_lines_odd(odd, empty):
    assert lines.without_repeated_units(odd).count() == 18 and lines.repeated_units(empty).count() == 0
    assert all(r["doc_id"] != 1 or r["first_doc_id"] != 1 for r in table(lines.repeated_units(odd)))
    assert list(lines.unit_spans(b"a\nb\n\n \nc", True)) == [(0, 3), (7, 8)]
    assert list(lines.reflowed_units(b" \n ")) == [] and [u[:3] for u in lines.reflowed_units("é\n é  b".encode())] == [(0, 7, 3)]
    long = " ".join(map(str, range(200_000))).encode()
    assert sum(1 for _ in lines.reflowed_units(long)) > 10_000


# ---- very long texts


def test_one_very_long_text_among_others(spark, docs, labels, tokenizer):
    """Every operator reads a text of over a megabyte whole."""
    import random

    r = random.Random(6)
    word = [f"{r.choice('bcdfgh')}{r.choice('aeiou')}{r.choice('lmnprst')}{n % 97}" for n in range(2000)]
    long = "\n".join(" ".join(r.choice(word) for _ in range(40)) for _ in range(5000))
    passage = " ".join(r.choice(word) for _ in range(300))
    some = [(0, long + "\n" + passage, "en", "s", 1), (1, "short " + passage, "en", "s", 1), (2, None, None, None, None), (3, long.replace("\n", "  "), "en", "s", 1)]
    df = spark.createDataFrame(some, "doc_id long, text string, lang string, source string, n_chars long").repartition(2)
    text = {i: t or "" for i, t, *_ in some}
    cut = by_id(repeats.remove_repeats(df))
    assert all(cut[i]["n_bytes"] == len(t) for i, t in text.items()) and cut[1]["n_removed"] >= len(passage)
    base = by_id(quality.quality_rules(df, quality.fit_ngram_model(docs, labels)))
    assert {i: base[i]["n_words"] for i in text} == {i: len(t.split()) for i, t in text.items()}
    assert all(0 <= x["score"] <= 1 for x in by_id(quality.factor_scores(df, quality.fit_factor_machine(docs, labels))).values())
    assert all(int(x["fingerprint"], 16) == brute_fingerprint(text[i]) for i, x in by_id(simhash.near_duplicates(df)).items() if i in (1, 2))
    ids = {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in text.items()}
    assert {i: x["n_tokens"] for i, x in by_id(bpe.bpe_digests(df)).items()} == {i: len(x) for i, x in ids.items()}
    packs = table(packing.packed(df))
    assert all(sum(x["length"] for x in packs if x["doc_id"] == i) == len(ids[i]) + 1 for i in text)
    assert sorted(x["size"] for x in table(interleaved_shards(df))) == sorted(len(t) + 8 for t in text.values())
    assert by_id(exact_dedup(df))[0]["keep_id"] == 0
    left = by_id(lines.without_repeated_units(df))
    assert left[0]["text"] == text[0] and len(left[1]["text"]) < 400 and len(left[3]["text"]) < len(text[3]) // 10
