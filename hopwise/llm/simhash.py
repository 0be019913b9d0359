"""SimHash near-duplicates: fingerprints, links found through pivot distance tables, components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopwise.llm.common import RID, arrow, as_bytes, by_group, checkpointed, only, picked, row_key, rows_at_a_time
from hopwise.llm.components import components, dealt_out

SEED = 42
SHINGLE_WORDS = 4
MAX_BITS = 4
PIVOTS = 16
#: The 64 bits are cut into so many blocks more than may differ, so in any link that many blocks are alike.
KEYED = 2
#: Fingerprints of a bucket that one task compares at a time; larger buckets are dealt out to slices.
SLICE = 512


def fingerprint(words: list[bytes], k: int = SHINGLE_WORDS, block: int = 1 << 15) -> int:
    """Each bit that is set in over half the XXH64 of the shingles; no words: 0. Memory is bounded by the block."""
    n = len(words) - k + 1
    if not words:
        return 0
    if n <= 1:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, block):
        part = words[at : min(n, at + block) + k - 1]
        text = b" ".join(part)
        length = np.fromiter(map(len, part), np.int64, len(part))
        end = np.cumsum(length + 1) - 1
        m = len(part) - k + 1
        h = np.fromiter([digest(text[i:j], SEED) for i, j in zip((end - length)[:m].tolist(), end[k - 1 :].tolist(), strict=True)], np.uint64, m)
        bits = np.unpackbits(h.view(np.uint8).reshape(m, 8), axis=1, bitorder="little")
        total += np.add.reduceat(bits, np.arange(0, m, 255), axis=0).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, text: str = "text", doc_id: str = "doc_id", keyed: bool = False, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp), with keyed the row's key too: fp is the fingerprint as a signed long."""
    names = [RID] * keyed + ["doc_id", "fp"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_at_a_time(batches):
            fp = np.array([fingerprint(x.lower().split(), shingle_words) for x in as_bytes(b["text"])], np.uint64)
            yield pa.RecordBatch.from_arrays([b[n] for n in names[:-1]] + [pa.array(fp.view(np.int64))], names=names)

    rows = picked(df, doc_id=doc_id, text=text)
    if keyed:
        rows = rows.withColumn(RID, row_key("doc_id", "text"))
    return rows.mapInArrow(run, f"{RID} binary, " * keyed + f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def pivots(n: int = PIVOTS) -> np.ndarray:
    """The reference fingerprints: XXH64 of 0 to n - 1."""
    return np.array([xxhash.xxh64_intdigest(i.to_bytes(8, "little"), SEED) for i in range(n)], np.uint64)


def _block_keys(max_bits: int) -> list[Column]:
    blocks = max_bits + KEYED
    if not 0 <= max_bits <= 14:
        raise ValueError("0 to 14 bits")
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(signed(sum(some))).cast("long"))) for t, some in enumerate(combinations(masks, KEYED))]


class PivotTable:
    """Hamming distances of fingerprints to the pivots. Two fingerprints differ in no fewer bits than any coordinate does."""

    def __init__(self, fps: np.ndarray, max_bits: int) -> None:
        self.fps, self.max_bits = fps, max_bits
        self.table = np.bitwise_count(fps[:, None] ^ pivots()[None, :]).astype(np.int8)

    def close(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs (i, j) are linked: discard by the coordinates, four more at a time, and verify the rest."""
        i, j = np.broadcast_arrays(i, j)
        left = np.arange(len(i))
        for c in range(0, self.table.shape[1], 4):
            gap = np.abs(self.table[i[left], c : c + 4] - self.table[j[left], c : c + 4]).max(axis=1, initial=0)
            left = left[gap <= self.max_bits]
        return left[np.bitwise_count(self.fps[i[left]] ^ self.fps[j[left]]) <= self.max_bits]

    def spanning(self, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Links that connect what is connected among these rows, fewer than there are rows: each reached row is searched from once, among those not yet reached."""
        rest = rows[np.argsort(self.table[rows, 0], kind="stable")]
        while len(rest):
            todo, rest = [rest[0]], rest[1:]
            while todo and len(rest):
                x = todo.pop()
                first = self.table[rest, 0]
                lo, hi = np.searchsorted(first, [self.table[x, 0] - self.max_bits, self.table[x, 0] + self.max_bits + 1])
                found = lo + self.close(np.array([x]), rest[lo:hi])
                if len(found):
                    y = rest[found]
                    yield x, y
                    todo.extend(y)
                    rest = np.delete(rest, found)


def _links(max_bits: int, small: int = 6):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; a bucket that a batch breaks off is carried into the next."""
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def links(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            t, a, b = PivotTable(fp.view(np.uint64), max_bits), [], []
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
            size = np.diff(np.r_[start, len(key)])
            few = np.repeat(size <= small, size)
            for d in range(1, small):
                i = np.flatnonzero(few[:-d] & (key[:-d] == key[d:])) if len(key) > d else np.zeros(0, int)
                i = i[t.close(i, i + d)]
                a.append(fp[i])
                b.append(fp[i + d])
            for s, n in zip(start[size > small], size[size > small], strict=True):
                for x, y in t.spanning(np.arange(s, s + n)):
                    a.append(np.full(len(y), fp[x]))
                    b.append(fp[y])
            a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
            return arrow(schema, [np.minimum(a, b), np.maximum(a, b)])

        key = fp = np.zeros(0, np.int64)
        for batch in batches:
            key, fp = np.r_[key, batch["key"].to_numpy()], np.r_[fp, batch["fp"].to_numpy()]
            cut = np.searchsorted(key, key[-1]) if len(key) else 0
            if cut:
                yield links(key[:cut], fp[:cut])
                key, fp = key[cut:], fp[cut:]
        yield links(key, fp)

    return run


def _links_between(max_bits: int):
    """Links of different roots in groups of dealt out buckets, enough to connect what they connect."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for t in by_group(batches):
            fp, root, main, own, here = (t[c].to_numpy(zero_copy_only=False).copy() for c in ("fp", "root", "main", "own", "slice"))
            table, a, b = PivotTable(fp.view(np.uint64), max_bits), [], []
            for x in np.flatnonzero(~main):
                y = np.flatnonzero((root != root[x]) & (main | ((fp > fp[x]) & (own[x] == here[x]))))
                for j in y[table.close(np.full(len(y), x), y)].tolist() if len(y) else ():
                    if root[j] != root[x]:
                        root[root == root[j]] = root[x]
                        a.append(min(fp[x], fp[j]))
                        b.append(max(fp[x], fp[j]))
            yield arrow(schema, [a, b])

    return run


def linked_fingerprints(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b) of distinct fingerprints in fps.fp, enough of the pairs within max_bits to connect all that they connect.

    Two fingerprints within 4 bits agree in at least 2 of 6 blocks, so each goes to 15 buckets, one for each two blocks;
    within 6 bits, to 28. Lone ones go no further. In a bucket the pivot table discards pairs and the survivors are
    verified bit by bit. In buckets over SLICE all are first compared with one of the bucket, another in each; what that
    connects is dealt out to slices, and only what is not connected yet meets all of them.
    """
    keyed = fps.select("fp", F.explode(F.array(*_block_keys(max_bits))).alias("key"))
    lead = F.min(F.struct(F.xxhash64("key", "fp").alias("order"), "fp")).alias("lead")
    size = checkpointed(keyed.groupBy("key").agg(F.count("*").alias("n"), lead).where("n > 1").select("key", "n", F.col("lead.fp").alias("lead")))
    few = keyed.join(size.where(f"n <= {SLICE}").select("key"), "key").select("fp", "key")
    links = few.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_links(max_bits), "a long, b long").distinct()
    if not size.where(f"n > {SLICE}").limit(1).count():
        return links
    hot = checkpointed(keyed.join(size.where(f"n > {SLICE}").select("key", "lead"), "key"))
    star = hot.where((F.col("fp") != F.col("lead")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("lead"))) <= max_bits))
    star = checkpointed(star.select(F.least("fp", "lead").alias("a"), F.greatest("fp", "lead").alias("b")).distinct())
    label = components(star).select(F.col("node").alias("fp"), F.col("root").alias("of"))
    rooted = checkpointed(hot.drop("lead").join(label, "fp", "left").select("key", "fp", F.coalesce("of", "fp").alias("root")))
    dealt = dealt_out(rooted, "fp", SLICE).select("group", "fp", "root", "main", "own", "slice")
    rest = dealt.repartition("group").sortWithinPartitions("group", "fp").mapInArrow(_links_between(max_bits), "a long, b long")
    return links.union(star).union(rest)


def near_duplicates(df: DataFrame, max_bits: int = MAX_BITS, text: str = "text", doc_id: str = "doc_id", keyed: bool = False, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """One row per input row: doc_id, fingerprint, component_id; with keyed also the row's key and that of its component's first row.

    A-Z is lower-cased, words are ``[^\\x20\\x09-\\x0D]+``, shingles are of shingle_words words with repeats; fingerprints link at
    max_bits or fewer differing bits; whole texts of any length are read. component_id is the smallest doc_id that a document reaches, of doc_id's type. Equal fingerprints are one node, so copies cost nothing beyond their fingerprint.
    Null and empty texts have fingerprint zero and link like any other; a null doc_id comes after all others; repeated
    rows are in one component; an empty table gives an empty result; other columns are not looked at.
    """
    docs = checkpointed(fingerprints(df, text, doc_id, keyed, shingle_words))
    key = [F.col(RID).alias("row")] if keyed else []
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), *key)
    fps = checkpointed(docs.groupBy("fp").agg(F.min(first).alias("first")))
    label = components(linked_fingerprints(fps, max_bits))
    rooted = checkpointed(fps.join(label, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    best = checkpointed(rooted.groupBy("root").agg(F.min("first").alias("best")))  # so that the join can split a large component
    named = rooted.join(best, "root").select("fp", "best")
    return docs.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("best.id").alias("component_id"), *([RID, "best.row"] if keyed else [])
    )


def representatives(df: DataFrame, max_bits: int = MAX_BITS, text: str = "text", doc_id: str = "doc_id", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of df with the smallest doc_id of their component, with all their columns."""
    kept = near_duplicates(df, max_bits, text, doc_id, True, shingle_words).where(F.col(RID) == F.col("row")).select(RID)
    return only(df, kept, doc_id, text)
