"""Near-duplicates by the Jaccard similarity of word shingles: candidates from the bands of a wide SimHash, discarded by pivot tables and whole fingerprints, verified by their shingles; components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopwise.llm.common import RID, arrow, as_bytes, by_group, checkpointed, only, picked, row_key, rows_at_a_time
from hopwise.llm.components import components, dealt_out
from hopwise.llm.hashing import mixed
from hopwise.llm.simhash import SEED, PivotTable

SHINGLE_WORDS = 5
#: Similar texts have NUM / DEN of their distinct shingles in common.
NUM, DEN = 4, 5
#: 64-bit words of a fingerprint and the bits of one of its bands. At 0.8 a bit differs with a probability of 0.1515 (large sets; 0.161 at most from ten shingles on), so 2e-6 of such pairs have no band alike (2e-5).
WORDS, BAND = 44, 16
BANDS = 64 * WORDS // BAND
#: Bits in which candidates may differ: of the first 64, of the first 128, and of all.
FAR, FAR_TWO, FAR_ALL = 26, 44, 64 * WORDS // 5
#: Words that are compared in the buckets of a band, where a row has few that are near, and the bits in which they may differ; at 0.8 it is 155 of 1024 (165 at most), with a deviation of 12.
MORE, FAR_MORE = 16, 240
#: Bands that are looked through first; pairs of a cluster that these bring together are compared then and pass the rest.
SOON = 16
#: Bands, two at a time, in which rows are first compared with one row each.
FIRST = 24
#: Sets of FEW shingles or less, whose bits differ more, also meet by what is left without one shingle, which is exact.
FEW = 9
#: Rows of a bucket that are compared in one group.
SLICE = 1024
#: A cluster of candidates is verified in slices of so many rows, in so many slices where that makes larger ones, but not of over SLICE.
PART, PARTS = 64, 16
#: Bits of the map of nodes by which shingles are picked before they are shuffled. It may let others pass, as the join after it decides.
MAP = 1 << 23

_SALTS = mixed(np.arange(1, WORDS + 1, dtype=np.uint64))


def shingle_set(words: list[bytes], k: int = SHINGLE_WORDS, block: int = 1 << 15) -> np.ndarray:
    """The distinct XXH64 of the shingles in order; of fewer than k words one shingle of all, of no words none."""
    n, digest, out = max(1, len(words) - k + 1), xxhash.xxh64_intdigest, []
    if not words:
        return np.zeros(0, np.uint64)
    for at in range(0, n, block):
        part = words[at : min(n, at + block) + k - 1]
        text, m, end, ends = b" ".join(part), max(1, len(part) - k + 1), -1, []
        for w in part:
            end += len(w) + 1
            ends.append(end)
        starts = [0, *(e + 1 for e in ends[: m - 1])]
        out.append(np.unique(np.fromiter([digest(text[i:j], SEED) for i, j in zip(starts, ends[-m:], strict=True)], np.uint64, m)))
    return out[0] if len(out) == 1 else np.unique(np.concatenate(out))


def set_fingerprint(h: np.ndarray) -> np.ndarray:
    """SimHash of distinct shingles, WORDS words: each bit that is set in over half of the hashes."""
    total = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(h), 255):
        part = mixed(h[at : at + 255, None] ^ _SALTS)
        total += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * total > len(h), bitorder="little").view(np.uint64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def without_one(h: np.ndarray) -> list[int]:
    """Digests of a set of FEW shingles or less and of what is left without each; of larger sets none."""
    return [_signed(xxhash.xxh64_intdigest(x.tobytes(), SEED)) for x in (h, *(np.delete(h, i) for i in range(len(h))))] if 0 < len(h) <= FEW else []


def _sketches(shingle_words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("node", pa.int64()), ("size", pa.int64()), ("bits", pa.binary()), ("few", pa.list_(pa.int64())), ("shingles", pa.binary())])
        for b in rows_at_a_time(batches):
            out = []
            for t in as_bytes(b["text"]):
                h = shingle_set(t.lower().split(), shingle_words)
                short = np.unique((h >> np.uint64(32)).astype(np.uint32))
                out.append((_signed(xxhash.xxh64_intdigest(h.tobytes(), SEED)), len(h), set_fingerprint(h).tobytes(), without_one(h), short.tobytes()))
            made = arrow(schema, list(zip(*out, strict=True)) if out else [[]] * 5)
            yield pa.RecordBatch.from_arrays([b[RID], b["doc_id"], *made.columns], names=[RID, "doc_id", *schema.names])

    return run


def _words_of(column: pa.ChunkedArray | pa.Array, words: int = WORDS) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, words)


def near(table: PivotTable, second: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j) their first two words allow: the pivot table of the first discards, whole words decide."""
    ok = table.close(i, j)
    apart = np.bitwise_count(table.fps[i[ok]] ^ table.fps[j[ok]]) + np.bitwise_count((second[i[ok]] ^ second[j[ok]]).view(np.uint64))
    return ok[apart <= FAR_TWO]


def sizes_alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return DEN * np.minimum(x, y) >= NUM * np.maximum(x, y)


def may_be_similar(x: np.ndarray, size_x: np.ndarray, y: np.ndarray, size_y: np.ndarray, far: int = FAR_ALL) -> np.ndarray:
    """Which pairs of fingerprints (their first words, with the bits that may differ in these) and sizes are candidates."""
    high = np.maximum(size_x, size_y)
    return sizes_alike(size_x, size_y) & ((np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64) <= far) | (high <= FEW))


def _alike(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) with both sizes and fingerprints: those that may be similar."""
    for b in rows_at_a_time(batches, 1 << 12):
        ok = may_be_similar(_words_of(b["bits_a"]), b["size_a"].to_numpy(), _words_of(b["bits_b"]), b["size_b"].to_numpy())
        yield b.select(["a", "b"]).filter(pa.array(ok))


def _similar(x: bytes, y: bytes) -> bool:
    a, b = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
    common = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * common >= NUM * (len(a) + len(b) - common)


def _verified(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in rows_at_a_time(batches):
        ok = [_similar(x, y) for x, y in zip(b["of_a"].to_pylist(), b["of_b"].to_pylist(), strict=True)]
        yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


_ROW = "key long, node long, root long, seen long, size long, first long, second long"


def _banded(bands: range):
    """Of nodes (node, root, seen, size, bits) a row for each of these bands of the fingerprint: its number and bits, and the first two words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c.split()[0], pa.int64()) for c in _ROW.split(", ")])
        for b in rows_at_a_time(batches, 64):
            words = _words_of(b["bits"])
            key = words.view(np.uint16)[:, bands.start : bands.stop].astype(np.int64) + (np.array(bands) << BAND)
            each = (*(b[c].to_numpy() for c in ("node", "root", "seen", "size")), *words[:, :2].view(np.int64).T)
            yield arrow(schema, [key.ravel(), *(np.repeat(x, len(bands)) for x in each)])

    return run


def _group_by_group(batches: Iterable[pa.RecordBatch], columns: dict[str, int], rows) -> Iterator[pa.RecordBatch]:
    """What rows() makes of whole groups, several at a time, of rows that come sorted by group; one that a batch breaks off is carried into the next. columns: words of each, 0 of numbers."""
    held = None
    for b in batches:
        new = [_words_of(b[c], n) if n else b[c].to_numpy(zero_copy_only=False) for c, n in columns.items()]
        held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
        cut = np.searchsorted(held[0], held[0][-1]) if len(held[0]) else 0
        if cut:
            yield rows(*[x[:cut] for x in held])
            held = [x[cut:] for x in held]
    if held is not None:
        yield rows(*held)


def _at_distance(group: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each d from 1 on and the rows i that are of the same group as i + d."""
    i, d = np.arange(len(group)), 1
    while len(i := i[: np.searchsorted(i, len(group) - d)]) and len(i := i[group[i] == group[i + d]]):
        yield d, i
        d += 1


def _open(x: np.ndarray, d: int, node: np.ndarray, root: np.ndarray, seen: np.ndarray, size: np.ndarray, main=None, own=None, here=None) -> np.ndarray:
    """Which pairs (x, x + d) are neither connected nor compared, and of sizes alike; of dealt out rows those that count in this slice."""
    x = x[(root[x] != root[x + d]) & (seen[x] != seen[x + d])]
    x = x[sizes_alike(size[x], size[x + d])]
    return x if main is None else x[(main[x] | main[x + d]).astype(bool) | (np.where(node[x] < node[x + d], own[x], own[x + d]) == here[x])]


_KEPT = {"group": "long", "node": "long", "root": "long", "seen": "long", "size": "long"}
_DEALT = {"main": "boolean", "own": "int", "slice": "int"}


def _promising(dealt: bool):
    """Of buckets those rows that are near another one's first words."""
    names = [*_KEPT, *_DEALT] if dealt else [*_KEPT]
    kinds = [pa.int64()] * len(_KEPT) + [pa.bool_(), pa.int32(), pa.int32()] * dealt

    def rows(group: np.ndarray, first: np.ndarray, second: np.ndarray, *rest: np.ndarray) -> pa.RecordBatch:
        table, found = PivotTable(first.view(np.uint64), FAR), np.zeros(len(group), bool)
        for d, i in _at_distance(group):
            x = _open(i[~(found[i] & found[i + d])], d, *rest)
            x = x[near(table, second, x, x + d)]
            found[x] = found[x + d] = True
        return arrow(pa.schema(list(zip(names, kinds, strict=True))), [c[found] for c in (group, *rest)])

    return lambda batches: _group_by_group(batches, dict.fromkeys(["group", "first", "second", *names[1:]], 0), rows)


def _clustered(dealt: bool):
    """Of buckets (a, b) that connect rows as candidates do: each row that has one with the first of those it reaches, so no more links than rows."""
    names = ["group", "bits", *[*_KEPT][1:], *[*_DEALT] * dealt]

    def rows(group: np.ndarray, words: np.ndarray, node: np.ndarray, root: np.ndarray, seen: np.ndarray, size: np.ndarray, *slices: np.ndarray) -> pa.RecordBatch:
        label = np.arange(len(group))
        for d, i in _at_distance(group):
            x = _open(i[label[i] != label[i + d]], d, node, root, seen, size, *slices)
            x = x[may_be_similar(words[x], size[x], words[x + d], size[x + d], FAR_MORE)]
            while len(x):
                top = np.arange(len(group))
                top[np.maximum(label[x], label[x + d])] = np.minimum(label[x], label[x + d])
                while (top != top[top]).any():
                    top = top[top]
                label = top[label]
                x = x[label[x] != label[x + d]]
        other = np.flatnonzero(label != np.arange(len(group)))
        return arrow(pa.schema([("a", pa.int64()), ("b", pa.int64())]), [node[label[other]], node[other]])

    return lambda batches: _group_by_group(batches, {c: MORE * (c == "bits") for c in names}, rows)


def _in_bands(rooted: DataFrame, large: DataFrame, bands: range) -> DataFrame:
    """rooted: node, root, seen, size, bits; large: roots of over SLICE nodes. (a, b), links that connect all pairs of different roots and seen with one of these bands in common that may be similar by their first words.

    Buckets with over SLICE nodes of such roots are dealt out to slices. Of each bucket the rows with one near go on;
    with more words they are connected.
    """
    grouped = lambda df: df.repartition("group").sortWithinPartitions("group")
    more = rooted.select("node", F.substring("bits", 1, 8 * MORE).alias("bits"))

    def met(df: DataFrame, dealt: bool) -> DataFrame:
        some = grouped(df).mapInArrow(_promising(dealt), ", ".join(f"{c} {k}" for c, k in (_KEPT | _DEALT if dealt else _KEPT).items()))
        return grouped(some.join(more, "node")).mapInArrow(_clustered(dealt), "a long, b long")

    keyed = rooted.mapInArrow(_banded(bands), _ROW)
    hot = checkpointed(rooted.join(large, "root").select(*rooted.columns).mapInArrow(_banded(bands), _ROW).groupBy("key").count().where(f"count > {SLICE}").select("key"))
    if not hot.limit(1).count():
        return met(keyed.withColumnRenamed("key", "group"), False)
    dealt = dealt_out(keyed.join(hot, "key"), "node", SLICE).drop("key")
    return met(keyed.join(hot, "key", "left_anti").withColumnRenamed("key", "group"), False).union(met(dealt, True))


def in_cells(members: DataFrame) -> DataFrame:
    """members: cluster, node, root, seen. group, node, root, seen, own, same: cells in which each two nodes of a cluster that differ in root meet once.

    A cluster is cut into slices, each two of which are a cell (same: both are one, and its own pairs count); where the
    commonest root has many nodes these are slices of their own that meet only the others. So a node is sent to as many
    cells as there are slices, a cell is bounded, and a large root with a few others costs no more than its nodes.
    """
    parts = lambda n: f"cast(greatest(least(ceil({n} / {PART}), {PARTS}), ceil({n} / {SLICE})) as int)"
    each = members.groupBy("cluster", "root").agg(F.count("*").alias("n")).groupBy("cluster")
    each = each.agg(F.sum("n").alias("n"), F.max("n").alias("m"), F.max_by("root", F.struct("n", "root")).alias("most")).withColumn("m", F.expr(f"if(m > {PART}, m, 0)"))
    each = checkpointed(each.select("cluster", F.expr("if(m > 0, most, null)").alias("most"), F.expr(parts("(n - m)")).alias("others"), F.expr(parts("m")).alias("mains")))
    out = members.join(each, "cluster").withColumn("main", F.coalesce(F.col("root") == F.col("most"), F.lit(False)))
    out = out.withColumn("own", F.expr("cast(if(main, others + pmod(xxhash64(2, node), mains), pmod(xxhash64(2, node), others)) as int)"))
    with_others = "transform(sequence(0, others - 1), k -> struct(least(own, k) as low, greatest(own, k) as high))"
    with_mains = "if(main or mains = 0, array(), transform(sequence(others, others + mains - 1), k -> struct(own as low, k as high)))"
    out = out.withColumn("cell", F.explode(F.expr(f"concat({with_others}, {with_mains})")))
    return out.select(F.xxhash64("cluster", "cell.low", "cell.high").alias("group"), "node", "root", "seen", "own", (F.col("cell.low") == F.col("cell.high")).alias("same"))


def _similar_to(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which sets are similar to x, all in order."""
    size = np.array([len(y) for y in others])
    y = np.concatenate(others)
    hit = x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y
    common = np.add.reduceat(hit, np.cumsum(size) - size, dtype=np.int64)
    return DEN * common >= NUM * (len(x) + size - common)


def _linked(batches: Iterable[pa.RecordBatch], block: int = 64) -> Iterator[pa.RecordBatch]:
    """Of cells the similar pairs that connect what is not connected yet."""
    for t in by_group(batches):
        node, seen, own, size, words = *(t[c].to_numpy() for c in ("node", "seen", "own", "size")), _words_of(t["bits"])
        shingles = [np.frombuffer(x, np.uint32) for x in t["shingles"].to_pylist()]
        label, same, found = t["root"].to_numpy().copy(), t["same"][0].as_py(), []
        table = PivotTable(np.ascontiguousarray(words[:, 0]), FAR)
        for i in range(len(node) - 1):
            y = np.arange(i + 1, len(node))
            y = y[(label[y] != label[i]) & (seen[y] != seen[i]) & (same | (own[y] != own[i]))]
            y = y[near(table, words[:, 1], np.full(len(y), i), y)] if len(y) else y
            y = y[may_be_similar(words[i], size[i], words[y], size[y])] if len(y) else y
            for at in range(0, len(y), block):
                z = y[at : at + block]
                z = z[label[z] != label[i]]
                for j in z[_similar_to(shingles[i], [shingles[k] for k in z])] if len(z) else ():
                    if label[j] != label[i]:
                        label[label == label[j]] = label[i]
                        found.append(sorted((int(node[i]), int(node[j]))))
        yield arrow(pa.schema([("a", pa.int64()), ("b", pa.int64())]), list(zip(*found, strict=True)) if found else [[], []])


def picked_sets(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """sets: node, shingles; wanted: distinct nodes. One row each of the wanted ones. A map of their nodes goes to where the sets are, so that few others are shuffled."""
    at = F.pmod("node", F.lit(MAP))
    word = wanted.select(F.floor(at / 32).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(pmod(node, {MAP}) % 32 as int))").alias("bit"))
    found = word.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    here = np.zeros(MAP // 32, np.uint32)
    here[found["word"].to_numpy()] = found["bits"].to_numpy().astype(np.uint32)
    here = here.tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.frombuffer(here, np.uint32)
        for b in batches:
            at = b["node"].to_numpy() % MAP
            yield b.filter(pa.array((words[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool)))

    return sets.select("node", "shingles").mapInArrow(run, "node long, shingles binary").join(wanted, "node").dropDuplicates(["node"])


def similar_links(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """nodes: node, size, bits, few; sets: node, shingles. (a, b), enough of the similar pairs of nodes to connect all that they connect.

    Nodes with a band of their SimHash in common are in one bucket. First each is compared with one of those that have
    two bands in common, another in each bucket, so that a large group is connected by links in its size. Then what may
    be similar but is not connected yet is told in each band's buckets: SimHash pivot tables and fingerprints discard
    rows, and the others are connected to clusters by links in their number, never by all their pairs. A cluster's
    nodes are compared where they meet, in cells, each with its shingles, and only the links that connect go out; this is done
    for a few bands first, so that a large group is told once and not in every band. In a
    bucket with over SLICE rows of a large root those of its commonest root are dealt out to slices, and the others go
    to all slices; so a large group that is connected but for a few is not compared with itself.
    """
    beside = lambda c: nodes.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("bits").alias(f"bits_{c}"))

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = checkpointed(pairs.distinct())
        pairs = checkpointed(pairs.join(beside("a"), "a").join(beside("b"), "b").mapInArrow(_alike, "a long, b long"))
        held = checkpointed(picked_sets(sets, pairs.select("a").union(pairs.select("b")).toDF("node").distinct()))
        links = pairs.join(held.toDF("a", "of_a"), "a").join(held.toDF("b", "of_b"), "b").select("a", "b", "of_a", "of_b")
        return checkpointed(links.mapInArrow(_verified, "a long, b long"))

    two = F.explode(F.array(*[F.xxhash64(F.lit(i), F.substring("bits", BAND // 4 * i + 1, BAND // 4)) for i in range(FIRST)])).alias("key")
    order = F.struct(F.xxhash64("key", "node").alias("order"), "node", "size")
    keyed = nodes.where("size > 0").select("node", "size", two).select("key", "node", "size", order.alias("lead"))
    small = nodes.select("node", "size", F.explode("few").alias("key")).select("key", "node", "size", F.struct(F.col("size").alias("order"), "node", "size").alias("lead"))
    keyed = keyed.union(small)
    many = checkpointed(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("lead").alias("lead")).where("n > 1").select("key", F.col("lead.node").alias("with"), F.col("lead.size").alias("of")))
    star = keyed.join(many, "key").where((F.col("with") != F.col("node")) & (DEN * F.least("size", "of") >= NUM * F.greatest("size", "of")))
    links = verified(star.select(F.least("with", "node").alias("a"), F.greatest("with", "node").alias("b")))

    label = components(links).withColumnRenamed("root", "of")
    rooted = nodes.where("size > 0").join(label, "node", "left").select("node", F.coalesce("of", "node").alias("root"), F.col("node").alias("seen"), "size", "bits")
    rooted = checkpointed(rooted)
    large = checkpointed(rooted.groupBy("root").count().where(f"count > {SLICE}").select("root"))
    for bands in (range(SOON), range(SOON, BANDS)):
        cluster = components(_in_bands(rooted, large, bands)).withColumnRenamed("root", "cluster")
        members = checkpointed(rooted.join(cluster, "node"))
        held = checkpointed(picked_sets(sets, members.select("node")).join(members.select("node", "size", "bits"), "node"))
        cells = in_cells(members.select("cluster", "node", "root", "seen")).join(held, "node").repartition("group").sortWithinPartitions("group", "node")
        links = links.union(checkpointed(cells.mapInArrow(_linked, "a long, b long")))
        if bands.stop < BANDS:
            rooted = checkpointed(rooted.join(cluster, "node", "left").withColumn("seen", F.coalesce("cluster", "seen")).drop("cluster"))
    return links


def similar_documents(df: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """One row per input row: __rid, doc_id, component_id, row: the first doc_id that its similar texts reach, and that row's key.

    A-Z is lower-cased, words are ``[^\\x20\\x09-\\x0D]+``, shingles are distinct, whole texts of any length are read.
    Texts of the same shingles are one node, as are null and empty texts; a null doc_id comes after all others; repeated
    rows are in one component; other columns are not looked at; an empty table gives an empty result. Shingles are
    compared by 32 bits of their hash.
    """
    rows = picked(df, doc_id=doc_id, text=text).withColumn(RID, row_key("doc_id", "text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    docs = checkpointed(rows.mapInArrow(_sketches(shingle_words), f"{RID} binary, doc_id {kind}, node long, size long, bits binary, few array<long>, shingles binary"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(RID).alias("row"))).alias("first")
    nodes = checkpointed(docs.groupBy("node").agg(first, F.first("size").alias("size"), F.first("bits").alias("bits"), F.first("few").alias("few")))
    links = similar_links(nodes.select("node", "size", "bits", "few"), docs.select("node", "shingles"))
    rooted = checkpointed(nodes.select("node", "first").join(components(links).withColumnRenamed("root", "of"), "node", "left").select("node", "first", F.coalesce("of", "node").alias("root")))
    best = checkpointed(rooted.groupBy("root").agg(F.min("first").alias("best")))  # so that the join can split a large component
    return docs.select(RID, "doc_id", "node").join(rooted.join(best, "root").select("node", "best"), "node").select(RID, "doc_id", F.col("best.id").alias("component_id"), "best.row")


def without_similar(df: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of df with the smallest doc_id of their similar texts, with all their columns."""
    kept = similar_documents(df, text, doc_id, shingle_words).where(F.col(RID) == F.col("row")).select(RID)
    return only(df, kept, doc_id, text)
