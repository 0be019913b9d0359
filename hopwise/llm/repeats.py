"""Repeated substrings: a sampled suffix array whose common-prefix interval tree gives maximal repeats with all occurrences."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopwise.llm.common import RID, as_bytes, checkpointed, fresh, picked, row_key, rows_at_a_time
from hopwise.llm.hashing import mixed, powers, running

#: Bytes that a repeat must have, and bytes of the string that anchors it.
LENGTH = 200
ANCHOR = 64
#: Bytes of text whose anchors are sought at once.
PIECE_BITS = 20
#: Distinct segments of one anchor string that a task puts into a suffix array; strings with more are counted window by window.
ARRAY = 8192

_U = np.uint64


class Anchors:
    """Finds anchors: in each string of LENGTH bytes the ANCHOR-byte string of least hash, the leftmost of equals.

    Equal strings have equal anchors at equal places, so repeats meet at their anchors. The strings with the same anchor
    start in one run; from the first one's start to the last one's end is the anchor's segment.
    """

    def __init__(self, length: int = LENGTH, anchor: int = ANCHOR) -> None:
        self.length, self.anchor = length, anchor

    def find(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """data: texts end to end, at most a piece; size: their bytes. Gives of each anchor: text, place in it, bytes of the segment before and from the anchor on, hash of the anchor string."""
        n, k = len(data), self.anchor
        w = self.length - k + 1
        if n < self.length:
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, _U))
        sums = running(data)
        h = mixed((sums[k:] - sums[:-k]) * powers(n + 1)[1][: n - k + 1])
        low = _U((1 << PIECE_BITS) - 1)
        m, step = (h & ~low) | np.arange(len(h), dtype=_U), 1
        while 2 * step <= w:
            m = np.minimum(m[:-step], m[step:])
            step *= 2
        if step < w:
            m = np.minimum(m[: len(m) - (w - step)], m[w - step :])
        starts = np.maximum(size - self.length + 1, 0)
        inside = np.repeat(np.tile([True, False], len(size)), np.stack([starts, size - starts], 1).ravel())[: n - self.length + 1]
        s = np.flatnonzero(inside)
        a = (m[s] & low).astype(np.int64)
        first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
        last = np.r_[first[1:], len(a)] - 1 if len(a) else first
        at, lo, hi = a[first], s[first], s[last] + self.length
        left, right = at - lo, hi - at
        begin = np.cumsum(size) - size
        text = np.searchsorted(begin, at, "right") - 1
        text = np.maximum(text, 0)
        return text, at - begin[text], left, right, h[at]


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, list[int], list[int]]]:
    """Texts end to end, up to a piece at once: the texts and where in them each part begins. A longer text comes in parts that share length - 1 bytes, so that each string of that length is in one part."""
    most = 1 << PIECE_BITS
    part: list[bytes] = []
    of: list[int] = []
    begin: list[int] = []
    held = 0
    for i, t in enumerate(texts):
        if len(t) < length:
            continue
        for at in range(0, max(1, len(t) - length + 1), most - length + 1):
            p = t[at : at + most]
            if held + len(p) > most and part:
                yield part, of, begin
                part, of, begin, held = [], [], [], 0
            part.append(p)
            of.append(i)
            begin.append(at)
            held += len(p)
    if part:
        yield part, of, begin


def segment_digest(segment: bytes, before: int) -> int:
    """64 bits of BLAKE2b of a segment and of where its anchor is, signed."""
    return int.from_bytes(blake2b(segment, digest_size=8, salt=before.to_bytes(4, "little")).digest(), "little", signed=True)


def anchor_rows(rows: DataFrame, length: int, anchor: int, key: str = "", text: str = "text") -> DataFrame:
    """One row for each anchor: its string's hash k, and with a key column also __rid, pos, before, after, seg."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Anchors(length, anchor)
        for b in rows_at_a_time(batches):
            for part, of, begin in _pieces(as_bytes(b["text"]), length):
                data = b"".join(part)
                size = np.array([len(p) for p in part])
                at, pos, left, right, k = finder.find(np.frombuffer(data, np.uint8), size)
                if not key:
                    yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64))], names=["k"])
                    continue
                place = pos + (np.cumsum(size) - size)[at]
                seg = [segment_digest(data[p - l : p + r], l) for p, l, r in zip(place.tolist(), left.tolist(), right.tolist(), strict=True)]
                arrays = [pa.array(k.view(np.int64)), pa.array(seg, pa.int64()), pa.array(pos + np.array(begin)[at]), pa.array(left), pa.array(right), b[RID].take(pa.array(np.array(of)[at]))]
                yield pa.RecordBatch.from_arrays(arrays, names=["k", "seg", "pos", "before", "after", RID])

    if not key:
        return picked(rows, text=text).mapInArrow(run, "k long")
    return picked(rows, text=text, **{RID: key}).mapInArrow(run, f"k long, seg long, pos long, before long, after long, {RID} binary")


def _common(a: bytes, b: bytes) -> int:
    """Bytes that two strings share from the start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n - 1
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """The common-prefix intervals (length, first, last) of sorted suffixes by one scan with a stack, inner ones first; lcp[i]: bytes that suffixes i and i + 1 share."""
    stack = [(0, 0)]
    for i, x in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] > x:
            length, first = stack.pop()
            if length > 0 and i > first:
                yield length, first, i
        if x >= 0 and (not stack or stack[-1][0] < x):
            stack.append((x, first))


def maximal_repeats(segments: list[tuple[bytes, int]], length: int = LENGTH) -> Iterator[tuple[int, int, list[int]]]:
    """Of distinct segments (bytes, place of the anchor) with one anchor string: (bytes before the anchor, bytes from it on, members) of each repeat that can be extended neither way.

    The suffixes from the anchor on are sorted; each of their common-prefix intervals is a set with the same bytes from
    the anchor on. What its members share to the left is found likewise from their left contexts, spelt backwards. A set
    is reported if its members differ at the next byte on the left and, as it lies in no inner interval, on the right.
    """
    right = [s[at:] for s, at in segments]
    left = [s[:at][::-1] for s, at in segments]
    array = sorted(range(len(segments)), key=right.__getitem__)
    lcp = [_common(right[a], right[b]) for a, b in zip(array, array[1:], strict=False)]
    for after, first, last in intervals(lcp):
        if after + max(map(len, (left[i] for i in array[first : last + 1]))) < length:
            continue
        place = {i: p for p, i in enumerate(array[first : last + 1], first)}
        members = sorted(place, key=left.__getitem__)
        shared = [_common(left[a], left[b]) for a, b in zip(members, members[1:], strict=False)]
        for before, lo, hi in [*intervals(shared), (0, 0, len(members) - 1)]:
            group = members[lo : hi + 1]
            if before + after < length or (before == 0 and shared and min(shared) > 0):
                continue
            at = sorted(place[i] for i in group)
            if min(lcp[at[0] : at[-1]]) == after:
                yield before, after, group


def _arrays(length: int, groups: bool):
    """mapInArrow over segments sorted by anchor string: what each is repeated for around its anchor, or the groups."""
    names = ["k", "seg", "before", "after"] + ["nth"] * groups

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done(rows: list[tuple]) -> pa.RecordBatch:
            out, at = [], 0
            while at < len(rows):
                end = at + 1
                while end < len(rows) and rows[end][0] == rows[at][0]:
                    end += 1
                some = list({r[1]: r for r in rows[at:end]}.values())  # repeated rows of a table bring a segment twice
                best: dict[int, tuple[int, int]] = {}
                for nth, (before, after, members) in enumerate(maximal_repeats([(r[3], r[2]) for r in some], length)):
                    for i in members:
                        if groups:
                            out.append((some[i][0], some[i][1], before, after, nth))
                        else:
                            b, a = best.get(i, (0, 0))
                            best[i] = (max(b, before), max(a, after))
                out += [(some[i][0], some[i][1], b, a) for i, (b, a) in best.items()]
                at = end
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(len(names))], names=names)

        for b in batches:
            held += zip(*(b[c].to_pylist() for c in ("k", "seg", "before", "bytes")), strict=True)
            cut = len(held)
            while cut and held[cut - 1][0] == held[-1][0]:
                cut -= 1
            if cut:
                yield done(held[:cut])
                held = held[cut:]
        yield done(held)

    return run, ", ".join(f"{n} long" for n in names)


def _windows(length: int):
    """Every string of that length in a segment, as the bytes it has before the anchor and 128 bits of hash."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_at_a_time(batches):
            k, seg, off, digest = [], [], [], []
            for kk, ss, at, s in zip(*(b[c].to_pylist() for c in ("k", "seg", "before", "bytes")), strict=True):
                for i in range(len(s) - length + 1):
                    k.append(kk)
                    seg.append(ss)
                    off.append(at - i)
                    digest.append(hashlib.blake2b(s[i : i + length], digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(seg, pa.int64()), pa.array(off, pa.int64()), pa.array(digest, pa.binary())], names=["k", "seg", "off", "digest"])

    return run, "k long, seg long, off long, digest binary"


def _cut_out(text_column: str, need_column: str):
    """Of documents with the list of their wanted segments: a row for each, with its bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_at_a_time(batches):
            rows = []
            for text, need in zip(as_bytes(b[text_column]), b[need_column].to_pylist(), strict=True):
                rows += [(x["k"], x["seg"], x["before"], text[x["pos"] - x["before"] : x["pos"] + x["after"]], x["kinds"]) for x in need]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["k", "seg", "before", "bytes", "kinds"])

    return run, "k long, seg long, before long, bytes binary, kinds long"


class Repeats:
    """The repeats of one table; the steps are lazy but for the tables of anchors that occur twice."""

    def __init__(self, rows: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, key: str = RID, text: str = "text") -> None:
        """rows: a key column, binary, a text column and any others."""
        if not 0 < anchor <= length < 1 << PIECE_BITS:
            raise ValueError("0 < anchor <= length is needed")
        self.rows, self.length, self.key, self.text = rows, length, key, text
        twice = checkpointed(anchor_rows(rows, length, anchor, text=text).groupBy("k").count().where("count > 1").select("k"))  # so that the join can split a common anchor
        self.found = checkpointed(anchor_rows(rows, length, anchor, key, text).join(twice, "k"))
        self.segments = self.found.groupBy("k", "seg").agg(F.count("*").alias("n"), F.min(F.struct(RID, "pos", "before", "after")).alias("one"))

    def joined(self, lists: DataFrame, name: str) -> DataFrame:
        """All rows, with all their columns and the lists (__rid, name) of those that have one. Every such join reads one exchange of the texts, as no column is left out on the way."""
        named = fresh(self.rows, name)
        return self.rows.join(lists.toDF(self.key, named), self.key, "left")

    def contexts(self) -> DataFrame:
        """(k, seg, before, bytes, kinds) of the segments whose anchor string has several, unless all of these are repeated whole."""
        kinds = self.segments.groupBy("k").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1").select("k", "kinds")
        need = self.segments.join(kinds, "k").select("one.*", "k", "seg", "kinds")
        need = need.groupBy(RID).agg(F.collect_list(F.struct("k", "seg", "pos", "before", "after", "kinds")).alias("need"))
        held = self.joined(need, "need")
        run, schema = _cut_out(self.text, held.columns[-1])
        return held.where(F.col(held.columns[-1]).isNotNull()).mapInArrow(run, schema)

    def _arrays(self, contexts: DataFrame, groups: bool) -> DataFrame:
        run, schema = _arrays(self.length, groups)
        return contexts.where(f"kinds <= {ARRAY}").drop("kinds").repartition("k").sortWithinPartitions("k", "seg").mapInArrow(run, schema)

    def _windows(self, contexts: DataFrame) -> DataFrame:
        """(k, seg, off, digest) of every repeated string of that many bytes around the anchor strings with over ARRAY segments."""
        run, schema = _windows(self.length)
        windows = contexts.where(f"kinds > {ARRAY}").drop("kinds").dropDuplicates(["k", "seg"]).mapInArrow(run, schema)
        twice = windows.groupBy("digest", "off").count().where("count > 1").select("digest", "off")
        return windows.join(twice, ["digest", "off"])

    def groups(self) -> DataFrame:
        """One row per occurrence of each maximal repeat: k and nth name the group, start and size the occurrence in bytes.

        Repeats are told within segments, of at most 2 * length - anchor bytes: a longer one is a chain of overlapping
        groups. Segments that occur twice or more are groups of their own. Around an anchor string with over ARRAY
        different segments, which no task holds together, each set of segments that share a string of `length` bytes is
        a group, over all bytes of the strings that this very set shares.
        """
        contexts = checkpointed(self.contexts())
        inner = self._arrays(contexts, True)
        whole = self.segments.where("n > 1").select("k", "seg", F.col("one.before").alias("before"), F.col("one.after").alias("after"), F.xxhash64("seg").alias("nth"))
        windows = checkpointed(self._windows(contexts))
        sets = windows.groupBy("k", "off", "digest").agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(seg, 1))").alias("x"), F.expr("bit_xor(xxhash64(seg, 2))").alias("y"))
        hot = windows.join(sets.select("k", "off", "digest", F.xxhash64("n", "x", "y").alias("nth")), ["k", "off", "digest"])
        hot = hot.groupBy("k", "seg", "nth").agg(F.max("off").alias("before"), (self.length - F.min("off")).alias("after")).select("k", "seg", "before", "after", "nth")
        said = inner.union(whole).union(hot).withColumnsRenamed({"before": "b", "after": "a"})
        return self.found.join(said, ["k", "seg"]).select("k", "nth", RID, (F.col("pos") - F.col("b")).alias("start"), (F.col("a") + F.col("b")).alias("size"))

    def reach(self) -> DataFrame:
        """(k, seg, b, a): of each segment, the bytes before its anchor and from it on that repeats cover.

        A segment that occurs twice is covered whole. The others of an anchor string share a suffix array with all its
        segments. All repeats in a segment hold its anchor, so their union is one run.
        """
        whole = self.segments.where("n > 1").select("k", "seg", F.col("one.before").alias("b"), F.col("one.after").alias("a"))
        contexts = self.contexts()
        inner = self._arrays(contexts, False).toDF("k", "seg", "b", "a")
        many = self._windows(contexts).groupBy("k", "seg").agg(F.max("off").alias("b"), (self.length - F.min("off")).alias("a"))
        return whole.union(inner).union(many).groupBy("k", "seg").agg(F.max("b").alias("b"), F.max("a").alias("a"))

    def spans(self) -> DataFrame:
        """(__rid, spans): of each row with repeats, the overlapping byte runs [start, end) that they cover."""
        run = F.struct((F.col("pos") - F.col("b")).alias("start"), (F.col("pos") + F.col("a")).alias("end"))
        return self.found.join(self.reach(), ["k", "seg"]).groupBy(RID).agg(F.collect_set(run).alias("spans"))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs."""
    out: list[list[int]] = []
    for s, e in sorted((x["start"], x["end"]) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def without(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for s, e in runs:
        kept.append(text[at:s])
        at = e
    return b"".join([*kept, text[at:]])


def whole_characters(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs without the parts of characters at their ends."""
    inside = lambda i: i < len(text) and 0x80 <= text[i] < 0xC0
    out = []
    for s, e in runs:
        while s < e and inside(s):
            s += 1
        while e > s and inside(e):
            e -= 1
        if e > s:
            out.append((s, e))
    return out


def remove_repeats(df: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and spans, the removed byte runs.

    Every byte is removed that a string of that many bytes covers which also starts anywhere else, in the same text
    or another; all are judged on the input and no string spans two texts. Texts longer than a piece are searched in parts
    that overlap. Null and empty texts have no bytes and keep
    the digest of nothing; rows repeated whole are repeats of each other, as are equal texts of that length; a doc_id may
    be null or shared; other columns are not looked at; an empty table gives an empty result.
    """
    rows = picked(df, doc_id=doc_id, text=text).withColumn(RID, row_key("doc_id", "text"))
    repeats = Repeats(rows, length, anchor)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in rows_at_a_time(batches):
            out = []
            for t, found in zip(as_bytes(b["text"]), b["spans"].to_pylist(), strict=True):
                runs = merged(found)
                out.append((len(t), sum(e - s for s, e in runs), len(runs), hashlib.sha256(without(t, runs)).hexdigest(), [{"start": s, "end": e} for s, e in runs]))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), span]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *[pa.array([r[i] for r in out], t) for i, t in enumerate(types)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    joined = repeats.joined(repeats.spans(), "spans")
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>")


def trimmed(df: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """df with the repeats taken out of its texts, whole characters only, and n_chars, if it has one, counted anew."""
    key, at = fresh(df, RID), df.columns.index(text)
    repeats = Repeats(df.withColumn(key, row_key(doc_id, text)), length, anchor, key, text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_at_a_time(batches):
            b = b.select([*df_columns, said])
            old, found = b.column(at), b.column(b.num_columns - 1).to_pylist()
            new = [x if s is None else without(t, whole_characters(t, merged(s))).decode() for x, t, s in zip(old.to_pylist(), as_bytes(old), found, strict=True)]
            cols = [pa.array(new, pa.string()) if i == at else c for i, c in enumerate(b.columns[:-1])]
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names[:-1])

    joined = repeats.joined(repeats.spans(), "__spans")
    df_columns, said = df.columns, joined.columns[-1]
    out = joined.mapInArrow(run, df.schema)
    return out.withColumn("n_chars", F.coalesce(F.length(f"`{text}`"), F.lit(0)).cast(df.schema["n_chars"].dataType)) if "n_chars" in df.columns else out
