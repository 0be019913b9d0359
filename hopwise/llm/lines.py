"""Substring deduplication by hashing lines, paragraphs, or lines broken anew by their content."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopwise.llm.common import RID, as_bytes, checkpointed, fresh, picked, row_key, rows_at_a_time
from hopwise.llm.hashing import blank_bytes

#: A text is broken before a word whose value is the least among so many words before it and after it.
REACH = 3
#: Lines broken in that way that make one unit.
LINES = 4
#: Words whose values a worker remembers.
KNOWN = 500_000

_PARAGRAPH = re.compile(rb"\n[\x20\t\r\x0b\x0c]*\n\s*")
_values: dict[bytes, int] = {}


def unit_spans(text: bytes, paragraphs: bool = False) -> Iterator[tuple[int, int]]:
    """Byte offsets of the lines, or of the paragraphs, of a text."""
    at = 0
    if paragraphs:
        for m in _PARAGRAPH.finditer(text):
            yield at, m.start()
            at = m.end()
    else:
        while (end := text.find(b"\n", at)) >= 0:
            yield at, end
            at = end + 1
    yield at, len(text)


def word_values(words: list[bytes]) -> np.ndarray:
    """The first 32 bits of each word's MD5."""
    if len(_values) > KNOWN:
        _values.clear()
    for w in words:
        if w not in _values:
            _values[w] = int.from_bytes(md5(w, usedforsecurity=False).digest()[:4], "big")
    return np.fromiter(map(_values.__getitem__, words), np.int64, len(words))


def breaks(words: list[bytes], reach: int = REACH) -> np.ndarray:
    """Words before which a line begins, the first one's and the end included.

    The value of a word is made of its own hash and of that of the word before. A line begins where it is less than the
    `reach` values before and not more than the `reach` after. So a break depends on the words around it alone: a
    passage is broken alike wherever it stands, and but for the ends of a text a line has more than `reach` words.
    """
    n = len(words)
    if not n:
        return np.zeros(1, np.int64)
    v = word_values(words)
    far = np.int64(1) << 32
    value = np.full(n + 2 * reach, far)
    value[reach + 1 : reach + n] = (5 * v[:-1] + 3 * v[1:]) % far
    own = value[reach : reach + n]
    least = own < far
    for d in range(1, reach + 1):
        least &= (own < value[reach - d : reach - d + n]) & (own <= value[reach + d : reach + d + n])
    return np.r_[0, np.flatnonzero(least), n]


def reflowed_units(text: bytes, reach: int = REACH, lines: int = LINES) -> Iterator[tuple[int, int, int, bytes]]:
    """(start and end in code points, words, digest) of each run of so many lines; a text with fewer is one unit."""
    words = text.lower().split()
    if not words:
        return
    data = np.frombuffer(text, np.uint8)
    blank = blank_bytes(data)
    edge = np.flatnonzero(np.diff(np.r_[True, blank, True]))  # start and end of each word
    inside = np.r_[(data & 0xC0) == 0x80, False]
    ahead = np.cumsum(np.add.reduceat(inside, edge, dtype=np.int64)[:-1])
    edge -= np.r_[0, ahead]
    starts, ends = edge[::2], edge[1::2]
    cut = breaks(words, reach)
    lines = min(lines, len(cut) - 1)
    norm = b" ".join(words)
    at = np.r_[0, np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)]
    first, last = cut[: len(cut) - lines], cut[lines:]
    for s, e, n, a, b in zip(starts[first].tolist(), ends[last - 1].tolist(), (last - first).tolist(), at[first].tolist(), (at[last] - 1).tolist(), strict=True):
        yield s, e, n, md5(norm[a:b], usedforsecurity=False).digest()


def written_units(text: bytes, paragraphs: bool) -> Iterator[tuple[int, int, int, bytes]]:
    """The same of each line, or paragraph, that the text itself has, if it has a word."""
    chars = at = 0
    for s, e in unit_spans(text, paragraphs):
        unit = text[s:e]
        chars += len(text[at:s].decode())
        length, at = len(unit.decode()), e
        if words := unit.lower().split():
            yield chars, chars + length, len(words), md5(b" ".join(words), usedforsecurity=False).digest()
        chars += length


def hashed_units(rows: DataFrame, units: str, keys_only: bool) -> DataFrame:
    """rows: __rid, doc_id, text. A row for each unit: the halves of its digest; without keys_only also its number, code point offsets and words. keys_only: the first half alone."""
    kinds = {"reflowed": reflowed_units, "lines": lambda t: written_units(t, False), "paragraphs": lambda t: written_units(t, True)}
    units_of, names = kinds[units], ["k", "rest", "unit", "start", "end", "n_words"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_at_a_time(batches):
            of, nth, found = [], [], []
            for i, t in enumerate(as_bytes(b["text"])):
                got = list(units_of(t))
                found += got
                of.append(np.full(len(got), i))
                nth.append(np.arange(len(got)))
            digest = np.frombuffer(b"".join([u[3] for u in found]), ">i8").astype(np.int64).reshape(-1, 2)
            if keys_only:
                yield pa.RecordBatch.from_arrays([pa.array(digest[:, 0])], names=["k"])
                continue
            at = pa.array(np.concatenate(of) if of else np.zeros(0, np.int64), pa.int64())
            number = pa.array(np.concatenate(nth) if nth else np.zeros(0, np.int64), pa.int64())
            own = [pa.array(digest[:, 0]), pa.array(digest[:, 1]), number, *[pa.array([u[c] for u in found], pa.int64()) for c in range(3)]]
            yield pa.RecordBatch.from_arrays([b[RID].take(at), b["doc_id"].take(at), *own], names=[RID, "doc_id", *names])

    if keys_only:
        return rows.select("text").mapInArrow(run, "k long")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"{RID} binary, doc_id {kind}, " + ", ".join(f"{n} long" for n in names))


def repeated_units(df: DataFrame, text: str = "text", doc_id: str = "doc_id", units: str = "reflowed") -> DataFrame:
    """One row per unit that goes: __rid, doc_id, unit, start, end, n_words, digest, first_doc_id, first_start.

    Units are normalised (A-Z lower-cased, white space to one space, trimmed) and their digests grouped over the whole
    table; the occurrence of smallest doc_id, then earliest in its text, stays, the others go. start and end are code
    point offsets in the original text. units: `lines` or `paragraphs` as the text has them, or `reflowed`: the text is
    broken into lines anew, where its words say so (`breaks`), and each LINES of them in a row are a unit; so a passage
    is found wherever it begins and ends in a line. Such units overlap, and what goes is what they cover. No unit is
    left out for its size. Whatever goes has an equal earlier occurrence, so of each text that repeats one copy stays.

    First the digests' halves alone are counted; the units of those that occur twice are joined with them, in a join
    whose large keys can be split, and whole digests decide. So a very common unit is no burden on one task.

    Null and empty texts have no units; a text of any length is read whole, in memory that grows with it; a null doc_id
    ranks last; rows alike in doc_id and text are one occurrence; other columns are not looked at; an empty table gives
    an empty result.
    """
    rows = picked(df, doc_id=doc_id, text=text).withColumn(RID, row_key("doc_id", "text"))
    twice = checkpointed(hashed_units(rows, units, True).groupBy("k").count().where("count > 1").select("k"))
    found = checkpointed(hashed_units(rows, units, False).join(twice, "k"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(RID).alias("row"), F.col("start").alias("start"))
    first = checkpointed(found.groupBy("k", "rest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("k", "rest", "first"))
    gone = (F.col(RID) != F.col("first.row")) | (F.col("start") != F.col("first.start"))
    half = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return found.join(first, ["k", "rest"]).where(gone).select(
        RID, "doc_id", "unit", "start", "end", "n_words", F.concat(half("k"), half("rest")).alias("digest"), F.col("first.id").alias("first_doc_id"), F.col("first.start").alias("first_start")
    )


def without_repeated_units(df: DataFrame, text: str = "text", doc_id: str = "doc_id", units: str = "reflowed") -> DataFrame:
    """df with the repeated units taken out of its texts, and removed_spans, the [start, end) of the runs in the original text that they covered."""
    key, said = fresh(df, RID), fresh(df, "removed_spans")
    gone = repeated_units(df, text, doc_id, units).groupBy(F.col(RID).alias(key)).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias(said))
    span = "struct<start: long, end: long>"
    grown = lambda last, s: F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
    joined = lambda done, s: F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown(F.element_at(done, -1), s)))
    step = lambda done, s: F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= s["start"]), joined(done, s)).otherwise(F.concat(done, F.array(s)))
    gone = gone.withColumn(said, F.aggregate(said, F.array().cast(f"array<{span}>"), step))
    keyed = df.withColumn(key, row_key(doc_id, text)).join(gone, key, "left").drop(key)
    body = F.col(f"`{text}`")
    piece = lambda at, n: F.substring(body, (at + 1).cast("int"), n.cast("int"))
    cut = F.aggregate(
        said,
        F.struct(F.lit("").alias("kept"), F.lit(0).cast("long").alias("at")),
        lambda a, s: F.struct(F.concat(a["kept"], piece(a["at"], s["start"] - a["at"])).alias("kept"), F.least(s["end"] + 1, F.length(body).cast("long")).alias("at")),
        lambda a: F.concat(a["kept"], piece(a["at"], F.length(body))),
    )
    return keyed.withColumn(text, F.when(F.col(said).isNull(), body).otherwise(cut))
