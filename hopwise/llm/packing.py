"""Bounded-space online packing of token sequences."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from zlib import crc32

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopwise.llm.bpe import TOKENIZER, UNITS, encoder_of, packed_ids, packed_parts, remembered
from hopwise.llm.common import as_bytes, checkpointed, picked, rows_at_a_time

#: Tokens of a sequence, and the id that ends a document.
SIZE = 2048
END_ID = 1
#: Windows that a task holds open, and tasks whose leftovers meet in one task of the next round.
OPEN = 128
MEET = 16


class BoundedPacker:
    """At most `most` open windows. A piece goes to the window that it leaves least room in; when none fits and no more may be opened, the fullest is emitted."""

    def __init__(self, size: int = SIZE, most: int = OPEN) -> None:
        self.size, self.most, self.opened = size, most, 0
        self.room: list[tuple[int, int]] = []  # (room left, window), sorted
        self.windows: dict[int, list] = {}

    def add(self, piece, length: int) -> list[list]:
        """Returns the pieces of each window that is emitted."""
        out = []
        at = bisect_left(self.room, (length, -1))
        if at < len(self.room):
            room, w = self.room.pop(at)
        else:
            if len(self.room) == self.most:
                out.append(self.windows.pop(self.room.pop(0)[1]))
            room, w, self.opened = self.size, self.opened, self.opened + 1
            self.windows[w] = []
        self.windows[w].append(piece)
        if room == length:
            out.append(self.windows.pop(w))
        else:
            insort(self.room, (room - length, w))
        return out

    def rest(self) -> list[list]:
        """The windows still open."""
        return list(self.windows.values())


_COLUMNS = {"start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64(), "part": pa.int64()}


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    """Rows of (doc_id, *_COLUMNS)."""
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate([kind, *_COLUMNS.values()])], names=["doc_id", *_COLUMNS])


def _numbered(windows: Iterable[list], first: int, part: int, closed: bool) -> Iterator[tuple]:
    """Rows of the pieces of windows; open ones have no sequence yet."""
    for n, w in enumerate(windows, first):
        offset = 0
        for doc_id, start, length, crc, total in w:
            yield doc_id, start, length, crc, total, n if closed else None, offset if closed else None, part
            offset += length


def packed(df: DataFrame, path: str = TOKENIZER, size: int = SIZE, end_id: int = END_ID, most: int = OPEN, text: str = "text", doc_id: str = "doc_id", remember: int = UNITS) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and end_id. While it has a whole sequence left, that is a piece and a sequence of its own; the
    rest goes to the best-fitting open window of its task, without a further cut. What is open at the end of each task
    meets in rounds: the pieces of MEET tasks, largest first, are packed again in one, with as many open windows, until
    one task is left. So a task never holds more than MEET times `most` windows' pieces.

    remember: units of which a worker keeps the ids, which costs memory and saves time; results are the same.

    A text of any length is encoded whole and cut into as many pieces as it needs. Null and empty texts are one piece of one id; doc_ids may be null or repeated, each row being packed by itself; an
    empty table gives an empty result; other columns are not looked at. Sequences are padded to `size` by the writer.
    """
    with open(path, encoding="utf-8") as f:
        source = f.read()
    rows = picked(df, doc_id=doc_id, text=text)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part long"

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, packer, n, kind = TaskContext.get().partitionId(), BoundedPacker(size, most), 0, None
        end, e, known = packed_ids([end_id]), encoder_of(source), remembered(source, "ids", lambda _, packed: packed, remember)
        for b in rows_at_a_time(batches):
            kind, out = b["doc_id"].type, []
            for doc, t in zip(b["doc_id"].to_pylist(), as_bytes(b["text"]), strict=True):
                ids = b"".join([*packed_parts(e, known, t), end])
                total = len(ids) // 4
                for start in range(0, total, size):
                    length = min(size, total - start)
                    piece = (doc, start, length, crc32(ids[4 * start : 4 * (start + length)]), total)
                    windows = [[piece]] if length == size else packer.add(piece, length)
                    out += _numbered(windows, (part << 32) + n, part, True)
                    n += len(windows)
            yield _batch(out, kind)
        if kind is not None:
            yield _batch(list(_numbered(packer.rest(), 0, part, False)), kind)

    def again(nth: int, last: bool):
        def run(table: pa.Table) -> pa.Table:
            kind, part = table["doc_id"].type, table["part"][0].as_py() // MEET
            pieces = sorted(zip(*(table[c].to_pylist() for c in ["doc_id", *list(_COLUMNS)[:4]]), strict=True), key=lambda p: (-p[2], str(p[0]), p[1], p[3]))
            packer = BoundedPacker(size, most)
            windows = [w for p in pieces for w in packer.add(p, p[2])]
            begin = (nth << 57) + (part << 32)
            out = list(_numbered(windows + packer.rest() if last else windows, begin, part, True))
            if not last:
                out += _numbered(packer.rest(), 0, part, False)
            return pa.Table.from_batches([_batch(out, kind)])

        return run

    pieces = checkpointed(rows.mapInArrow(first, schema))
    result = pieces.where("sequence_id is not null")
    left, nth = pieces.where("sequence_id is null"), 0
    parts = left.agg(F.max("part")).first()[0]
    while parts is not None:
        nth, parts = nth + 1, parts // MEET
        met = left.groupBy(F.expr(f"part div {MEET}")).applyInArrow(again(nth, parts == 0), schema)
        if parts:
            met = checkpointed(met)
        result = result.union(met.where("sequence_id is not null"))
        left = met.where("sequence_id is null")
        parts = parts or None
    return result.drop("part")
