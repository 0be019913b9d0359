"""Byte-pair encoding as a bounded-lookahead streaming transducer, and decoding as a byte-to-text state machine."""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from hopwise.llm.common import as_bytes, picked, rows_at_a_time

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Bytes of text that are split into units at once; a longer run without white space is streamed in pieces of so many.
BLOCK = 1 << 18
PIECE = 1 << 14
#: Characters of a match of the pattern from which on it is not held until it ends, and first ones by which it is known then.
OPEN = 256
HEAD = 8
#: White-space-separated units and words of which a worker remembers the ids.
UNITS, WORDS = 600_000, 1_200_000

#: White space as the tokenizers library's patterns know it.
_SPACE = r"\t-\r \x85\xa0  -     　"


_BLANKS = [bytes([b]) for b in b" \t\n\r\x0b\x0c"]
_BLANK = regex.compile(rb"[ \t\n\r\x0b\x0c]")

#: Bits for a token id below a merge's rank, and a rank that no merge has.
_MADE = 24
_NONE = 1 << 60


@lru_cache(maxsize=1)
def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself if it is printable Latin-1, else the next one from U+0100 on."""
    plain = {b for b in range(256) if chr(b).isprintable() and not chr(b).isspace()}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


@lru_cache(maxsize=1)
def byte_values() -> dict[str, int]:
    return {c: b for b, c in enumerate(byte_alphabet())}


def sufficient_lookahead(merges: list[tuple[int, int, int]], length: list[int]) -> int | None:
    """Symbols to the right of a token's end after which nothing can change the token any more; None if no bound is known.

    merges: (left, right, made) in order. Compare a buffer with any continuation of it, merge by merge. Their first
    difference stands at the buffer's end and moves left only when a merge joins the token before it with a token that
    starts at it, by the length of the former. The token that starts there was then left operand or product of the
    merge that moved it last, or has grown from those as their leftmost part. So the moves are a chain of merges in
    order, each one's right operand having on its left spine the left operand or the product of the one before; the
    longest chain bounds the way. It needs a list in which a merge never comes before those of its operands.
    """
    born = {made: r for r, (_, _, made) in enumerate(merges)}
    if len(born) < len(merges):
        return None
    leftmost = {made: left for left, _, made in merges}
    reach: dict[int, int] = {}
    most = 0
    for r, (left, right, made) in enumerate(merges):
        if born.get(left, -1) >= r or born.get(right, -1) >= r:
            return None
        before, t = reach.get(right, 0), right
        while t in leftmost:
            t = leftmost[t]
            before = max(before, reach.get(t, 0))
        way = length[left] + before
        for t in (left, made):
            reach[t] = max(reach.get(t, 0), way)
        most = max(most, way)
    return most


class Encoder:
    """A tokenizer file's rules, applied to one white-space-free unit or one pattern match at a time."""

    def __init__(self, source: str) -> None:
        spec = json.loads(source)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            raise ValueError("only plain byte-level BPE files are read")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.whole = bool(model.get("ignore_merges"))
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        merges = [(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in pairs]
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.size = max([*self.vocab.values(), *added.values()]) + 1
        #: Pair -> rank of its merge, with what it makes in the lower bits.
        self.rank = {a * self.size + b: r << _MADE | made for r, (a, b, made) in reversed(list(enumerate(merges)))}
        self.text = [""] * self.size
        for t, i in [*self.vocab.items(), *added.items()]:
            self.text[i] = t
        self.length = [len(t.removesuffix(self.suffix)) if self.suffix else len(t) for t in self.text]
        self.lookahead = sufficient_lookahead(merges, self.length)
        alphabet = byte_alphabet()
        self.byte = [self.vocab[c] for c in alphabet]
        self.last_byte = [self.vocab[c + self.suffix] for c in alphabet]
        self.added = added
        self.specials = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self._rules(spec)
        self.transducer = Transducer(self)

    def _rules(self, spec: dict) -> None:
        parts = lambda x, many: [] if x is None else x[many] if x["type"] == "Sequence" else [x]
        self.steps, self.kinds = [], []
        for n in parts(spec.get("normalizer"), "normalizers"):
            self.kinds.append("Space" if n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} else n["type"])
            if n["type"] in ("NFC", "NFD", "NFKC", "NFKD"):
                self.steps.append(lambda s, form=n["type"]: unicodedata.normalize(form, s))
            elif n["type"] == "Lowercase":
                self.steps.append(lambda s: "".join([c.lower() for c in s]))  # each character alone, whatever stands beside it
            elif n["type"] == "Replace" and "Regex" in n["pattern"]:
                self.steps.append(lambda s, p=self._pattern(n["pattern"]["Regex"]), c=n["content"]: p.sub(lambda _: c, s))
            else:
                raise ValueError(f"unknown normalizer {n['type']}")
        split = None
        for p in parts(spec.get("pre_tokenizer"), "pretokenizers"):
            if p["type"] == "Split" and p["behavior"] == "Removed" and p["invert"]:
                split = p["pattern"]["Regex"]
            elif p["type"] == "ByteLevel" and not p["add_prefix_space"]:
                split = public_tokenizers.PATTERN if p.get("use_regex", True) else split
            else:
                raise ValueError(f"unknown pre-tokenizer {p['type']}")
        self.split = self._pattern(split)
        #: Whether white space only separates: then each unit between it is encoded alone.
        self.units = self.split.findall("a b\nc") == ["a", "b", "c"]
        #: Whether a match is a run of letters, a run of what is neither letter nor digit, or three characters at most.
        self.runs = self.units and split in (r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",) and self.kinds == ["NFC", "Space", "Lowercase"]

    @staticmethod
    def _pattern(p: str) -> regex.Pattern:
        inside = regex.sub(r"\[[^\]]*\]", lambda m: m[0].replace(r"\s", _SPACE).replace(r"\S", "\\S"), p)
        return regex.compile(regex.sub(r"\\s", f"[{_SPACE}]", inside).replace(r"\S", f"[^{_SPACE}]"))

    def merged(self, symbols: list[int]) -> list[int]:
        """Merge by rank, leftmost first, until nothing merges."""
        return self._few(symbols) if len(symbols) <= 24 else self._many(symbols)

    def _few(self, s: list[int]) -> list[int]:
        get, size = self.rank.get, self.size
        options = [get(a * size + b, _NONE) for a, b in zip(s, s[1:], strict=False)]
        while options and (best := min(options)) != _NONE:
            at, made = options.index(best), best & ((1 << _MADE) - 1)
            s[at : at + 2] = (made,)
            del options[at]
            if at:
                options[at - 1] = get(s[at - 1] * size + made, _NONE)
            if at < len(options):
                options[at] = get(made * size + s[at + 1], _NONE)
        return s

    def _many(self, s: list[int]) -> list[int]:
        get, size, n = self.rank.get, self.size, len(s)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(s, s[1:], strict=False)) if (r := get(a * size + b)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or s[i] != a or s[j] != b:
                continue
            s[i], s[j] = made, _ = r & ((1 << _MADE) - 1), -1
            after[i] = k = after[j]
            after[j] = -1
            if k >= 0:
                before[k] = i
                if (r := get(made * size + s[k])) is not None:
                    heapq.heappush(heap, (r, i, made, s[k]))
            if (h := before[i]) >= 0 and (r := get(s[h] * size + made)) is not None:
                heapq.heappush(heap, (r, h, s[h], made))
        return [x for x in s if x >= 0]

    def word(self, raw: bytes) -> list[int]:
        """Ids of one pattern match, through the transducer."""
        if self.whole and (i := self.vocab.get("".join(self.text[self.byte[b]] for b in raw) + self.suffix)) is not None:
            return [i]
        return self.transducer.word(raw)

    def segments(self, text: str) -> Iterator[str | int]:
        """The text between added tokens, and their ids."""
        at = 0
        if self.specials is not None:
            for m in self.specials.finditer(text):
                if m.start() > at:
                    yield text[at : m.start()]
                yield self.added[m[0]]
                at = m.end()
        if at < len(text):
            yield text[at:]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.segments(text):
            if isinstance(part, int):
                out.append(part)
                continue
            for step in self.steps:
                part = step(part)
            for m in self.split.finditer(part):
                if m[0]:
                    out += self.word(m[0].encode("utf-8"))
        return out


class Transducer:
    """Takes a word's bytes in pieces and returns its tokens once no further byte can change them; it holds the lookahead and two blocks of symbols at most.

    The last byte given is kept apart, as it may be the word's last, whose symbol is another.
    """

    BLOCK = 1024

    def __init__(self, encoder: Encoder) -> None:
        self.encoder, self.held, self.last = encoder, [], None

    def push(self, raw: bytes) -> list[int]:
        byte = self.encoder.byte
        if self.last is not None:
            self.held.append(byte[self.last])
        self.last = raw[-1]
        if len(raw) <= self.BLOCK:
            self.held += [byte[b] for b in raw[:-1]]
            return self._stable() if len(self.held) > self.BLOCK else []
        out = []
        for at in range(0, len(raw) - 1, self.BLOCK):
            self.held += [byte[b] for b in raw[at : min(at + self.BLOCK, len(raw) - 1)]]
            out += self._stable()
        return out

    def word(self, raw: bytes) -> list[int]:
        """The tokens of a whole word; one that the transducer could hold whole is not held first."""
        if len(raw) <= self.BLOCK and self.last is None:
            e = self.encoder
            byte = e.byte
            return e.merged([*[byte[b] for b in raw[:-1]], e.last_byte[raw[-1]]])
        return self.push(raw) + self.finish()

    def _stable(self) -> list[int]:
        ahead = self.encoder.lookahead
        if ahead is None or len(self.held) < ahead + self.BLOCK:
            return []
        tokens, end, n = self.encoder.merged(self.held[:]), 0, 0
        for t in tokens:
            if end + self.encoder.length[t] > len(self.held) - ahead:
                break
            end += self.encoder.length[t]
            n += 1
        self.held = self.held[end:]
        return tokens[:n]

    def finish(self) -> list[int]:
        """The tokens still held, as the word has ended."""
        held = self.held
        if self.last is not None:
            held.append(self.encoder.last_byte[self.last])
        self.held, self.last = [], None
        return self.encoder.merged(held)


@lru_cache(maxsize=1)
def joining() -> frozenset[str]:
    """Characters that may compose with what stands before them: combining ones, second ones of compositions, Hangul vowels and finals."""
    chars = [chr(i) for i in [*range(0x300, 0xAC00), *range(0xF900, 0x1F000)]]
    second = {d.split()[1] for c in chars if (d := unicodedata.decomposition(c)) and d[0] != "<" and " " in d}
    return frozenset(chr(int(x, 16)) for x in second) | {c for c in chars if unicodedata.combining(c)} | {chr(i) for i in range(0x1161, 0x1200)}


class TextStream:
    """Takes the bytes of a text in pieces and returns its ids once nothing that follows can change them.

    Held are at most a piece's rest that may still compose with what follows or begin an added token, the last match of
    the pattern while it is short, and what the transducer holds: constant memory, but for a run of combining characters.
    Only for files whose rules are `Encoder.runs`.
    """

    def __init__(self, encoder: Encoder) -> None:
        self.e, self.utf8 = encoder, codecs.getincrementaldecoder("utf-8")("replace")
        self.raw = self.pending = self.head = ""
        self.word = Transducer(encoder)

    def feed(self, piece: bytes, last: bool = False) -> list[int]:
        self.raw += self.utf8.decode(piece, last)
        cut = len(self.raw) if last else self._settled()
        part, self.raw = self.raw[:cut], self.raw[cut:]
        out: list[int] = []
        for segment in self.e.segments(part):
            if isinstance(segment, int):
                out += [*self._split("", True), segment]
            else:
                for step in self.e.steps:
                    segment = step(segment)
                out += self._split(segment, False)
        return out + self._split("", True) if last else out

    def _settled(self) -> int:
        """Up to where what follows changes neither the text's composition nor its added tokens."""
        cut = len(self.raw) - 1
        while cut > 0 and (self.raw[cut] in joining() or unicodedata.combining(self.raw[cut])):
            cut -= 1
        longest = max(map(len, self.e.added), default=0)
        for at in range(max(0, cut - longest + 1), cut):
            if any(t.startswith(self.raw[at:cut]) or self.raw.startswith(t, at) for t in self.e.added):
                return at
        return max(cut, 0)

    def _split(self, text: str, last: bool) -> list[int]:
        """The ids of the pattern's matches that are settled."""
        out, match, at = [], self.e.split, 0
        if self.head:
            m = match.match(self.head + text)
            at = max(0, m.end() - len(self.head)) if m else 0
            if at:
                out += self.word.push(text[:at].encode())
            if at == len(text) and not last:
                return out
            self.head = ""
            out += self.word.finish()
        text, self.pending = self.pending + text[at:], ""
        for m in match.finditer(text):
            size = m.end() - m.start()
            if last or m.end() + 3 <= len(text) or (size > HEAD and m.end() < len(text)):
                out += self.word.push(m[0].encode()) + self.word.finish() if size else []
            elif size > OPEN and m.end() == len(text):
                self.head = m[0][:HEAD]
                out += self.word.push(m[0].encode())
                break
            else:
                self.pending = text[m.start() :]
                break
        return out


class Decoder:
    """Ids to text, one at a time. Byte-level files go through an incremental UTF-8 decoder that holds at most three bytes; files without a decoder join their tokens by a space."""

    def __init__(self, encoder: Encoder, byte_level: bool) -> None:
        self.encoder, self.byte_level, self.begun = encoder, byte_level, False
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, token: int) -> str:
        text = self.encoder.text[token]
        if not self.byte_level:
            text, self.begun = " " * self.begun + text, True
            return text
        return self.state.decode(text.encode() if token in self.encoder.added.values() else bytes(map(byte_values().__getitem__, text)))

    def finish(self) -> str:
        return self.state.decode(b"", True)


@lru_cache(maxsize=4)
def encoder_of(source: str) -> Encoder:
    """One for each worker, whatever the number of tasks."""
    return Encoder(source)


class Remembered(dict):
    """Key -> what `made` gives for it. When full it becomes the older half of the memory, from which keys met again come back; so memory is bounded and common keys stay."""

    def __init__(self, made, most: int) -> None:
        self.made, self.most, self.older = made, most // 2, {}

    def __missing__(self, key: bytes):
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.made(key)
        if len(key) <= 64:
            self[key] = value
        return value

    def of(self, keys: list) -> list:
        got, i = [*map(self.get, keys)], -1
        for _ in range(got.count(None)):
            i = got.index(None, i + 1)
            got[i] = self[keys[i]]
        return got


def packed_ids(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class UnitEncoder:
    """Packed ids of a white-space-free unit. A word of letters is known by itself, so that punctuation and case beside it cost no second merge."""

    def __init__(self, encoder: Encoder, words: int = WORDS) -> None:
        self.encoder = encoder
        self.words = Remembered(lambda raw: packed_ids(encoder.word(raw)), words)
        #: The first byte of all added tokens, or none if they differ.
        first = {t.encode()[:1] for t in encoder.added}
        self.hint = first.pop() if len(first) == 1 else b""
        #: All that is done to a unit is to compose it and to lower-case it, and letters are one match.
        self.simple = encoder.runs
        self.form = "NFC"
        self.lower = "Lowercase" in encoder.kinds

    def __call__(self, unit: bytes) -> bytes:
        if not self.simple or (self.hint in unit and self.encoder.specials and self.encoder.specials.search(unit.decode("utf-8", "replace"))):
            return packed_ids(self.encoder.encode(unit.decode("utf-8", "replace")))
        if unit.isascii():
            if self.lower:
                unit = unit.lower()
            if unit.isalpha():
                return self.words[unit]
            return b"".join([self.words[m.encode()] for m in self.encoder.split.findall(unit.decode())])
        text = unit.decode("utf-8", "replace")
        if not unicodedata.is_normalized(self.form, text):
            text = unicodedata.normalize(self.form, text)
        if self.lower:
            text = text.lower() if "\u03a3" not in text else "".join([c.lower() for c in text])  # of all letters only this one looks at its neighbours
        if text.isalpha():
            return self.words[text.encode()]
        return b"".join([self.words[m.encode()] for m in self.encoder.split.findall(text)])


def unit_blocks(text: bytes) -> Iterator[list[bytes] | memoryview]:
    """The white-space-separated units of a text, a block's worth at a time; of a longer run without white space its bytes."""
    at, n = 0, len(text)
    while at < n:
        end = min(n, at + BLOCK)
        if end < n:
            cut = max(text.rfind(c, at, end) for c in _BLANKS)
            if cut < 0:
                m = _BLANK.search(text, end)
                end = m.start() if m else n
                yield memoryview(text)[at:end]
                at = end
                continue
            end = cut + 1
        yield text[at:end].split()
        at = end


def streamed(e: Encoder, run: memoryview) -> Iterator[list[int]]:
    """The ids of a run without white space, a piece at a time."""
    if not e.runs:
        yield e.encode(bytes(run).decode("utf-8", "replace"))
        return
    stream = TextStream(e)
    for at in range(0, len(run), PIECE):
        yield stream.feed(bytes(run[at : at + PIECE]), at + PIECE >= len(run))


def packed_parts(e: Encoder, known: Remembered, text: bytes) -> list[bytes]:
    """The packed ids of a text, in parts; known: a worker's memory of units."""
    if not e.units:
        return [packed_ids(e.encode(text.decode("utf-8", "replace")))]
    parts: list[bytes] = []
    for block in unit_blocks(text):
        parts += known.of(block) if isinstance(block, list) else map(packed_ids, streamed(e, block))
    return parts


_worker: dict = {}


def remembered(source: str, kind: str, made, units: int = UNITS) -> Remembered:
    """A worker's memory of so many units and twice as many words, kept from task to task; made: (encoder, packed ids) -> what is remembered of a unit."""
    key = (hash(source), kind, units)
    if key not in _worker:
        e = encoder_of(source)
        ids_of = UnitEncoder(e, units * WORDS // UNITS)
        _worker[key] = Remembered(lambda unit: made(e, ids_of(unit)), units)
    return _worker[key]


def spelled(e: Encoder, ids: Iterable[int], decoder: Decoder) -> tuple[int, bytes, bytes]:
    """How many ids, the ids as text, and what the decoder makes of them in its state."""
    ids = list(ids)
    return len(ids), " ".join(map(str, ids)).encode(), "".join(map(decoder.feed, ids)).encode()


def _remembered_spelling(e: Encoder, packed: bytes) -> tuple[int, bytes, bytes]:
    return spelled(e, struct.unpack(f"<{len(packed) // 4}I", packed), Decoder(e, False))


class Digests:
    """Digests of a text's ids and of what they decode to, fed part by part."""

    def __init__(self, decoder: Decoder) -> None:
        self.decoder, self.total, self.ids, self.back = decoder, 0, hashlib.sha256(), hashlib.sha256()

    def _add(self, n: int, ids: bytes, back: bytes) -> None:
        self.ids.update(b" " + ids if self.total else ids)
        self.back.update(back)
        self.total += n

    def feed(self, ids: list[int]) -> None:
        if ids:
            self._add(*spelled(self.decoder.encoder, ids, self.decoder))

    def feed_known(self, parts: list[tuple[int, bytes, bytes]]) -> None:
        """What a decoder that had not begun made of each part; it goes on from one to the next with a space, as this one does if it has begun."""
        got = [x for x in parts if x[0]]
        if got:
            back = b" ".join([x[2] for x in got])
            self._add(sum([x[0] for x in got]), b" ".join([x[1] for x in got]), b" " + back if self.decoder.begun else back)
            self.decoder.begun = True

    def result(self) -> tuple[int, str, str]:
        self.back.update(self.decoder.finish().encode())
        return self.total, self.ids.hexdigest(), self.back.hexdigest()


def digests(e: Encoder, byte_level: bool, known: Remembered, text: bytes) -> tuple[int, str, str]:
    """Of a text: by its units, if white space only separates and decoding joins tokens by a space, else as a whole."""
    d = Digests(Decoder(e, byte_level))
    if byte_level or not e.units:
        d.feed(e.encode(text.decode("utf-8", "replace")))
        return d.result()
    for block in unit_blocks(text):
        if isinstance(block, list):
            d.feed_known(known.of(block))
        else:
            for ids in streamed(e, block):
                d.feed(ids)
    return d.result()


def bpe_digests(df: DataFrame, path: str = TOKENIZER, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Each match of the file's pattern goes through the transducer, which emits tokens as they become stable, and their
    ids go through the decoder's state machine. In front of both, where the file drops white space, a worker remembers
    the units between white space that it meets, in bounded memory. A run of over BLOCK bytes without white space is
    streamed piece by piece; so beside the text itself memory is constant. A file that keeps white space has its texts
    encoded whole. Null texts are empty, with the digests of nothing; ids and other columns may be anything; an empty
    table gives an empty result. The file is read on the driver and its text sent along, as executors need not have it.
    """
    with open(path, encoding="utf-8") as f:
        source = f.read()
    spec = json.loads(source)
    byte_level = (spec.get("decoder") or {}).get("type") == "ByteLevel"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, known = encoder_of(source), remembered(source, "spelled", _remembered_spelling)
        for b in rows_at_a_time(batches):
            out = [digests(e, byte_level, known, t) for t in as_bytes(b["text"])]
            cols = [pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *cols], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = picked(df, doc_id=doc_id, text=text)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
