"""Quality: fixed rules with a hashed n-gram logistic regression, and a factorisation machine."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopwise.llm.common import as_bytes, picked, rows_at_a_time
from hopwise.llm.hashing import word_hashes

#: Labelled rows that a model is fitted on: so many of each class at most, the first ones by a seeded hash of doc_id.
SAMPLE_PER_CLASS = 1000
#: Texts of more bytes are not learnt from, so the sample on the driver has at most 2 * SAMPLE_PER_CLASS times as many. All texts are scored.
SAMPLE_BYTES = 1 << 17
SEED = 7

MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
WINDOW = 8
#: A text is kept if its calibrated probability of label 1 is at least this.
KEEP_AT = 0.5
#: The factorisation machine's predicted label is 1 from this score on.
PREDICT_AT = 0.3

_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_BLANKS = np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8)
_U = np.uint64


def repeated_words(h: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more; h: a 64-bit hash of each word. Windows are compared by a 64-bit hash."""
    n = len(h) - window + 1
    if n < 2:
        return 0
    w = np.zeros(n, _U)
    for i in range(window):
        w = w * _U(0x9E3779B97F4A7C15) + h[i : i + n]
    s = np.sort(w)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    found = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, w), len(twice) - 1)] == w)
    step = np.zeros(len(h) + 1, np.int64)
    np.add.at(step, found, 1)
    np.add.at(step, found + window, -1)
    return int((np.cumsum(step[:-1]) > 0).sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def byte_counts(text: bytes) -> tuple[int, int]:
    """Code points in words, and symbols."""
    by = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    return int(len(text) - by[0x80:0xC0].sum() - by[_BLANKS].sum()), int(by[_SYMBOLS].sum())


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int, learn=None) -> tuple[list[tuple], dict[int, int]]:
    """(text, n_chars, label) of at most per_class rows of each label, none of over SAMPLE_BYTES, and the number of rows with each label.

    docs: doc_id, text, n_chars; labels: doc_id, label. learn: which rows of labels may be learnt from.
    """
    one = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"))
    if learn is not None:
        one = one.where(learn)
    counts = {r[0]: r[1] for r in one.groupBy("label").count().collect()}
    order = [F.xxhash64(F.lit(SEED), "doc_id"), "doc_id"]
    few = one.where("label = 0").orderBy(*order).limit(per_class).union(one.where("label = 1").orderBy(*order).limit(per_class))
    short = docs.select("doc_id", "text", "n_chars").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES)
    rows = short.join(F.broadcast(few), "doc_id").dropDuplicates(["doc_id"]).collect()  # twice per_class rows at most
    rows.sort(key=lambda r: (crc32(str(r["doc_id"]).encode()), r["doc_id"]))
    return [(r["text"], r["n_chars"], int(r["label"])) for r in rows], counts


class NgramModel:
    """Logistic regression on the shares of hashed words, word pairs and character n-grams, calibrated by a sigmoid."""

    BITS = 17
    SIZES = (3, 4)
    #: Words, pairs of words, and n-grams of each size have their own weights.
    FAMILIES = 2 + len(SIZES)

    def __init__(self) -> None:
        self.w = np.zeros(self.FAMILIES << self.BITS, np.float32)
        self.bias, self.slope, self.shift = 0.0, 1.0, 20.0  # knows nothing: keeps everything

    def places(self, text: bytes, h: np.ndarray) -> list[np.ndarray]:
        """Where the weights of each family's members are, in the order of the text; h: its words' hashes."""
        out = [h >> _U(64 - self.BITS)]
        out.append((h[:-1] * _U(0xD6E8FEB86659FD93) + h[1:]) * _U(0x9E3779B97F4A7C15) >> _U(64 - self.BITS))
        c = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint32)
        for n in self.SIZES:
            g = np.zeros(max(0, len(c) - n + 1), np.uint32)
            for i in range(n):
                g = g * np.uint32(0x01000193) + c[i : i + len(g)]
            out.append(g * np.uint32(0x9E3779B1) >> np.uint32(32 - self.BITS))
        return [p.astype(np.int64) + (i << self.BITS) for i, p in enumerate(out)]

    def probability(self, text: bytes, h: np.ndarray) -> float:
        z = self.bias + sum(self.w[p].mean(dtype=np.float64) for p in self.places(text, h) if len(p))
        return float(1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -40, 40))))

    def features(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Each member's place and its share of its family."""
        found = [(*np.unique(p, return_counts=True), len(p)) for p in self.places(text, word_hashes(np.frombuffer(text, np.uint8)))]
        return np.concatenate([i for i, _, _ in found]), np.concatenate([(c / max(1, n)).astype(np.float32) for _, c, n in found])

    def fit(self, rows: list[tuple[bytes, int]], counts: dict[int, int], steps: int = 60, rate: float = 1.0, decay: float = 1e-6) -> NgramModel:
        """Every fourth row is left for the calibration, in which each class weighs as much as it has rows among all labels."""
        if len({y for _, y in rows}) < 2:
            return self
        train, held = [r for i, r in enumerate(rows) if i % 4], [r for i, r in enumerate(rows) if i % 4 == 0]
        if min(len({y for _, y in train}), len({y for _, y in held})) < 2:
            train = held = rows
        self.shift = 0.0
        x = [self.features(t) for t, _ in train]
        at, value = np.concatenate([i for i, _ in x]), np.concatenate([v for _, v in x])
        doc = np.repeat(np.arange(len(x)), [len(i) for i, _ in x])
        del x
        y = np.array([y for _, y in train], np.float64)
        share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
        w, m, s = np.zeros(len(self.w)), 0.0, 0.0
        bias = mb = sb = 0.0
        for t in range(1, steps + 1):
            z = bias + np.bincount(doc, w[at] * value, len(y))
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * share
            gw, gb = np.bincount(at, g[doc] * value, len(w)) + decay * w, g.sum()
            m, s = 0.9 * m + 0.1 * gw, 0.99 * s + 0.01 * gw * gw
            mb, sb = 0.9 * mb + 0.1 * gb, 0.99 * sb + 0.01 * gb * gb
            a, b = 1 - 0.9**t, 1 - 0.99**t
            w -= rate * (m / a) / (np.sqrt(s / b) + 1e-8)
            bias -= 0.05 * (mb / a) / (np.sqrt(sb / b) + 1e-8)
        self.w, self.bias = w.astype(np.float32), float(bias)
        self._calibrate(held, counts)
        return self

    def _calibrate(self, held: list[tuple[bytes, int]], counts: dict[int, int]) -> None:
        self.slope, self.shift = 1.0, 0.0
        p = np.array([self.probability(t, word_hashes(np.frombuffer(t, np.uint8))) for t, _ in held])
        z, y = np.log(np.clip(p, 1e-12, 1) / np.clip(1 - p, 1e-12, 1)), np.array([y for _, y in held], np.float64)
        n1, n0 = y.sum(), (1 - y).sum()
        weight = np.where(y == 1, counts.get(1, 1) / n1, counts.get(0, 1) / n0)
        weight = weight / weight.sum() * len(y)
        target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        design, v = np.stack([z, np.ones_like(z)], 1), np.array([1.0, 0.0])
        for _ in range(50):
            q = 1 / (1 + np.exp(-np.clip(design @ v, -40, 40)))
            hess = design.T * (weight * q * (1 - q)) @ design + 1e-3 * np.eye(2)
            step = np.linalg.solve(hess, design.T @ (weight * (q - target)) + 1e-3 * (v - [1.0, 0.0]))
            v = v - np.clip(step, -1, 1)
        self.slope, self.shift = float(max(v[0], 1e-3)), float(v[1])


def fit_ngram_model(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", per_class: int = SAMPLE_PER_CLASS) -> NgramModel:
    rows, counts = labelled_sample(
        picked(docs, doc_id=doc_id, text=text, n_chars=F.lit(0)), picked(labels, doc_id=doc_id, label=label), per_class
    )
    return NgramModel().fit([((t or "").encode(), y) for t, _, y in rows], counts)


def _ruled(text: bytes, model: NgramModel, keep_at: float) -> tuple:
    h = word_hashes(np.frombuffer(text, np.uint8))
    again = repeated_words(h)
    failed = len(h) < MIN_WORDS or 100 * again > MAX_REPEATED_PERCENT * len(h)
    p = model.probability(text, h)
    return len(h), *byte_counts(text), duplicate_lines(text), again, failed, p, not failed and p >= keep_at


def quality_rules(df: DataFrame, model: NgramModel, text: str = "text", doc_id: str = "doc_id", keep_at: float = KEEP_AT) -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, probability, kept.

    Words are ``[^\\x20\\x09-\\x0D]+``. base_failed: under 20 words, or over 30 % of them in repeated 8-word windows. The
    others are kept if the model's calibrated probability of quality is keep_at or more. A model fitted on no labels, or
    on one class, keeps them all. Null and empty texts have no words and fail; ids, null or repeated, are passed on;
    other columns are not looked at; an empty table gives an empty result. Whole texts of any length are scored, in Arrow
    batches, in memory that grows with the longest text.
    """
    rows = picked(df, doc_id=doc_id, text=text)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept"]
    types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_at_a_time(batches):
            out = [_ruled(t, model, keep_at) for t in as_bytes(b["text"])]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *[pa.array([x[i] for x in out], t) for i, t in enumerate(types)]], names=names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean")


def rule_keepers(df: DataFrame, model: NgramModel, text: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of df that the rules keep, with all their columns, in one pass."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_at_a_time(batches):
            yield b.filter(pa.array([_ruled(t, model, keep_at)[-1] for t in as_bytes(b[at])], pa.bool_()))

    at = df.columns.index(text)
    return df.mapInArrow(run, df.schema)


class FactorMachine:
    """score = sigmoid(w0 + sum w x + sum over pairs <v_i, v_j> x_i x_j), the last by half (|sum v x|^2 - sum |v|^2 x^2)."""

    BITS = 16
    FACTORS = 8
    BINS = 16
    STATS = 12

    def __init__(self) -> None:
        n = (1 << self.BITS) + self.STATS * self.BINS
        self.w0, self.w = 3.0, np.zeros(n, np.float32)
        self.v = np.random.default_rng(SEED).normal(0, 0.05, (n, self.FACTORS)).astype(np.float32)
        self.square = np.zeros(n, np.float32)

    def structure(self, text: bytes, n_words: int, n_distinct: int, n_chars: int) -> np.ndarray:
        """One feature for each statistic: the bin that it falls in. The last is metadata."""
        by = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        n = max(1, len(text) - int(by[0x80:0xC0].sum()))
        lines = int(by[10]) + 1
        logs = lambda x: min(self.BINS - 1, int(np.log2(1 + max(0, x))))
        part = lambda a, b: min(self.BINS - 1, int(self.BINS * (a / max(1, b)) ** 0.5))
        ends = by[[33, 44, 46, 58, 59, 63]].sum()
        bins = [
            logs(n_words), part(n_distinct, n_words), min(self.BINS - 1, int(n / max(1, n_words))), part(int(by[65:91].sum()), n), part(int(by[48:58].sum()), n),
            part(int(by[_SYMBOLS].sum()), n), part(int(by[33]), n), part(int(ends), n), part(duplicate_lines(text), lines), logs(n_words // lines),
            part(int(by[0xC0:].sum()), n), logs(n_chars),
        ]
        return (1 << self.BITS) + np.arange(self.STATS) * self.BINS + np.array(bins)

    def features(self, text: bytes, n_chars: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and values: the distinct hashed words, then the statistics; each kind has length 1."""
        h = word_hashes(np.frombuffer(text, np.uint8))
        at = np.unique(h >> _U(64 - self.BITS)).astype(np.int64)
        stats = self.structure(text, len(h), len(at), n_chars)
        return np.concatenate([at, stats]), np.concatenate([np.full(len(at), 1 / np.sqrt(max(1, len(at)))), np.full(len(stats), 1 / np.sqrt(len(stats)))])

    def score(self, at: np.ndarray, x: np.ndarray) -> float:
        q = x @ self.v[at]
        z = self.w0 + x @ self.w[at] + 0.5 * (q @ q - (x * x) @ self.square[at])
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    def fit(self, rows: list[tuple[bytes, int, int]], epochs: int = 12, batch: int = 100, rate: float = 0.02, decay: float = 1e-5) -> FactorMachine:
        """Adam on the log loss; each class weighs half."""
        y = np.array([r[2] for r in rows], np.float64)
        if len(set(y)) < 2:
            return self
        x = [self.features(t, n) for t, n, _ in rows]
        share = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y).mean())
        rng, n, k = np.random.default_rng(SEED), len(self.w), self.FACTORS
        p = np.zeros((n, k + 1))
        p[:, 1:] = self.v
        m, s, w0, t = np.zeros_like(p), np.zeros_like(p), 0.0, 0
        for _ in range(epochs):
            for rows_now in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
                at = np.concatenate([x[i][0] for i in rows_now])
                value = np.concatenate([x[i][1] for i in rows_now])[:, None]
                size = [len(x[i][0]) for i in rows_now]
                start = np.cumsum([0, *size[:-1]])
                px = p[at] * value
                q = np.add.reduceat(px, start, axis=0)
                z = w0 + q[:, 0] + 0.5 * ((q[:, 1:] ** 2).sum(1) - np.add.reduceat((px[:, 1:] ** 2).sum(1), start))
                g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[rows_now]) * share[rows_now] / len(rows_now)
                each = np.repeat(np.arange(len(size)), size)
                grad = value * np.repeat(q, size, axis=0)
                grad[:, 0] = value[:, 0]
                grad[:, 1:] -= px[:, 1:] * value
                grad *= g[each][:, None]
                gp = np.stack([np.bincount(at, grad[:, f], n) for f in range(k + 1)], 1) + decay * p
                t += 1
                m, s = 0.9 * m + 0.1 * gp, 0.999 * s + 0.001 * gp * gp
                p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
                w0 -= rate * g.sum()
        self.w0, self.w, self.v = float(w0), p[:, 0].astype(np.float32), p[:, 1:].astype(np.float32)
        self.square = (self.v**2).sum(1)
        return self


def held_out(doc_id: str = "doc_id"):
    """Rows that are never learnt from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit_factor_machine(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", n_chars: str = "n_chars", per_class: int = SAMPLE_PER_CLASS) -> FactorMachine:
    rows, _ = labelled_sample(
        picked(docs, doc_id=doc_id, text=text, n_chars=n_chars), picked(labels, doc_id=doc_id, label=label), per_class, learn=~held_out()
    )
    return FactorMachine().fit([((t or "").encode(), n if n is not None else len(t or ""), y) for t, n, y in rows])


def factor_scores(df: DataFrame, model: FactorMachine, text: str = "text", doc_id: str = "doc_id", n_chars: str = "n_chars", predict_at: float = PREDICT_AT) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Inputs of a score are the hashed words of the whole text, statistics of its structure and the n_chars column (the
    text's length where that is null); labels, language, source and doc_id are not. A machine fitted on no labels or on
    one class scores all texts alike, above predict_at. Whole texts of any length are scored. Null texts are empty; empty texts are scored by their structure;
    a null doc_id counts as an empty one for held_out; an empty table gives an empty result.
    """
    rows = picked(df, doc_id=doc_id, text=text, n_chars=F.coalesce(F.col(n_chars).cast("long"), F.length(text).cast("long"), F.lit(0).cast("long")), held_out=held_out(doc_id))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_at_a_time(batches):
            score = [model.score(*model.features(t, n)) for t, n in zip(as_bytes(b["text"]), b["n_chars"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], b["held_out"], pa.array(score, pa.float64()), pa.array([int(s >= predict_at) for s in score], pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
