"""Quality rules: base counts of every text, and a calibrated classifier on hashed character and word n-grams."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfrank.llm.common import in_turn, ship, shingle_hashes, texts, word_bounds, word_hashes

#: Fixed values of the base rule.
MIN_WORDS = 50
REPEATED_PERCENT = 50
SYMBOLS = b"#*$%&|<>"

#: A text is kept if its calibrated probability of good quality is at least this.
THRESHOLD = 0.5

#: Hash bins of each of the two families of n-grams.
BINS = 2048

#: At most so many labelled rows are fitted, the first by the hash of their ids.
LABELLED_ROWS = 2000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


@dataclass
class Model:
    """Weights of the hashed n-grams, and the line that turns a score into log-odds."""

    weights: np.ndarray
    slope: float
    offset: float

    def probability(self, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * (x @ self.weights) + self.offset, -60, 60))))


def features(data: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Two parts, each of unit length or zero: roots of the counts of hashed runs of four bytes, and of one and two words."""
    x = np.zeros(2 * BINS + 1, np.float32)
    if len(data) > 3:
        d = data.astype(np.uint32)
        four = (d[:-3] | d[1:-2] << np.uint32(8) | d[2:-1] << np.uint32(16) | d[3:] << np.uint32(24)) * np.uint32(0x9E3779B1)
        x[:BINS] = _unit(np.bincount(four >> np.uint32(21), minlength=BINS))
    if len(words):
        both = np.concatenate((words, shingle_hashes(words, 2))) if len(words) > 1 else words
        x[BINS:-1] = _unit(np.bincount((both >> np.uint64(53)).astype(np.int64), minlength=BINS))
    x[-1] = 1
    return x


def _unit(counts: np.ndarray) -> np.ndarray:
    root = np.sqrt(counts)
    return root / np.sqrt(counts.sum())


def repeated_words(raw: bytes, words: np.ndarray) -> int:
    """Words that lie in a window of three that the text has at least twice. Hashes only tell that there is no such window."""
    if len(words) < 4:
        return 0
    hashed = shingle_hashes(words, 3)
    if len(np.unique(hashed)) == len(hashed):
        return 0
    w = raw.split()
    seen: dict[tuple, int] = {}
    twice = np.zeros(len(w), bool)
    for i, window in enumerate(zip(w, w[1:], w[2:])):
        first = seen.setdefault(window, i)
        if first != i:
            twice[i : i + 3] = True
            twice[first : first + 3] = True
    return int(twice.sum())


def repeated_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def _featured(rows: DataFrame) -> DataFrame:
    """doc_id, label and packed features of labelled rows."""

    def run(batches):
        for batch in batches:
            packed = []
            for data in texts(batch.column("text")):
                packed.append(features(data, word_hashes(data, *word_bounds(data))).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(packed, pa.binary())], ["doc_id", "label", "x"])

    return rows.select("doc_id", "label", "text").mapInArrow(in_turn("quality", run), "doc_id long, label int, x binary")


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 300) -> np.ndarray:
    """Weights of a logistic regression with a squared penalty, by accelerated gradient steps. All in the precision of x, so x is never copied."""
    w = np.zeros(x.shape[1], x.dtype)
    ahead, t = w, 1.0
    rate = x.dtype.type(1 / (0.25 * float(np.einsum("ij,ij->i", x, x).max()) + penalty))
    y = y.astype(x.dtype)
    for _ in range(steps):
        slope = (1 / (1 + np.exp(-(x @ ahead))) - y) @ x / x.dtype.type(len(y)) + x.dtype.type(penalty) * ahead
        new = ahead - rate * slope
        nxt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + x.dtype.type((t - 1) / nxt) * (new - w), new, nxt
    return w


def _fitted(x: np.ndarray, y: np.ndarray) -> Model | None:
    """A model of feature rows and labels; None if one of the halves lacks a label."""
    half = np.arange(len(y)) % 2 == 0
    if any(set(part.tolist()) != {0.0, 1.0} for part in (y[half], y[~half])):
        return None
    penalty = 1e-4
    held = np.empty(len(y))
    held[half] = x[half] @ _logistic(x[~half], y[~half], penalty)
    held[~half] = x[~half] @ _logistic(x[half], y[half], penalty)
    line = _logistic(np.stack((held, np.ones(len(y))), 1), y, 1e-3)
    return Model(_logistic(x, y, penalty), float(line[0]), float(line[1]))


def fit(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> Model | None:
    """A model from at most `rows` labelled documents; None if they don't show both labels.

    Labels without id or quality are passed over; of several labels of a document the lowest counts. The log-odds are
    calibrated on scores that each half of the sample gets from a model of the other half. One task fits the sample, whose
    size `rows` bounds, and only the model reaches the driver.
    """
    ship(docs.sparkSession)
    chosen = (
        labels.where("doc_id is not null and quality in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("quality").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    featured = _featured(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))  # at most `rows` ids

    def run(batches):
        found = []
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float32).reshape(-1, 2 * BINS + 1)
            found.append((batch.column("doc_id").to_numpy(), batch.column("label").to_numpy(), x))
        if found:
            ids, y, x = (np.concatenate(parts) for parts in zip(*found))
            found.clear()
            # rows that repeat an id are told apart by their features
            order = np.lexsort((x @ np.arange(1, x.shape[1] + 1, dtype=np.float32), ids))
            if model := _fitted(x[order], y[order].astype(float)):
                columns = [pa.array([model.weights.astype(np.float64).tobytes()]), pa.array([model.slope]), pa.array([model.offset])]
                yield pa.RecordBatch.from_arrays(columns, ["weights", "slope", "offset"])

    made = featured.repartition(1).mapInArrow(in_turn("quality", run), "weights binary, slope double, offset double").first()
    return Model(np.frombuffer(made.weights), made.slope, made.offset) if made else None


def judge(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of docs but those of the result, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, quality, kept.

    Null is the empty text; it has no words and so fails the base rule. Rows are judged one by one: repeated rows get equal
    verdicts, an empty table gives an empty one. quality is the calibrated probability (null without a model; then the base
    rule alone decides). Long texts are taken as a whole, in memory that is a small multiple of their size.
    """
    ship(docs.sparkSession)
    own = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality double, kept boolean"
    names = [x.split()[0] for x in own.split(", ")]
    kept = [c for c in docs.columns if c not in names]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), own])

    def run(batches):
        for batch in batches:
            rows = []
            for data in texts(batch.column("text")):
                starts, ends = word_bounds(data)
                words = word_hashes(data, starts, ends)
                raw, n = data.tobytes(), len(starts)
                again = repeated_words(raw, words)
                failed = n < MIN_WORDS or 100 * again > REPEATED_PERCENT * n
                p = model.probability(features(data, words)) if model else None
                chars = int((ends - starts).sum()) - int(((data & 0xC0) == 0x80).sum())
                rows.append((n, chars, int(_SYMBOL[data].sum()), repeated_lines(raw), again, failed, p, not failed and (p is None or p >= threshold)))
            made = [pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], [*kept, *names])

    return docs.select(*(F.col(f"`{c}`") for c in kept)).mapInArrow(in_turn("quality", run), schema)
