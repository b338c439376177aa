"""Document likelihood under a unigram model of subwords: all segmentations of a word count, by a forward recursion over its lattice.

The pieces are those of a public vocabulary, bytes included, so every text has a probability. Their scores in the vocabulary
give first weights; one pass of expectation and maximisation over the counted words of the training documents fits them.
No piece has a space but in front, so a text's probability is the product of its words' and of the end's.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfrank.llm.common import cut, keep, ship, take_turn

PIECES = "piece_bpe_32k.model"

#: Added to the expected count of every piece, and to counts in the base score.
ADDED = 0.1

#: So many of the most frequent words, none longer than this, are sent to all tasks; the rest are joined.
SENT_WORDS, SENT_BYTES = 150_000, 48

#: Folds: a document is held out if crc32 of its id, as text, leaves 0.
FOLDS = 10

#: A task's counter of words is passed on when it has so many.
COUNTED = 200_000


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % FOLDS == 0


@lru_cache(2)
def inventory(name: str = PIECES) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes, a space for the mark of a word's begin, and their first log weights: less by the rank of their scores."""
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    found: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i):
            continue
        text = model.id_to_piece(i)
        piece = bytes([int(text[3:5], 16)]) if model.is_byte(i) else text.replace("▁", " ").encode()
        score = -math.inf if model.is_byte(i) else model.get_score(i)
        if b" " not in piece[1:]:
            found[piece] = max(score, found.get(piece, -math.inf))
    for i in range(256):
        found.setdefault(bytes([i]), -math.inf)
    pieces = sorted(found, key=lambda p: (-found[p], p))
    weights = -np.log(np.arange(len(pieces)) + 10.0)
    return pieces, weights - np.log(np.exp(weights).sum())


@lru_cache(2)
def matcher(name: str = PIECES):
    out = ahocorasick.Automaton()
    for i, piece in enumerate(inventory(name)[0]):
        out.add_word(piece.decode("latin-1"), (len(piece), i))
    out.make_automaton()
    return out


keep("language_model", matcher.cache_clear)


def log_marginal(word: bytes, weights: list[float], name: str = PIECES) -> float:
    """The natural logarithm of the summed probability of all segmentations of a word, taken with a space in front."""
    text = " " + word.decode("latin-1")
    forward = [0.0] + [-math.inf] * len(text)
    log1p, exp = math.log1p, math.exp
    for end, (size, i) in matcher(name).iter(text):
        x, y = forward[end + 1 - size] + weights[i], forward[end + 1]
        if x < y:
            x, y = y, x
        forward[end + 1] = x if y - x < -40 else x + log1p(exp(y - x))
    return forward[-1]


def expected(word: bytes, count: float, weights: list[float], into: np.ndarray | list, name: str = PIECES) -> None:
    """Adds to `into` how often each piece is expected in `count` words. The sums are scaled at each position, so no word is too long."""
    text = " " + word.decode("latin-1")
    arcs = [(end + 1 - size, end + 1, i) for end, (size, i) in matcher(name).iter(text)]
    forward, backward = [0.0] * (len(text) + 1), [0.0] * (len(text) + 1)
    forward[0] = backward[-1] = 1.0
    if len(text) <= 40:
        for s, e, i in arcs:
            forward[e] += forward[s] * weights[i]
        for s, e, i in reversed(arcs):
            backward[s] += backward[e] * weights[i]
        scale = count / forward[-1]
        for s, e, i in arcs:
            into[i] += forward[s] * weights[i] * backward[e] * scale
        return
    log = [-math.inf] * (len(text) + 1)
    log[0] = 0.0
    for s, e, i in arcs:
        log[e] = np.logaddexp(log[e], log[s] + math.log(weights[i]))
    back = [-math.inf] * (len(text) + 1)
    back[-1] = 0.0
    for s, e, i in reversed(arcs):
        back[s] = np.logaddexp(back[s], back[e] + math.log(weights[i]))
    for s, e, i in arcs:
        into[i] += count * math.exp(log[s] + math.log(weights[i]) + back[e] - log[-1])


def _counted(docs: DataFrame) -> DataFrame:
    """word and c, its count in training documents, of every word of any document."""

    def run(batches):
        take_turn("language_model")
        learnt, other = Counter(), set()

        def out():
            words = [*learnt, *(other - learnt.keys())]
            counts = [*learnt.values(), *[0] * (len(words) - len(learnt))]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(counts, pa.int64())], ["word", "c"])
            learnt.clear(), other.clear()

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                words = (text.as_py() or "").encode().lower().split()  # of bytes: ASCII letters and white space only
                (other if held_out(doc_id.as_py()) else learnt).update(words)
                if len(learnt) + len(other) > COUNTED:
                    yield from out()
        yield from out()

    return docs.select("doc_id", "text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def fit(words: DataFrame, ends: int, name: str = PIECES) -> tuple[np.ndarray, float]:
    """Log weights of the pieces and of the end, from counted words (word, c). What reaches the driver is one row a piece."""
    pieces, first = inventory(name)
    start = np.exp(first).tolist()

    def run(batches):
        take_turn("language_model")
        total = [0.0] * len(pieces)
        for batch in batches:
            for word, c in zip(batch.column("word").to_pylist(), batch.column("c").to_pylist()):
                expected(word, c, start, total, name)
        at = [i for i, x in enumerate(total) if x]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([total[i] for i in at], pa.float64())], ["piece", "n"])

    rows = words.where("c > 0").mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    count = np.full(len(pieces) + 1, ADDED)
    for r in rows:
        count[r.piece] += r.n
    count[-1] += ends
    logs = np.log(count) - np.log(count.sum())
    return logs[:-1], float(logs[-1])


def score(docs: DataFrame, name: str = PIECES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs.

    Null is the empty text, which has the end as its only token; a null id counts as the empty text in the folds. Rows that
    repeat an id are scored and learnt from one by one. An empty table gives an empty one. Without training documents all
    counts are 0. Rows are told apart by their place in the scan, so docs must be read from files (cut() it otherwise).
    Whole texts are counted. Words are counted by a shuffle; each distinct word's lattice is run once, and its value reaches
    the documents by a join, except for a bounded table of the most frequent words, which is sent to all tasks.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = cut(_counted(docs))
    ids = docs.select("doc_id")
    ends = ids.where(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS != 0).count()
    total, distinct = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    total, distinct = total + ends, distinct + (ends > 0)
    logs, end = fit(counted, ends, name)
    weights = logs.tolist()
    below = math.log10(total + ADDED * (distinct + 1))

    def run_words(batches):
        take_turn("language_model")
        for batch in batches:
            values = pa.array([log_marginal(w, weights, name) / math.log(10) for w in batch.column("word").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), values], ["word", "c", "p"])

    words = cut(counted.mapInArrow(run_words, "word binary, c long, p double"))
    frequent = words.where(F.length("word") <= SENT_BYTES).orderBy(F.desc("c"), "word").limit(SENT_WORDS).collect()
    sent = spark.sparkContext.broadcast({bytes(r.word): (math.log10(r.c + ADDED) - below, r.p, r.c > 0) for r in frequent})
    end_base, end_p, end_known = math.log10(ends + ADDED) - below, end / math.log(10), ends > 0

    def run_docs(batches):
        names = ["row", "doc_id", "word", "n", "n_tokens", "n_known", "base", "p"]
        types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        take_turn("language_model")
        known = sent.value
        for batch in batches:
            rows = []
            for row, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text"))):
                found = Counter((text or "").encode().lower().split())
                tokens, hits, base, p = 1, int(end_known), end_base, end_p
                for word, n in found.items():
                    tokens += n
                    if word in known:
                        b, q, k = known[word]
                        base, p, hits = base + n * b, p + n * q, hits + n * k
                    else:
                        rows.append((row, doc_id, word, n, 0, 0, 0.0, 0.0))
                # a key that no word is, and that spreads the rows
                rows.append((row, doc_id, b" %d" % row, 0, tokens, hits, base, p))
                if len(rows) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)

    split = docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run_docs, "row long, doc_id long, word binary, n long, n_tokens long, n_known long, base double, p double")
    other = words.select("word", "c", F.col("p").alias("word_p"))
    joined = split.join(other, "word", "left")
    n, c = F.col("n"), F.coalesce("c", F.lit(0))
    rest = F.when(n > 0, n * (F.log10(c + ADDED) - below)).otherwise(0.0)
    sums = joined.groupBy("row", "doc_id").agg(
        F.sum(F.col("n_tokens")).alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(c > 0, n).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + rest).alias("base_score"),
        F.sum(F.col("p") + F.when(n > 0, n * F.col("word_p")).otherwise(0.0)).alias("score"),
    )
    return sums.select(
        "doc_id",
        (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == 0).alias("held_out"),
        "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score",
    )
