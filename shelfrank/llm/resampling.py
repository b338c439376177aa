"""Importance resampling towards a target: documents are drawn by how much likelier their hashed n-grams are in the target.

Checksums of features are taken for many features at once: distinct features of equal length lie side by side as a matrix of
bytes, and all their checksums take one column after another.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfrank.llm.common import LOWER, cut, placed, ship

BUCKETS, SEED, PERCENT, MIN_WORDS = 10_000, 42, 5, 20

#: Features are runs of one to so many words.
RUN = 3

#: Texts are taken together up to so many bytes; matrices have so many features at most; longer features are rare and taken one by one.
TOGETHER, WIDE, LONG = 4 << 20, 8192, 512

#: Bytes of words after lower-casing: digits, a to z, and all beyond 0x7F.
IN_WORD = np.zeros(256, bool)
IN_WORD[np.r_[0x30:0x3A, 0x61:0x7B, 0x80:0x100]] = True


def _crc_table() -> np.ndarray:
    """What eight shifts of a byte add to a checksum, by the reflected polynomial of CRC-32."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC = _crc_table()


def crc32_of(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CRC-32 of each of many stretches of data (bytes as uint8), grouped by equal length."""
    out = np.zeros(len(starts), np.uint32)
    order = np.argsort(lengths, kind="stable")
    sorted_lengths = lengths[order]
    cuts = np.flatnonzero(np.diff(sorted_lengths)) + 1
    for same in np.split(order, cuts) if len(order) else ():
        n = int(lengths[same[0]])
        if n > LONG:
            for i in same:
                out[i] = zlib.crc32(data[starts[i] : starts[i] + n])
            continue
        steps = np.arange(n)[:, None]
        for first in range(0, len(same), WIDE):
            part = same[first : first + WIDE]
            matrix = data[starts[part][None, :] + steps]  # a column of each feature's bytes is a row here
            crc = np.full(len(part), 0xFFFFFFFF, np.uint32)
            for column in matrix:
                crc = CRC[(crc ^ column) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
            out[part] = ~crc
    return out


def _types(keys: pa.Array) -> tuple[np.ndarray, int]:
    """A number from 0 for each value, equal for equal values, and how many there are."""
    coded = keys.dictionary_encode()
    return coded.indices.to_numpy(), len(coded.dictionary)


def features(texts: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For runs of 1, 2 and 3 words each: the bucket of every occurrence and its text's number; and how many features a text has."""
    texts = texts.cast(pa.string()).fill_null("")
    n = len(texts)
    sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), texts), " ")[0].as_buffer()
    data = np.empty(len(joined) + 1, np.uint8)
    data[:-1], data[-1] = LOWER[np.frombuffer(joined, np.uint8)], 32
    word = IN_WORD[data]
    step = np.diff(np.concatenate(([0], word.view(np.int8), [0])))
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    counts = np.zeros(n, np.int64)
    if not len(starts):
        return [], counts
    text_of = np.searchsorted(np.cumsum(sizes + 1), starts, "right")
    kept = word.copy()
    kept[ends] = True  # each word, and one byte behind it, which becomes a space
    line = np.where(word, data, 32).astype(np.uint8)[kept]
    end = np.cumsum(ends - starts + 1)
    begin = np.concatenate(([0], end[:-1]))
    spelled = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(np.concatenate((begin, end[-1:])).astype(np.int64)), pa.py_buffer(line)])
    words, known = _types(spelled)
    at, kinds, n_kinds = np.arange(len(words)), words, known
    found, spans = [], []
    for k in range(1, RUN + 1):
        if k > 1:
            whole = text_of[at] == text_of[np.minimum(at + k - 1, len(words) - 1)]
            whole &= at + k <= len(words)
            at, kinds = at[whole], kinds[whole]
            kinds, n_kinds = _types(pa.array(kinds.astype(np.int64) * known + words[at + k - 1]))
        if not len(at):
            break
        one = np.empty(n_kinds, np.int64)
        one[kinds] = at  # a place of each distinct feature, whichever
        spans.append((begin[one], end[one + k - 1] - 1 - begin[one]))
        found.append((kinds, text_of[at]))
        counts += np.bincount(text_of[at], minlength=n)
    crc = crc32_of(line, np.concatenate([s for s, _ in spans]), np.concatenate([z for _, z in spans]))
    out, first = [], 0
    for (kinds, owner), (s, _) in zip(found, spans):
        out.append(((crc[first : first + len(s)] % np.uint32(BUCKETS))[kinds], owner))
        first += len(s)
    return out, counts


def _portions(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Rows of a column of texts, a few megabytes at a time, with the place of the first."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy()
    first = held = 0
    for at, size in enumerate(sizes.tolist()):
        if held and held + size > TOGETHER:
            yield first, column.slice(first, at - first)
            first, held = at, 0
        held += size
    if first < len(sizes):
        yield first, column.slice(first)


def count(docs: DataFrame, text: str = "text") -> DataFrame:
    """bucket, n: how many features of all texts fall into each bucket. A task passes on one row a bucket."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, texts in _portions(batch.column(0)):
                for buckets, _ in features(texts)[0]:
                    sums += np.bincount(buckets, minlength=BUCKETS)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at])], ["bucket", "n"])

    return docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, text: str = "text") -> np.ndarray:
    """Each bucket's gain in thousandths, from the counts of all texts of both tables; a number a bucket reaches the driver."""
    both = np.zeros((2, BUCKETS))
    for row, docs in zip(both, (source, target)):
        for bucket, n in count(docs, text).collect():
            row[bucket] = n
    (s, t), (total_s, total_t) = both, both.sum(1)
    return np.floor(1000 * np.log((t + 1) * (total_s + BUCKETS) / ((s + 1) * (total_t + BUCKETS)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_features, weight of every row: the sum of its features' gains."""
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, weight = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for first, texts in _portions(batch.column(1)):
                found, counts = features(texts)
                n[first : first + len(texts)] = counts
                for buckets, owner in found:  # owners ascend, so a text's gains are a stretch of the running sum
                    sums = np.concatenate(([0], np.cumsum(gain[buckets])))
                    edges = np.searchsorted(owner, np.arange(len(texts) + 1))
                    weight[first : first + len(texts)] += np.diff(sums[edges])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(weight)], ["key", "n_features", "weight"])

    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, n_features long, weight long").withColumnRenamed("key", key)


def resample(docs: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", seed: int = SEED, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """key, n_features, weight, score, rank of every row; rank is null where a document isn't drawn.

    Words are runs of letters and digits of ASCII and of anything beyond it, A to Z lower-cased. Features are runs of one to
    three words. The score is the weight plus a Gumbel draw from the key, so the highest scores are a weighted sample
    without replacement. Of the N documents with at least min_words words, floor(percent * N / 100) are drawn.

    A null text or one without words has no features, weight 0, and is not drawn; a null key draws as the empty text does.
    Repeated keys have the same draw and are documents of their own; ties go to the smaller key, then to any. Empty tables
    are counted as such: an empty target has no features, and an empty corpus gives no rows. Other columns don't matter.
    """
    if not 0 <= percent <= 100 or min_words < 2:
        raise ValueError("percent must be 0 to 100, min_words at least 2")
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((drawn + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = cut(weigh(docs, gains(docs, target, text), text, key).withColumn("score", F.col("weight") + noise))
    enough = F.col("n_features") >= sum(min_words - k for k in range(RUN))
    able = scored.where(enough)
    wanted = percent * able.count() // 100
    ranked = placed(able, [F.col("score").desc(), F.col(f"`{key}`").asc_nulls_last()]).withColumn("rank", F.when(F.col("_no") < wanted, F.col("_no") + 1).cast("long"))
    return ranked.drop("_no", "_start").unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long")))
