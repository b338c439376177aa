"""What the corpus operators share: tables, the package in workers, words of byte strings."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfrank.sources.shared import BROADCAST_ROWS, cut, delete, if_small, recorded, scratch, send_package, shared_dir

__all__ = ["BROADCAST_ROWS", "cut", "delete", "if_small", "recorded", "scratch", "shared_dir"]

#: Rows of an Arrow batch, where the session has Spark's own default: texts are long.
BATCH_ROWS = 1000

#: Bytes that part words: space, and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(name: str, columns: list[str]) -> str:
    """A name like the given one that none of the columns has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers; where the session has Spark's default of 10000 rows, Arrow batches get 1000 from here on, for texts are long."""
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(size) == "10000":
        spark.conf.set(size, str(BATCH_ROWS))
    send_package(spark)


def placed(rows: DataFrame, order: list[Column], size: str | None = None) -> DataFrame:
    """rows (narrow) with `_no`, from 0 in the given order, and `_start`, the sum of `size` over all rows before, from totals of each partition.

    Rows are dealt into ranges of the order; a range's rows are numbered within it, and the totals of earlier ranges, a row
    each, are added. Rows that the order leaves equal are told apart by their place in the table that is written first, so
    that no key keeps them in one range.
    """
    last = F.col("_mid").asc()
    ranged = cut(cut(rows).withColumn("_mid", F.monotonically_increasing_id()).repartitionByRange(*order, last).withColumn("_part", F.spark_partition_id()))
    sizes = F.lit(0) if size is None else F.col(size)
    totals = ranged.groupBy("_part").agg(F.count("*").alias("_n"), F.sum(sizes).alias("_s"))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row a partition
    before = totals.select("_part", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}0") for c in ("_n", "_s")))
    within = W.partitionBy("_part").orderBy(*order, last)
    counted = ranged.withColumn("_at", F.row_number().over(within) - 1).withColumn("_sum", F.sum(sizes).over(within.rowsBetween(W.unboundedPreceding, 0)) - sizes)
    return counted.join(F.broadcast(before), "_part").withColumns({"_no": F.col("_at") + F.col("_n0"), "_start": F.col("_sum") + F.col("_s0")}).drop("_part", "_mid", "_at", "_sum", "_n0", "_s0")


_kept: dict[str, Callable[[], None]] = {}


def keep(name: str, clear: Callable[[], None]) -> None:
    """Says how to let go of what an operator keeps in a worker from task to task."""
    _kept[name] = clear


def take_turn(name: str) -> None:
    """At the start of a task: lets go of what other operators keep in this worker, which serves one after another."""
    for other, clear in _kept.items():
        if other != name:
            clear()


def in_turn(name: str, run: Callable) -> Callable:
    """run (of batches) as a task that takes its turn and, when it ends, gives freed memory back to the system.

    A worker stays for a while after its last task; without this it would keep the most that it ever held, beside the JVM's
    memory in the next stage.
    """

    def whole_task(batches):
        take_turn(name)
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # other C libraries than glibc do without it
        if trim:
            trim(0)

    return whole_task


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that aren't white space."""
    gap = np.empty(len(data) + 2, np.int8)
    gap[0] = gap[-1] = 1
    gap[1:-1] = SPACE[data]
    step = np.diff(gap)
    return np.flatnonzero(step == -1), np.flatnonzero(step == 1)


class _Powers:
    """Powers of an odd base modulo 2^64, and their inverses, as far as they were asked for."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 2 * len(cls.up), 4096)
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            cls.up = np.concatenate((np.ones(1, np.uint64), np.multiply.accumulate(np.full(size - 1, _BASE))))
            cls.down = np.concatenate((np.ones(1, np.uint64), np.multiply.accumulate(np.full(size - 1, inverse))))
        return cls.up, cls.down


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: polynomial sums taken from prefix sums, block by block, then mixed with the length."""
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        low = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, low + _BLOCK, "right")))
        s, e = starts[first:last] - low, ends[first:last] - low
        up, down = _Powers.to(int(e[-1]) + 1)
        sums = np.zeros(int(e[-1]) + 1, np.uint64)
        np.cumsum((data[low : low + e[-1]].astype(np.uint64) + np.uint64(1)) * up[: e[-1]], out=sums[1:])
        out[first:last] = (sums[e] - sums[s]) * down[s]
        first = last
    return mix(out ^ (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k words; of all words together if there are fewer; none without words."""
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    out = words[:n].copy()
    for j in range(1, k):
        out = mix(out * np.uint64(0xFF51AFD7ED558CCD) + words[j : j + n])
    return out


def texts(column) -> list[np.ndarray]:
    """The UTF-8 bytes of each value of an Arrow string column, without copies; null is empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return [data[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
