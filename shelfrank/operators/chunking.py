"""Texts cut into overlapping chunks at the best separators, with lengths in any measure."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from shelfrank.sources.shared import send_package

#: Fixed value: where texts are split, the first that parts a text; the empty one parts it into characters.
SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " ", "")

#: Texts of a batch are split together up to so many characters.
TOGETHER = 1 << 20

Measure = Callable[[Sequence[str]], Sequence[int]]


def characters() -> Measure:
    """Lengths in characters."""
    return lambda texts: [len(t) for t in texts]


def words() -> Measure:
    """Lengths in words."""
    return lambda texts: [len(t.split()) for t in texts]


def tokens(path: str, prefix: str = "passage: ") -> Callable[[], Measure]:
    """Lengths in tokens of a vocabulary file (of the library `tokenizers`), each text behind the prefix; read once a worker."""

    def opened() -> Measure:
        from tokenizers import Tokenizer

        vocabulary = Tokenizer.from_file(path)
        return lambda texts: [len(e.ids) for e in vocabulary.encode_batch_fast([prefix + t for t in texts])]

    return opened


@dataclass(frozen=True)
class Splitter:
    """Chunks of at most `size`, each beginning with pieces of the one before it that measure `overlap` at most.

    A text is parted at the first separator that occurs in it; a separator stays at the head of the piece behind it. Pieces
    shorter than `size` are joined as far as they fit; others are parted further by the separators that follow. `measure` is
    called once in a task and gives a function that measures many texts at once.
    """

    size: int = 384
    overlap: int = 64
    measure: Callable[[], Measure] = field(default=characters)
    separators: tuple[str, ...] = SEPARATORS

    def __post_init__(self) -> None:
        if self.size <= 0:
            raise ValueError("size must be greater than zero")
        if not 0 <= self.overlap < self.size:
            raise ValueError("overlap must be at least 0 and less than size")


def _parted(text: str, first: int, last: int, separators: tuple[str, ...]) -> tuple[list[int], tuple[str, ...]]:
    """Where the pieces of text[first:last] end, and the separators that are left for them."""
    for i, separator in enumerate(separators):
        if not separator:
            return list(range(first + 1, last + 1)), ()
        at = text.find(separator, first, last)
        if at >= 0:
            ends = []
            while at >= 0:
                if at > first:
                    ends.append(at)
                at = text.find(separator, at + len(separator), last)
            return [*ends, last], separators[i + 1 :]
    return [last], ()


def _joined(edges: list[int], lengths: list[int], size: int, overlap: int, between: int) -> Iterator[tuple[int, int]]:
    """Where chunks of neighbouring pieces begin and end: each takes what fits, the next goes back by what overlaps.

    Sums over all pieces before each one make every step a search in a sorted list.
    """
    n = len(lengths)
    sums = [0, *accumulate(x + between for x in lengths)]
    i, j = 0, 1
    while True:
        j = max(j, bisect_right(sums, size + between + sums[i], j + 1 if j < n else n) - 1) if j < n else n
        yield edges[i], edges[j]
        if j >= n:
            return
        # the pieces that stay measure at most the overlap, and leave room for the next one unless they measure nothing
        least = max(sums[j] - between - overlap, min(sums[j + 1] - between - size, sums[j] - between))
        i = bisect_left(sums, least, i, j)
        j += 1


def split_texts(texts: Sequence[str], splitter: Splitter, measure: Measure) -> list[list[str]]:
    """The chunks of each text, without outer white space. All texts are parted level by level, and each level is measured in one call."""
    between = measure([""])[0]
    found: list[list[tuple[int, int]]] = [[] for _ in texts]
    work = [(k, 0, len(t), splitter.separators) for k, t in enumerate(texts) if t]
    while work:
        parted = [(k, first, *_parted(texts[k], first, last, left)) for k, first, last, left in work]
        pieces = [texts[k][a:b] for k, first, ends, _ in parted for a, b in zip([first, *ends], ends)]
        lengths, at, work = list(measure(pieces)), 0, []
        for k, first, ends, left in parted:
            own, edges, start = lengths[at : at + len(ends)], [first, *ends], 0
            at += len(ends)
            for i in [*(i for i, x in enumerate(own) if x >= splitter.size), len(own)]:
                if start < i:
                    found[k] += _joined(edges[start : i + 1], own[start:i], splitter.size, splitter.overlap, between)
                if i < len(own):
                    if left:
                        work.append((k, edges[i], edges[i + 1], left))
                    else:  # nothing parts it further: it stays as it is
                        found[k].append((edges[i], -edges[i + 1]))
                start = i + 1
    out = []
    for text, spans in zip(texts, found):
        spans.sort(key=lambda s: (s[0], abs(s[1])))
        shown = (text[a:b].strip() if b > 0 else text[a:-b] for a, b in spans)
        out.append([x for x in shown if x])
    return out


def split_text(df: DataFrame, text: Column | str, splitter: Splitter, out: str = "chunks") -> DataFrame:
    """df with `out`, the chunks of each text; a null or blank text has none. An own column of that name is replaced."""
    send_package(df.sparkSession)
    named = df.withColumn("_text", F.col(text) if isinstance(text, str) else text)
    kept = [f for f in df.schema.fields if f.name != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = splitter.measure()
        for batch in batches:
            texts = batch.column(len(kept)).to_pylist()
            chunks: list[list[str]] = []
            while len(chunks) < len(texts):
                first = last = len(chunks)
                size = 0
                while last < len(texts) and (last == first or size < TOGETHER):
                    size += len(texts[last] or "")
                    last += 1
                chunks += split_texts([t or "" for t in texts[first:last]], splitter, measure)
            columns = [batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(chunks, pa.list_(pa.string()))], [*(f.name for f in kept), out])

    schema = StructType([*kept, StructField(out, ArrayType(StringType()))])
    return named.select(*(F.col(f"`{f.name}`") for f in kept), "_text").mapInArrow(run, schema)
