"""Alignment of two tokenizers: which tokens of one cover the bytes of which of the other, and how common each pair is.

Texts are cut where neither tokenizer's tokens can reach across, so each such chunk is encoded and aligned once. The records
(pair, document) are gathered into runs, sorted by pair and compressed. The runs' counts are dealt by the first token; a heap
merges the runs of a part token by token, counts every pair, knows the token's highest count when its last pair is read, and
sends each run what its pairs came to; there the counts reach the documents. So a pair that every document holds costs one
record a run.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfrank.llm.common import cut, keep, ship, take_turn

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"

#: A run is closed at so many links or documents.
RUN_LINKS, RUN_DOCS = 2_000_000, 20_000

#: Compressed bytes of the runs' pairs in a part, and the least number of parts.
PART_BYTES, LEAST_PARTS = 16 << 20, 128

#: Chunks whose alignments a worker keeps at most, besides those of the texts at hand; links of a group that are written out at most.
CHUNKS_KEPT, SMALL = 250_000, 1024

#: A chunk begins with spaces and goes on to the next space that follows anything but white space.
CHUNK = re.compile(r" +[^ ]*(?:(?<=\s) +[^ ]*)*")

SPACE_MARK = "\u2581"

OWN = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _byte_letters() -> dict[str, int]:
    """The byte of each letter of byte-level vocabularies: printable Latin-1 stands for itself, other bytes for the letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, a_file: str, b_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(public_tokenizers.path(a_file))
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=public_tokenizers.path(b_file))
        letters = _byte_letters()
        plain = lambda t: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode()
        self.a_bytes = {i: plain(t) for t, i in self.a.get_vocab().items()}
        shown = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(shown)]
        self.space = self.b.piece_to_id(SPACE_MARK)
        self.n_b = len(shown)

    def encode(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of both for each chunk; a chunk begins with the space that the second one adds by itself."""
        ours = self.a.encode_batch_fast(chunks, add_special_tokens=False)
        theirs = self.b.encode([c[1:] for c in chunks], num_threads=1)
        return [x.ids for x in ours], [y if len(c) > 1 else [self.space] for c, y in zip(chunks, theirs)]


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of neighbouring values, so many at a time."""
    edges = np.concatenate(([0], np.cumsum(counts)))
    whole = np.concatenate(([0], np.cumsum(values)))[edges]
    return whole[1:] - whole[:-1]


@dataclass
class Aligned:
    """What is known of chunks, in their order: groups as text, (n_a, n_b, n_groups, n_links), how many pairs each has, and all pairs with their links."""

    shown: list[str]
    counts: np.ndarray
    held: np.ndarray
    pairs: np.ndarray
    times: np.ndarray


class Tables:
    """Token bytes, their lengths, and ids as text with what can follow them."""

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]):
        self.a_bytes, self.b_bytes, self.n_b = a_bytes, b_bytes, len(b_bytes)
        self.a_size, self.b_size = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a_bytes, b_bytes))
        self.texts = [f"{i}{end}" for n, ends in ((len(a_bytes), ",|"), (self.n_b, ",;\n")) for end in ends for i in range(n)]


def align(a: list[list[int]], b: list[list[int]], data: list[bytes], tables: Tables) -> Aligned:
    """Groups and links of many chunks at once; a chunk whose tokens' bytes aren't its data has a negative n_a and nothing else."""
    right = [b"".join([tables.a_bytes[i] for i in x]) == d == b"".join([tables.b_bytes[i] for i in y]) for x, y, d in zip(a, b, data)]
    if not all(right):
        kept = align(*([v for v, good in zip(x, right) if good] for x in (a, b, data)), tables)
        at = np.flatnonzero(right)
        shown, counts, held = [""] * len(a), np.zeros((len(a), 4), np.int64), np.zeros(len(a), np.int64)
        counts[:, 0], counts[at], held[at] = -1, kept.counts, kept.held
        for i, x in zip(at.tolist(), kept.shown):
            shown[i] = x
        return Aligned(shown, counts, held, kept.pairs, kept.times)
    sizes_a, sizes_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    ids_a, ids_b = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((a, sizes_a), (b, sizes_b)))
    ends_a, ends_b = np.cumsum(tables.a_size[ids_a]), np.cumsum(tables.b_size[ids_b])
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
    in_a, in_b = (np.bincount(g, minlength=len(common)) for g in (group_a, group_b))
    to_a, to_b = np.cumsum(in_a), np.cumsum(in_b)
    chunk_of = np.searchsorted(np.cumsum(np.fromiter(map(len, data), np.int64, len(data))), common)
    groups = np.bincount(chunk_of, minlength=len(a))
    # all tokens in the order in which groups show them, each with the sign that follows it
    last_a, last_b = np.ones(len(ids_a), bool), np.ones(len(ids_b), np.int64)
    last_a[:-1] = group_a[1:] != group_a[:-1]
    last_b[:-1] = group_b[1:] != group_b[:-1]
    last_b[to_b[np.cumsum(groups)[groups > 0] - 1] - 1] = 2  # ends the chunk
    order = np.empty(len(ids_a) + len(ids_b), np.int64)
    order[np.arange(len(ids_a)) + (to_b - in_b)[group_a]] = ids_a + last_a * len(tables.a_bytes)
    order[np.arange(len(ids_b)) + to_a[group_b]] = ids_b + last_b * tables.n_b + 2 * len(tables.a_bytes)
    lines = "".join(map(tables.texts.__getitem__, order.tolist())).split("\n")
    links = in_a * in_b
    counts = np.stack((sizes_a, sizes_b, groups, _sums(links, groups)), 1)
    # links of small groups are written out; of large ones only those between distinct tokens
    small = links <= SMALL
    use = small[group_a]
    each = in_b[group_a[use]]
    at_b = np.repeat((to_b - in_b)[group_a[use]] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
    owner = np.repeat(chunk_of[group_a[use]], each)
    pairs, times = np.repeat(ids_a[use], each) * tables.n_b + ids_b[at_b], np.ones(len(at_b), np.int64)
    for g in np.flatnonzero(~small).tolist():
        (x, n), (y, m) = (np.unique(ids[end - size : end], return_counts=True) for ids, end, size in ((ids_a, to_a[g], in_a[g]), (ids_b, to_b[g], in_b[g])))
        pairs, times = np.concatenate((pairs, (x[:, None] * tables.n_b + y).ravel())), np.concatenate((times, (n[:, None] * m).ravel()))
        owner = np.concatenate((owner, np.full(len(x) * len(y), chunk_of[g])))
    by = np.lexsort((pairs, owner))
    pairs, times, owner = pairs[by], times[by], owner[by]
    first = np.flatnonzero(np.concatenate(([len(by) > 0], (np.diff(pairs) != 0) | (np.diff(owner) != 0)))[: len(by)])
    times = np.add.reduceat(times, first) if len(first) else times
    return Aligned(lines[: len(a)], counts, np.bincount(owner[first], minlength=len(a)), pairs[first], times)


class _Chunks(dict):
    """Numbers of the chunks that this worker has met, and what is known of each; begun anew when there are too many."""

    def __init__(self, pair: Pair):
        self.pair, self.tables = pair, Tables([pair.a_bytes[i] for i in range(len(pair.a_bytes))], pair.b_bytes)
        self.restart()

    def restart(self) -> None:
        self.clear()
        self.fresh: list[str] = []
        self.shown: list[str] = []
        self.counts, self.held, self.pairs, self.times, self.begin = np.zeros((0, 4), np.int64), *(np.zeros(0, np.int64) for _ in range(4))

    def __missing__(self, chunk: str) -> int:
        n = self[chunk] = len(self)
        self.fresh.append(chunk)
        return n

    def learn(self) -> None:
        """Aligns the chunks that were met since the last call."""
        if not self.fresh:
            return
        new = align(*self.pair.encode(self.fresh), [c.encode() for c in self.fresh], self.tables)
        self.fresh = []
        self.shown += new.shown
        for name in ("counts", "held", "pairs", "times"):
            setattr(self, name, np.concatenate((getattr(self, name), getattr(new, name))))
        self.begin = np.cumsum(self.held) - self.held


@lru_cache(1)
def _chunks(a_file: str, b_file: str) -> _Chunks:
    return _Chunks(Pair(a_file, b_file))


keep("alignment", _chunks.cache_clear)


def aligned(texts: list[str | None], chunks: _Chunks) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
    """(n_a, n_b, n_groups, n_links, groups_sha256) of each text, and the records: text's place, pair, links."""
    if len(chunks) > CHUNKS_KEPT:
        chunks.restart()
    cut_texts = [[chunks[c] for c in CHUNK.findall(" " + t)] if t else [] for t in texts]
    chunks.learn()
    bad = set(np.flatnonzero(chunks.counts[:, 0] < 0).tolist())
    if bad:
        cut_texts = [[] if not bad.isdisjoint(x) else x for x in cut_texts]
    sizes = np.fromiter(map(len, cut_texts), np.int64, len(texts))
    flat = np.fromiter(chain.from_iterable(cut_texts), np.int64, int(sizes.sum()))
    totals = np.stack([_sums(chunks.counts[flat, i], sizes) for i in range(4)], 1)
    shown = chunks.shown
    digest = lambda x: hashlib.sha256(";".join([shown[i] for i in x]).encode()).hexdigest() if x else ""
    rows = [(*t, digest(x)) for t, x in zip(totals.tolist(), cut_texts)]
    each = chunks.held[flat]
    at = np.repeat(chunks.begin[flat] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
    return rows, np.repeat(np.repeat(np.arange(len(texts)), sizes), each), chunks.pairs[at], chunks.times[at]


def _pack(values: np.ndarray) -> bytes:
    return zstandard.compress(values.tobytes(), 1)


def _unpack(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def _runs(docs: DataFrame, text: str, key: str, a_file: str, b_file: str) -> DataFrame:
    """A row a run: its documents and what is known of them, its distinct pairs in order, how many documents hold each, and who holds it how often."""
    kind = docs.schema[key].dataType.simpleString()
    columns = ["n_a", "n_b", "n_groups", "n_links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        take_turn("alignment")
        chunks, made, number = _chunks(a_file, b_file), 0, TaskContext.get().partitionId()
        keys, rows, records, links = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal made, keys, rows, records, links
            doc, pair, times = (np.concatenate(x) for x in zip(*records)) if records else (np.zeros(0, np.int64),) * 3
            order = np.argsort(pair * RUN_DOCS * 2 + doc, kind="stable")
            doc, pair, times = doc[order], pair[order], times[order]
            first = np.flatnonzero(np.concatenate(([len(pair) > 0], (np.diff(pair) != 0) | (np.diff(doc) != 0)))[: len(pair)])
            doc, pair, times = doc[first], pair[first], np.add.reduceat(times, first) if len(first) else times
            begin = np.flatnonzero(np.concatenate(([len(pair) > 0], np.diff(pair) != 0))[: len(pair)])
            held = np.diff(np.concatenate((begin, [len(pair)]))).astype(np.uint32)
            one = lambda x: pa.array([x])
            listed = [pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), x) for x in (pa.concat_arrays(keys), *(pa.array(x, t) for x, t in zip(zip(*rows), [pa.int64()] * 4 + [pa.string()])))]
            out = [one(number << 32 | made), *listed, one(_pack(pair[begin])), one(_pack(held)), one(_pack(doc.astype(np.uint32))), one(_pack(times))]
            made, keys, rows, records, links = made + 1, [], [], [], 0
            return pa.RecordBatch.from_arrays(out, ["run", "keys", *columns, "shas", "pairs", "held", "docs", "times"])

        for batch in batches:
            first = 0
            while first < batch.num_rows:
                last, size = first + 1, len(batch.column(1)[first].as_py() or "")
                while last < batch.num_rows and last - first < 256 and size < 1 << 20:  # so many texts at once
                    size += len(batch.column(1)[last].as_py() or "")
                    last += 1
                found, doc, pair, times = aligned(batch.column(1).slice(first, last - first).to_pylist(), chunks)
                records.append((doc + len(rows), pair, times))
                keys.append(batch.column(0).slice(first, last - first))
                rows += found
                links += len(pair)
                first = last
                if links >= RUN_LINKS or len(rows) >= RUN_DOCS:
                    yield close()
        if rows:
            yield close()

    value = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    lists = ", ".join(f"{c} array<long>" for c in columns)
    return value.mapInArrow(run, f"run long, keys array<{kind}>, {lists}, shas array<string>, pairs binary, held binary, docs binary, times binary")


def _dealt(runs: DataFrame, parts: int, n_b: int) -> DataFrame:
    """The pairs of each run and how many of its documents hold them, dealt into parts by the A token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.to_pylist():
                pairs, held = _unpack(one["pairs"], np.int64), _unpack(one["held"], np.uint32)
                part = (pairs // n_b) % parts
                order = np.argsort(part, kind="stable")
                cuts = np.searchsorted(part[order], np.arange(parts + 1))
                out = [(p, one["run"], _pack(pairs[at]), _pack(held[at])) for p in range(parts) if len(at := order[cuts[p] : cuts[p + 1]])]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["part", "run", "pairs", "held"])

    return runs.select("run", "pairs", "held").mapInArrow(run, "part int, run long, pairs binary, held binary")


def _merge(n_b: int) -> Callable[[pa.Table], pa.Table]:
    """Merges the runs of a part: count of every pair, and whether it is its A token's highest, in the order of each run's own pairs."""

    def merge(table: pa.Table) -> pa.Table:
        runs = table.column("run").to_pylist()
        pairs = [_unpack(x.as_py(), np.int64) for x in table.column("pairs")]
        held = [_unpack(x.as_py(), np.uint32).astype(np.int64) for x in table.column("held")]
        counts, best = [np.empty(len(p), np.int64) for p in pairs], [np.empty(len(p), bool) for p in pairs]
        # where each A token's pairs begin in each run
        steps = [np.concatenate((np.flatnonzero(np.diff(p // n_b, prepend=-1)), [len(p)])).tolist() for p in pairs]
        firsts = [(p[s[:-1]] // n_b).tolist() for p, s in zip(pairs, steps)]
        heap = [(f[0], r, 0) for r, f in enumerate(firsts)]
        heapq.heapify(heap)
        while heap:
            token, together = heap[0][0], []
            while heap and heap[0][0] == token:  # all runs that hold this token, each moved on to its next
                _, r, i = heap[0]
                together.append((r, steps[r][i], steps[r][i + 1]))
                if i + 1 < len(firsts[r]):
                    heapq.heapreplace(heap, (firsts[r][i + 1], r, i + 1))
                else:
                    heapq.heappop(heap)
            theirs = np.concatenate([pairs[r][x:y] for r, x, y in together]) - token * n_b
            sums = np.bincount(theirs, np.concatenate([held[r][x:y] for r, x, y in together]), n_b).astype(np.int64) if len(theirs) > 64 else None
            if sums is None:
                small: Counter = Counter()
                for y, n in zip(theirs.tolist(), np.concatenate([held[r][x:y] for r, x, y in together]).tolist()):
                    small[y] += n
                values = np.fromiter((small[y] for y in theirs.tolist()), np.int64, len(theirs))
            else:
                values = sums[theirs]
            most, first = values.max(), 0
            for r, x, y in together:
                counts[r][x:y] = values[first : first + y - x]
                best[r][x:y] = counts[r][x:y] == most
                first += y - x
        return pa.table({"part": table.column("part"), "run": pa.array(runs, pa.int64()), "counts": pa.array(map(_pack, counts), pa.binary()), "best": pa.array(map(_pack, best), pa.binary())})

    return merge


def align_tokens(docs: DataFrame, text: str = "text", key: str = "doc_id", a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    A text that is null, empty, or not what the joined bytes of either tokenizer's tokens say has no tokens: zeros, and the
    empty text as digest. Rows are documents of their own, whatever their key, so repeated rows count twice. Among the pairs
    of an A token all that share its highest count are best. An empty table gives an empty one; other columns of docs,
    whatever their names, don't matter. A run takes a bounded number of links or documents, but holds at least a whole text.
    """
    spark = docs.sparkSession
    ship(spark)
    n_b = Pair(a_file, b_file).n_b
    kind = docs.schema[key].dataType.simpleString()
    runs = cut(_runs(docs, text, key, a_file, b_file))
    held = runs.agg(F.sum(F.octet_length("pairs") + F.octet_length("held"))).first()[0] or 0
    parts = max(LEAST_PARTS, -(-held // PART_BYTES))
    merged = _dealt(runs, parts, n_b).groupBy("part").applyInArrow(_merge(n_b), "part int, run long, counts binary, best binary")

    def back(table: pa.Table, sent: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({c: pa.array([], t) for c, t in [("key", table.schema.field("keys").type.value_type), *((c, pa.int64()) for c in OWN[:-1]), ("groups_sha256", pa.string())]})
        one = lambda c: table.column(c)[0]
        pairs, per_pair = _unpack(one("pairs").as_py(), np.int64), _unpack(one("held").as_py(), np.uint32)
        doc, times = _unpack(one("docs").as_py(), np.uint32), _unpack(one("times").as_py(), np.int64)
        counts, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
        part = (pairs // n_b) % parts
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        for p, c, b in zip(sent.column("part").to_pylist(), sent.column("counts"), sent.column("best")):
            at = order[cuts[p] : cuts[p + 1]]
            counts[at], best[at] = _unpack(c.as_py(), np.int64), _unpack(b.as_py(), bool)
        n = len(one("n_a"))
        sums, bests = np.zeros(n, np.int64), np.zeros(n, np.int64)
        np.add.at(sums, doc, times * np.repeat(counts, per_pair))
        np.add.at(bests, doc, times * np.repeat(best, per_pair))
        out = [one("keys").values, *(one(c).values for c in ("n_a", "n_b", "n_groups", "n_links")), pa.array(bests), pa.array(sums), one("shas").values]
        return pa.table(out, ["key", *OWN])

    schema = f"key {kind}, {', '.join(f'{c} long' for c in OWN[:-1])}, groups_sha256 string"
    return runs.groupBy("run").cogroup(merged.groupBy("run")).applyInArrow(back, schema).withColumnRenamed("key", key)
