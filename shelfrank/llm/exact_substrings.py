"""Repeated byte strings: suffix buckets at content-chosen positions, sorted one at a time with a difference cover for long ties.

Every string of LENGTH bytes holds a position that its bytes alone choose: where the least hash of GRAM bytes in it begins.
Suffixes that begin at such positions fall into buckets by their first GRAM bytes. A repeated string puts both its occurrences
into one bucket, so buckets of one suffix need no more work, and neither do positions whose whole surroundings are repeated.
The rest is sorted bucket by bucket, to both sides of the position, and the common lengths of neighbours give the strings.
"""

from __future__ import annotations

import hashlib
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfrank.llm.common import _Powers, cut, if_small, mix, ship, texts

LENGTH = 200
GRAM = 64

#: A perfect difference set: any two residues of PERIOD have a common step to members of COVER.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)

#: In buckets up to this size every two members are held against each other by their common lengths, in larger ones by classes.
PAIRED = 128

#: Larger buckets are not sorted in one task; their strings are counted by a shuffle.
SORTED = 32_768

#: Keys of one long are broadcast up to so many.
BROADCAST_KEYS = 2_000_000

_CHUNK = 1 << 18
_IN = np.isin(np.arange(PERIOD), COVER)
#: _STEP[r][s]: the least step that leads from both residues into the cover.
_STEP = [[next(d for d in range(PERIOD) if _IN[(r + d) % PERIOD] and _IN[(s + d) % PERIOD]) for s in range(PERIOD)] for r in range(PERIOD)]


def _slide(x: np.ndarray, w: int, least: bool) -> np.ndarray:
    """The least or greatest of each w neighbours, from runs within blocks of w."""
    over, edge = (np.minimum, np.uint64(0xFFFFFFFFFFFFFFFF)) if least else (np.maximum, np.uint64(0))
    n = len(x) - w + 1
    rows = np.full(-(-len(x) // w) * w, edge)
    rows[: len(x)] = x
    rows = rows.reshape(-1, w)
    ahead = over.accumulate(rows, axis=1).ravel()
    behind = over.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return over(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chosen positions of a byte string, a hash of the gram there, and a hash of the surroundings, as far as any window with it reaches."""
    w, out = length - gram + 1, []
    grams = len(data) - gram + 1
    if len(data) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    for a in range(0, grams, _CHUNK):
        b = min(grams, a + _CHUNK)
        low, high = max(0, a - w + 1), min(grams, b + w - 1)
        part = data[low : high + gram - 1]
        n = len(part)
        up, down = _Powers.to(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        h = mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
        inner = _slide(h, w, True)  # the least of each window
        padded = np.concatenate((np.zeros(w - 1, np.uint64), inner, np.zeros(w - 1, np.uint64)))
        chosen = np.flatnonzero(_slide(padded, w, False) == h)
        chosen = chosen[(chosen >= a - low) & (chosen < b - low)]
        s, e = np.maximum(chosen + low - (w - 1), 0) - low, np.minimum(chosen + low + length, len(data)) - low
        around = mix((sums[e] - sums[s]) * down[s] + (chosen - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + (e - s).astype(np.uint64))
        out.append((chosen + low, h[chosen], around))
    return tuple(np.concatenate(x) for x in zip(*out))


def cover_ranks(suffixes: list[bytes], places: list[int], members: list[int]) -> dict[tuple[int, int], int]:
    """The rank, among all sampled suffixes of a bucket, of what begins at each step below PERIOD that leads a member into the cover."""
    sampled = {(k, d): suffixes[k][d:] for k in members for d in range(PERIOD) if _IN[(places[k] + d) % PERIOD]}
    rank = {s: r for r, s in enumerate(sorted(set(sampled.values())))}
    return {key: rank[s] for key, s in sampled.items()}


def bucket_order(suffixes: list[bytes], places: list[int]) -> tuple[list[int], list[int]]:
    """Indices of suffixes in lexicographic order, and the common length of each with the one before it.

    The first PERIOD bytes are sorted as they are. The suffixes that agree in them with another have the cover's places ranked,
    once for the bucket, and are sorted by these ranks alone: from any two places there is a step, of less than PERIOD bytes,
    that leads both to ranked ones.
    """
    order = sorted(range(len(suffixes)), key=lambda i: suffixes[i][:PERIOD])
    ties, i = [], 0
    while i < len(order):
        j = i + 1
        while j < len(order) and suffixes[order[i]][:PERIOD] == suffixes[order[j]][:PERIOD]:
            j += 1
        if j - i > 1 and len(suffixes[order[i]]) >= PERIOD:
            ties.append((i, j))
        i = j
    ranks = cover_ranks(suffixes, places, [k for i, j in ties for k in order[i:j]])

    def compare(x: int, y: int) -> int:
        d = _STEP[places[x] % PERIOD][places[y] % PERIOD]
        return ranks[x, d] - ranks[y, d]

    for i, j in ties:
        order[i:j] = sorted(order[i:j], key=cmp_to_key(compare))
    common = [0] * len(order)
    for i in range(1, len(order)):
        common[i] = common_length(suffixes[order[i - 1]], suffixes[order[i]])
    return order, common


def common_length(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if x[low:mid] == y[low:mid]:
            low = mid
        else:
            high = mid
    return low


def _classes(order: list[int], common: list[int], depth: int) -> np.ndarray:
    """The number of each suffix's class of equal first `depth` bytes."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(np.asarray(common) < depth)
    return out


def _meets(order: list[int], common: list[int]) -> np.ndarray:
    """The common length of every two suffixes of a small bucket, from those of neighbours in order."""
    m = len(order)
    by_place = np.zeros((m, m), np.int64)
    lengths = np.asarray(common)
    for a in range(m - 1):
        by_place[a, a + 1 :] = np.minimum.accumulate(lengths[a + 1 :])
    place = np.empty(m, np.int64)
    place[order] = np.arange(m)
    both = by_place + by_place.T
    return both[place[:, None], place]


def bucket_reach(left: list[bytes], right: list[bytes], places: list[int], span: int) -> list[tuple[int, int] | None]:
    """For each member of a bucket the least and greatest l, so that l bytes of its left side and span - l of its right side recur together."""
    m = len(left)
    if m == 2:
        l, r = common_length(left[0], left[1]), common_length(right[0], right[1])
        return [(span - r, l) if l + r >= span else None] * 2
    lo, lc = bucket_order(left, [-p for p in places])
    ro, rc = bucket_order(right, places)
    if m <= PAIRED:
        l, r = _meets(lo, lc), _meets(ro, rc)
        fit = l + r >= span
        np.fill_diagonal(fit, False)
        least, most = np.where(fit, span - r, span + 1).min(1), np.where(fit, l, -1).max(1)
    else:
        least, most = np.full(m, span + 1), np.full(m, -1)
        size_l, size_r = np.array([len(x) for x in left]), np.array([len(x) for x in right])
        for l in range(span + 1):
            fit = np.flatnonzero((size_l >= l) & (size_r >= span - l))
            if len(fit) < 2:
                continue
            both = _classes(lo, lc, l)[fit] * (m + 1) + _classes(ro, rc, span - l)[fit]
            _, inverse, count = np.unique(both, return_inverse=True, return_counts=True)
            hit = fit[count[inverse] > 1]
            least[hit], most[hit] = np.minimum(least[hit], l), np.maximum(most[hit], l)
    return [(a, b) if b >= 0 else None for a, b in zip(least.tolist(), most.tolist())]


def _spans(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """x, y (a row's key) and (start, end) of stretches of repeated strings; they overlap, and may end behind the text."""
    span, half = length - gram, (length - gram) // 2

    def find(batches):
        for batch in batches:
            for x, y, data in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), texts(batch.column("text"))):
                at, key, around = anchors(data, length, gram)
                for i in range(0, len(at), 50_000):
                    n = len(at[i : i + 50_000])
                    columns = [np.full(n, x, np.int64), np.full(n, y, np.int64), at[i : i + n], key[i : i + n].view(np.int64), around[i : i + n].view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["x", "y", "at", "gram", "around"])

    found = cut(docs.select("x", "y", "text").mapInArrow(find, "x long, y long, at long, gram long, around long"))
    shared = if_small(cut(found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")), BROADCAST_KEYS)
    kinds = cut(found.join(shared, "gram", "left_semi").groupBy("gram", "around").agg(F.count("*").alias("n"), F.min(F.struct("x", "y", "at")).alias("first")))
    many = if_small(cut(kinds.where("n > 1").select("gram", "around")), BROADCAST_KEYS)
    whole = found.join(many, ["gram", "around"], "left_semi")
    whole = whole.select("x", "y", F.greatest(F.col("at") - span, F.lit(0)).alias("start"), (F.col("at") + length).alias("end"))

    # One of each kind of surroundings, in buckets that also hold another kind, with its bytes.
    several = if_small(cut(kinds.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1").select("gram")), BROADCAST_KEYS)
    wanted = kinds.join(several, "gram", "left_semi").select("first.x", "first.y", F.struct("gram", "n", "first.at").alias("place")).groupBy("x", "y").agg(F.collect_list("place").alias("wanted"))
    wanted = cut(wanted)
    held = docs.select("x", "y", "text").join(if_small(wanted.select("x", "y")), ["x", "y"], "left_semi").dropDuplicates(["x", "y"]).join(wanted, ["x", "y"])

    # A window of the wanted length reaches half of the span to one side at least, so that half is part of the bucket's key.
    rest = span - half

    def look(batches):
        names = ["bucket", "gram", "side", "x", "y", "at", "n", "left", "right"]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        for batch in batches:
            for x, y, text, places in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "text", "wanted"))):
                rows, raw = [], text.encode()
                for place in places:
                    at, key = place["at"], place["gram"]
                    left, right = raw[max(0, at - span) : at][::-1], raw[at + gram : at + length]
                    for side, own, near_, far in ((0, left, left[half:], right[:rest]), (1, right, left[:rest], right[half:])):
                        if len(own) >= half:
                            digest = hashlib.blake2b(own[:half], digest_size=8, key=(key & 0xFFFFFFFFFFFFFFFF).to_bytes(8), salt=bytes((side,))).digest()
                            rows.append((int.from_bytes(digest, signed=True), key, side, x, y, at, place["n"], near_, far))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    near = cut(held.select("x", "y", "text", "wanted").mapInArrow(look, "bucket long, gram long, side int, x long, y long, at long, n long, left binary, right binary"))
    sizes = cut(near.groupBy("bucket").agg(F.count("*").alias("size"), F.min("n").alias("least")).where("size > 1 and least = 1").select("bucket", "size"))
    use = near.join(if_small(sizes.where(F.col("size") <= SORTED).select("bucket"), BROADCAST_KEYS), "bucket", "left_semi")
    key = ["bucket", "gram", "side"]

    def sort(batches):
        now, rows = None, []

        def done():
            back = half if now[2] == 0 else 0  # what the bucket's own half adds to the left
            after = gram + (half if now[2] else 0)
            left, right, places = [r[3] for r in rows], [r[4] for r in rows], [r[2] + after for r in rows]
            for r, reach in zip(rows, bucket_reach(left, right, places, rest)):
                if reach:
                    got.append((r[0], r[1], r[2] - back - reach[1], r[2] - back - reach[0] + length))

        got: list[tuple] = []
        for batch in batches:
            for *this, x, y, at, left, right in zip(*(batch.column(c).to_pylist() for c in (*key, "x", "y", "at", "left", "right"))):
                if this != now:
                    if len(rows) > 1:
                        done()
                    now, rows = this, []
                rows.append((x, y, at, left, right))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got)], ["x", "y", "start", "end"])
                got = []
        if len(rows) > 1:
            done()
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got)], ["x", "y", "start", "end"])

    small = use.select(*key, "x", "y", "at", "left", "right").repartition("bucket").sortWithinPartitions(*key)
    edges = small.mapInArrow(sort, "x long, y long, start long, end long")

    # Buckets too large to sort in a task: the strings of each window are counted.
    steps = F.explode(F.sequence(F.lit(0), F.lit(rest))).alias("l")
    strings = (
        near.join(if_small(sizes.where(F.col("size") > SORTED).select("bucket"), BROADCAST_KEYS), "bucket", "left_semi")
        .select(*key, "x", "y", "at", "left", "right", steps)
        .where((F.length("left") >= F.col("l")) & (F.length("right") >= rest - F.col("l")))
        .withColumns({"before": F.expr("substring(left, 1, l)"), "after": F.expr(f"substring(right, 1, {rest} - l)")})
        .select(*key, "x", "y", "at", "l", F.xxhash64(*key, "l", "before", "after").alias("h1"), F.xxhash64("after", "before", "l", *key).alias("h2"))
    )
    string = ["h1", "h2"]  # 128 bits
    counted = if_small(cut(strings.groupBy(*string).agg(F.count("*").alias("c")).where("c > 1").select(*string)), BROADCAST_KEYS)
    begin = F.col("at") - F.col("l") - F.when(F.col("side") == 0, half).otherwise(0)
    reach = strings.join(counted, string, "left_semi").groupBy("x", "y", *key, "at").agg(F.min(begin).alias("start"), F.max(begin + length).alias("end"))
    return whole.unionByName(edges).unionByName(reach.select("x", "y", "start", "end"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs.

    A byte goes if a string of `length` bytes over it also begins anywhere else, in the same row or another; strings do not
    cross rows and are judged on the input. Null is the empty text. Every row is a document of its own, whatever its id: rows
    without id, rows that repeat an id with another text, and rows that repeat both, of which each makes the other a repeat.
    An empty table gives an empty one. Texts are taken as a whole, in chunks of bounded memory, but for the removal itself,
    which holds one text.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumns({"x": F.xxhash64("doc_id", "text"), "y": F.xxhash64(F.lit(1), "text", "doc_id")})  # rows that agree in both get equal results
    gone = cut(_spans(docs, length, gram).groupBy("x", "y").agg(F.collect_set(F.struct("start", "end")).alias("gone")))
    ids = if_small(gone.select("x", "y"))

    def keep(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text"), batch.column("gone")):
                raw = text.as_py().encode()
                merged: list[list[int]] = []
                for s, e in sorted((p["start"], min(p["end"], len(raw))) for p in spans.as_py() or ()):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                digest, at = hashlib.sha256(), 0
                for s, e in merged:
                    digest.update(raw[at:s])
                    at = e
                digest.update(raw[at:])
                out.append((len(raw), sum(e - s for s, e in merged), len(merged), digest.hexdigest()))
            made = [pa.array([r[i] for r in out], t) for i, t in enumerate([pa.int64()] * 3 + [pa.string()])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    changed = docs.join(ids, ["x", "y"], "left_semi").join(gone, ["x", "y"]).select("doc_id", "text", "gone").mapInArrow(keep, schema)
    same = docs.join(ids, ["x", "y"], "left_anti").select("doc_id", "text", F.lit(None).cast(gone.schema["gone"].dataType).alias("gone")).mapInArrow(keep, schema)
    return changed.unionByName(same)
