"""Exact search by inner product over blocks of vectors, of which only those are read that can hold one of the best.

A block has a centre, the radius of its vectors around it, the widest angle to it, and its least and greatest norm. They bound
every score in it (ball and cone bounds). A query reads its most promising blocks first; its k-th score so far then rules out
all blocks whose bound lies below.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfrank.operators.lexical import top_k
from shelfrank.operators.ranking import best_of_row
from shelfrank.sources.shared import cut, if_small, numbered, send_package

#: Vectors of a block, queries that meet a block at once, blocks that a query reads first, heads of a pack.
BLOCK, ASKED, FIRST, PACK = 1024, 512, 8, 4096

#: Rows whose scores of a list are held at once.
CHUNK = 128

#: Vectors that clusters are fitted on (those with the least hashes of their ids), rounds of fitting, and the most clusters.
SAMPLE, ROUNDS, CLUSTERS = 16_384, 8, 1024

#: Scores are compared to nine places, so a block counts as ruled out only beyond that.
SLACK = 2e-9

HEAD = ("centre", "radius", "angle", "least", "most")


@dataclass(frozen=True)
class Found:
    """query_id, id, score, rank of the best; and which blocks (query_id, block) were read for them."""

    rows: DataFrame
    visits: DataFrame


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(flat), -1)


def _pack(table: pa.Table) -> pa.Table:
    """One block of rows (block, id, vector)."""
    ids, v = table.column("id").combine_chunks(), _matrix(table.column("vector"))
    order = pc.sort_indices(ids)
    ids, v = ids.take(order), v[order.to_numpy()]
    centre, norms = v.mean(0), np.linalg.norm(v, axis=1)
    length = np.linalg.norm(centre)
    cosines = (v @ centre) / np.where(norms * length > 0, norms * length, 1)
    angle = float(np.arccos(np.clip(cosines, -1, 1)).max()) if length > 0 and norms.min() > 0 else np.pi
    values = (float(np.linalg.norm(v - centre, axis=1).max()), angle, float(norms.min()), float(norms.max()))
    one = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    return pa.table([table.column("block").slice(0, 1), one, pa.array([v.tobytes()], pa.binary()), pa.array([centre.tobytes()], pa.binary()), *(pa.array([x]) for x in values)], ["block", "ids", "matrix", *HEAD])


def _packed(dealt: DataFrame) -> DataFrame:
    kind = dealt.schema["id"].dataType.simpleString()
    return dealt.groupBy("block").applyInArrow(_pack, f"block long, ids array<{kind}>, matrix binary, centre binary, {', '.join(f'{c} double' for c in HEAD[1:])}")


def _whole(vectors: DataFrame) -> DataFrame:
    return vectors.where(F.col("vector").isNotNull() & F.col("id").isNotNull()).select("id", F.col("vector").cast("array<double>").alias("vector"))


def norm_blocks(vectors: DataFrame, size: int = BLOCK) -> DataFrame:
    """Blocks of vectors (id, vector) in the order of their norms, the longest first. Null ids and vectors are left out."""
    send_package(vectors.sparkSession)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    rows = numbered(_whole(vectors).withColumn("_norm", norm), [F.desc("_norm"), F.asc("id")])
    return _packed(rows.select("id", "vector", F.expr(f"ordinal div {size}").alias("block")))


def _centres(sample: np.ndarray, clusters: int) -> np.ndarray:
    """Means of a sample's clusters, from points spread over it."""
    centres = sample[np.linspace(0, len(sample) - 1, clusters).astype(int)].copy()
    for _ in range(ROUNDS):
        nearest = np.argmin((centres**2).sum(1) - 2 * sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        counts = np.bincount(nearest, minlength=clusters)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def cluster_blocks(vectors: DataFrame, size: int = BLOCK, clusters: int | None = None) -> DataFrame:
    """Blocks of near vectors (id, vector). Clusters are fitted on a bounded sample; every vector is put into its nearest one.

    A cluster of more than `size` vectors becomes several blocks, dealt by a hash of the ids, so none is larger than about that.
    """
    send_package(vectors.sparkSession)
    rows = cut(_whole(vectors))
    n = rows.count()
    clusters = clusters or max(1, min(CLUSTERS, -(-n // size)))
    sample = np.array([r.vector for r in rows.orderBy(F.xxhash64("id"), "id").select("vector").limit(SAMPLE).collect()])
    if not len(sample):
        return _packed(rows.withColumn("block", F.lit(0).cast("long")))
    centres = _centres(sample, min(clusters, len(sample)))
    squares = (centres**2).sum(1)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                nearest = np.argmin(squares - 2 * _matrix(batch.column(1)) @ centres.T, axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest, pa.int64())], ["id", "vector", "cluster"])

    kind = rows.schema["id"].dataType.simpleString()
    near = cut(rows.mapInArrow(assign, f"id {kind}, vector array<double>, cluster long"))
    parts = near.groupBy("cluster").agg(F.ceil(F.count("*") / F.lit(size)).alias("_parts"))  # a row a cluster
    block = F.shiftleft("cluster", 32) + F.pmod(F.xxhash64("id"), F.col("_parts"))
    return _packed(near.join(F.broadcast(parts), "cluster").select("id", "vector", block.alias("block")))


def bounds(q: np.ndarray, centre: np.ndarray, radius: np.ndarray, angle: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The greatest score that each query can have in each block."""
    norms, lengths = np.linalg.norm(q, axis=1)[:, None], np.linalg.norm(centre, axis=1)
    inner = q @ centre.T
    ball = inner + norms * radius
    cosine = inner / np.where(norms * lengths > 0, norms * lengths, 1)
    gap = np.cos(np.maximum(0, np.arccos(np.clip(cosine, -1, 1)) - angle - 1e-9))
    cone = np.where(lengths > 0, norms * np.where(gap > 0, most, least) * gap, np.inf)
    return np.minimum(ball, cone)


def _asked_packs(queries: DataFrame) -> DataFrame:
    """Queries (query_id, vector, floor) in rows of at most ASKED: ids, vectors and floors."""
    kind, n = queries.schema["query_id"].dataType.simpleString(), int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["asked", "q", "floor"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, ASKED):
                part = batch.slice(first, ASKED)
                asked = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("query_id"))
                values = (_matrix(part.column("vector")), part.column("floor").to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([asked, *(pa.array([v.tobytes()], pa.binary()) for v in values)], names)

    return queries.select("query_id", "vector", "floor").repartition(n, "query_id").mapInArrow(run, f"asked array<{kind}>, q binary, floor binary")


def _wanted(queries: DataFrame, heads: DataFrame, first: int | None) -> DataFrame:
    """query_id, block, bound of the blocks that may hold more than the query's `floor`; only the `first` most promising if given.

    Some hundred queries a row meet packs of heads, a few thousand blocks a row, so no pack is copied once a query.
    """
    kind = queries.schema["query_id"].dataType.simpleString()
    met = _asked_packs(queries).join(if_small(heads, 64), how="cross")  # of queries and packs of heads; the queries are a stated set

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                ids = row.column("asked").flatten()
                q, floor = np.frombuffer(row.column("q")[0].as_py()).reshape(len(ids), -1), np.frombuffer(row.column("floor")[0].as_py())
                flat = [np.frombuffer(row.column(c)[0].as_py()) for c in HEAD]
                blocks = row.column("blocks").flatten().to_numpy()
                most = bounds(q, flat[0].reshape(len(blocks), -1), *flat[1:])
                good = most >= floor[:, None] - SLACK
                if first is not None and len(blocks) > first:
                    best = np.zeros_like(good)
                    np.put_along_axis(best, np.argpartition(-most, first - 1, axis=1)[:, :first], True, axis=1)
                    good &= best
                i, j = np.nonzero(good)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), pa.array(blocks[j]), pa.array(most[i, j])], ["query_id", "block", "bound"])

    near = met.select("asked", "q", "floor", "blocks", *HEAD).mapInArrow(run, f"query_id {kind}, block long, bound double")
    return near if first is None else top_k(near.withColumnRenamed("bound", "score"), ["query_id"], "block", first).select("query_id", "block")


def _scan(wanted: DataFrame, queries: DataFrame, blocks: DataFrame, masked: DataFrame | None, k: int) -> DataFrame:
    """The k best of each wanted (query_id, block) that reach the query's floor. Queries of a block meet it some hundred at a time."""
    kind, asked = blocks.schema["ids"].dataType.elementType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    parts = cut(wanted.groupBy("block").agg(F.ceil(F.count("*") / F.lit(ASKED)).alias("_parts")))
    dealt = wanted.join(if_small(parts), "block").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("_parts"))).join(queries.select("query_id", "vector", "floor"), "query_id")
    places = F.array().cast("array<int>")
    if masked is not None:
        dealt = dealt.join(masked, ["query_id", "block"], "left")
        places = F.coalesce("places", places)
    left = dealt.select("block", "part", "query_id", "vector", "floor", places.alias("places"))
    right = blocks.select("block", "ids", "matrix").join(if_small(parts), "block").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    def best(q: pa.Table, b: pa.Table) -> pa.Table:
        out: list[tuple] = []
        id_type, asked_type = b.schema.field("ids").type.value_type, q.schema.field("query_id").type
        if q.num_rows and b.num_rows:
            keys = b.column("ids")[0].as_py()
            ids = np.array(keys, object if isinstance(keys[0], str) else None)
            matrix = np.frombuffer(b.column("matrix")[0].as_py()).reshape(len(ids), -1)
            scores = _matrix(q.column("vector")) @ matrix.T
            for query, row, mask, floor in zip(q.column("query_id").to_pylist(), scores, q.column("places").to_pylist(), q.column("floor").to_pylist()):
                row[mask] = -np.inf
                out += [(query, keys[j], row[j]) for j in best_of_row(row, ids, k) if row[j] >= floor - SLACK]
        columns = list(zip(*out)) or [()] * 3
        return pa.table([pa.array(columns[0], asked_type), pa.array(columns[1], id_type), pa.array(columns[2], pa.float64())], ["query_id", "id", "score"])

    return left.groupBy("block", "part").cogroup(right.drop("_parts").groupBy("block", "part")).applyInArrow(best, f"query_id {asked}, id {kind}, score double")


def search_blocks(blocks: DataFrame, queries: DataFrame, k: int, masked: DataFrame | None = None, first: int = FIRST) -> Found:
    """The k best ids of each query (query_id, vector) by inner product, without its masked ids (query_id, id); ties by id.

    Exact: a query reads its `first` blocks by their bounds, then every other block whose bound reaches its k-th score so far.
    Query ids must be unique; null vectors find nothing.
    """
    if k <= 0:
        raise ValueError("k must be greater than zero")
    spark = blocks.sparkSession
    send_package(spark)
    blocks = cut(blocks)
    asked = cut(queries.where("vector is not null").select("query_id", F.col("vector").cast("array<double>").alias("vector")))
    if not asked.groupBy("query_id").count().where("count > 1").isEmpty():
        raise ValueError("query ids must be unique")
    heads = cut(_head_packs(blocks))
    hidden = None
    if masked is not None:
        members = blocks.select("block", F.posexplode("ids").alias("place", "id"))
        hidden = cut(masked.select("query_id", "id").join(if_small(members), "id").groupBy("query_id", "block").agg(F.array_sort(F.collect_set("place")).alias("places")))
    free = asked.withColumn("floor", F.lit(float("-inf")))
    early = cut(_wanted(free, heads, first).select("query_id", "block"))
    found = cut(_scan(early, free, blocks, hidden, k))
    kth = top_k(found, ["query_id"], "id", k).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    open_ = cut(asked.join(kth, "query_id", "left").fillna(float("-inf"), ["floor"]))
    late = cut(_wanted(open_, heads, None).select("query_id", "block").join(early, ["query_id", "block"], "left_anti"))
    if not late.isEmpty():
        found = found.unionByName(_scan(late, open_, blocks, hidden, k))
    return Found(top_k(found, ["query_id"], "id", k), early.unionByName(late))


def not_beaten(asked: DataFrame, listed: list[list[float]], k: int) -> DataFrame:
    """query_id, id of those rows (query_id, id, vector, target, places) whose target's score fewer than k listed vectors exceed, without those at `places`.

    A listed score counts only where it is greater by more than both scores' errors, so no order of summing changes the k best of a row that is left out.
    """
    send_package(asked.sparkSession)
    matrix = np.array(listed, np.float64)
    longest = np.linalg.norm(matrix, axis=1).max()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, CHUNK):
                part = batch.slice(first, CHUNK)
                q, target = _matrix(part.column("vector")), _matrix(part.column("target"))
                scores = q @ matrix.T
                hidden = part.column("places")
                lengths = pc.fill_null(pc.list_value_length(hidden), 0).to_numpy(zero_copy_only=False)
                scores[np.repeat(np.arange(len(q)), lengths), hidden.flatten().to_numpy(zero_copy_only=False)] = -np.inf
                error = 4 * q.shape[1] * np.finfo(float).eps * np.linalg.norm(q, axis=1) * np.maximum(np.linalg.norm(target, axis=1), longest)
                least = (q * target).sum(1) + error + SLACK
                more = (scores > least[:, None]).sum(1)  # none where the error is not finite
                yield pa.RecordBatch.from_arrays([part.column(c).filter(pa.array(more < k)) for c in ("query_id", "id")], ["query_id", "id"])

    types = {f.name: f.dataType.simpleString() for f in asked.schema.fields}
    rows = asked.where("vector is not null and target is not null").select("query_id", "id", F.col("vector").cast("array<double>"), F.col("target").cast("array<double>"), "places")
    return rows.mapInArrow(run, f"query_id {types['query_id']}, id {types['id']}")


def _head_packs(blocks: DataFrame) -> DataFrame:
    """What bounds the blocks, some thousand blocks a row."""
    heads = blocks.select("block", *HEAD)
    packs = max(1, -(-heads.count() // PACK))

    def pack(table: pa.Table) -> pa.Table:
        join = lambda c: b"".join(table.column(c).to_pylist()) if c == "centre" else table.column(c).to_numpy().astype(np.float64).tobytes()
        blocks_ = pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), table.column("block").combine_chunks())
        return pa.table([table.column("pack").slice(0, 1), blocks_, *(pa.array([join(c)], pa.binary()) for c in HEAD)], ["pack", "blocks", *HEAD])

    dealt = heads.withColumn("pack", F.pmod(F.xxhash64("block"), F.lit(packs)))
    return dealt.groupBy("pack").applyInArrow(pack, f"pack long, blocks array<long>, {', '.join(f'{c} binary' for c in HEAD)}")
