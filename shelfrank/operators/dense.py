"""Vector search, vector tables and encoders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from shelfrank.functions.text import norm_text, tokenize
from shelfrank.operators.lexical import top_k
from shelfrank.operators.ranking import best_of_row
from shelfrank.sources.shared import cut, if_small, send_package

#: Queries and vectors of a block, and how many blocks of queries are sent to all tasks at most.
QUERY_BLOCK, VECTOR_BLOCK, SENT_BLOCKS = 512, 4096, 64


def cosine(a: Column | str, b: Column | str) -> Column:
    """The dot product in double precision, element by element; of unit vectors the cosine."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _packed(rows: DataFrame, key: str, size: int, names: tuple[str, str]) -> DataFrame:
    """Rows (key, vector) in blocks of at most `size`: the keys, and the vectors as bytes of doubles."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, size):
                part = batch.slice(first, size)
                vectors = part.column("vector")
                if pc.count_distinct(vectors.value_lengths()).as_py() > 1:
                    raise ValueError("vectors must have the same number of dimensions")
                numbers = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                keys = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(key))
                yield pa.RecordBatch.from_arrays([keys, pa.array([numbers.tobytes()], pa.binary())], list(names))

    return rows.where(F.col("vector").isNotNull()).select(key, "vector").mapInArrow(run, f"{names[0]} array<{kind}>, {names[1]} binary")


def _best_pairs(row: pa.RecordBatch, k: int) -> pa.RecordBatch:
    """query_id, id, score: the k best vectors of each query, of one row (asked, q, ids, v)."""
    asked, ids = (row.column(c).flatten() for c in ("asked", "ids"))
    q, v = (np.frombuffer(row.column(c)[0].as_buffer()).reshape(n, -1) for c, n in (("q", len(asked)), ("v", len(ids))))
    scores, names = q @ v.T, ids.to_numpy(zero_copy_only=False)
    best = [best_of_row(of, names, k) for of in scores]
    query, at = np.repeat(np.arange(len(best)), [len(b) for b in best]), np.concatenate(best)
    return pa.RecordBatch.from_arrays([asked.take(pa.array(query)), ids.take(pa.array(at)), pa.array(scores[query, at])], ["query_id", "id", "score"])


def dense_search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, id, score, rank of queries (query_id, vector) against vectors (id, vector).

    Both are written as tables of blocks. Each block of queries meets each block of vectors as two matrices, and a task passes on the k
    best rows of every query in it; these few meet in one more ranking. A worker reads blocks where Arrow has them, one pair
    at a time. Query ids must be unique; null vectors find nothing and are not found.
    """
    if k <= 0:
        raise ValueError("k must be greater than zero")
    send_package(vectors.sparkSession)
    kind, asked = vectors.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    if not queries.groupBy("query_id").count().where("count > 1").isEmpty():
        raise ValueError("query ids must be unique")
    whole = queries.select("query_id", "vector").repartition(max(1, -(-queries.count() // QUERY_BLOCK)))
    blocks = if_small(cut(_packed(whole, "query_id", QUERY_BLOCK, ("asked", "q"))), SENT_BLOCKS)
    stored = cut(_packed(vectors, "id", VECTOR_BLOCK, ("ids", "v")))  # so that a task of pairs needs one worker
    met = stored.join(blocks, how="cross")  # of blocks; the queries are a stated set

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield _best_pairs(batch.slice(row, 1), k)

    found = met.mapInArrow(run, f"query_id {asked}, id {kind}, score double")
    return top_k(found, ["query_id"], "id", k)


def hashed_encoder(dims: int = 64) -> Callable[[DataFrame, str, str], DataFrame]:
    """The encoder that needs no model: hashed counts of tokens, of unit length. Other encoders are functions of the same form."""

    def encode(df: DataFrame, text: str, out: str) -> DataFrame:
        bins = F.transform(tokenize(F.col(text)), lambda t: F.pmod(F.xxhash64(t), F.lit(dims)).cast("int"))
        counted = df.withColumn("_bins", bins).withColumn("_count", F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter("_bins", lambda b: b == i)).cast("double")))
        norm = F.sqrt(F.aggregate("_count", F.lit(0.0), lambda s, x: s + x * x))
        unit = F.transform("_count", lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)).cast("float"))
        return counted.withColumn(out, unit).drop("_bins", "_count")

    return encode


#: What a worker has opened, by name; it serves one task after another.
_opened: dict[str, Callable[[list[str]], np.ndarray]] = {}


def model_encoder(name: str, opened: Callable[[], Callable[[list[str]], np.ndarray]], dims: int, batch: int = 512) -> Callable[[DataFrame, str, str], DataFrame]:
    """An encoder by a model that each worker opens once, whatever the number of its tasks.

    `opened` gives a function from texts to an array (n, dims). Of equal texts of an Arrow batch one is encoded; vectors are
    made unit length, and a model that returns another width is an error. Names tell models apart within a worker.
    """

    def encode(df: DataFrame, text: str, out: str) -> DataFrame:
        send_package(df.sparkSession)
        kept = [f for f in df.schema.fields if f.name != out]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from shelfrank.operators import dense  # the module of the worker, which outlives the task

            if name not in dense._opened:
                dense._opened[name] = opened()
            model = dense._opened[name]
            for rows in batches:
                coded = rows.column(len(kept)).fill_null("").dictionary_encode()
                texts = coded.dictionary.to_pylist()
                parts = [np.asarray(model(texts[i : i + batch]), np.float64).reshape(-1, dims) for i in range(0, len(texts), batch)]
                made = np.concatenate(parts) if parts else np.zeros((0, dims))
                if len(made) != len(texts):
                    raise ValueError(f"the model must give {dims} numbers for each text")
                length = np.linalg.norm(made, axis=1, keepdims=True)
                unit = (made / np.where(length > 0, length, 1)).astype(np.float32)[coded.indices.to_numpy()]
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, unit.size + 1, dims), pa.int32()), pa.array(unit.ravel()))
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(kept)], vectors], [*(f.name for f in kept), out])

        schema = StructType([*kept, StructField(out, ArrayType(FloatType()))])
        return df.select(*(F.col(f"`{f.name}`") for f in kept), F.col(f"`{text}`").cast("string").alias("_in")).mapInArrow(run, schema)

    return encode


def distinct_texts(encoder: Callable[[DataFrame, str, str], DataFrame]) -> Callable[[DataFrame, str, str], DataFrame]:
    """The encoder on each distinct text of a table once; rows get their text's vector by a join. For tables of queries, which repeat."""

    def encode(df: DataFrame, text: str, out: str) -> DataFrame:
        made = encoder(df.select(F.col(f"`{text}`").alias("_each")).distinct(), "_each", "_made")
        joined = df.drop(out).join(made.select("_each", F.col("_made").alias(out)), F.col(f"`{text}`").eqNullSafe(F.col("_each")), "left")
        return joined.drop("_each")

    return encode


def embed(df: DataFrame, text: str, encoder: Callable[[DataFrame, str, str], DataFrame], out: str = "vector", prefix: str = "passage: ") -> DataFrame:
    """df with a unit vector of each prefixed text."""
    return encoder(df.withColumn("_text", F.concat(F.lit(prefix), F.coalesce(norm_text(F.col(text)), F.lit("")))), "_text", out).drop("_text")


def upsert_vectors(old: DataFrame, new: DataFrame, key: str = "point_id") -> DataFrame:
    """The rows of new, and those of old that new doesn't replace."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def token_length_stats(lengths: DataFrame, limit: int, column: str = "n_tokens") -> DataFrame:
    """n, least, nearest-rank percentiles and greatest, and how many exceed the limit, as one row."""
    c = F.col(column)
    ranks = [F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY {column})").cast("int").alias(f"p{p}") for p in (50, 90, 95, 99)]
    over = F.count_if(c > limit)
    return lengths.agg(F.count("*").alias("n"), F.min(c).alias("min_tokens"), *ranks, F.max(c).alias("max_tokens"), over.alias("truncated"), F.round(over / F.count("*"), 6).alias("truncated_ratio"))
