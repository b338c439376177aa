"""The review evidence index, kept up to date by a stream of review files.

A target folder holds `base-n` (all chunks up to a batch, clustered by product), `deltas` (a folder for each later batch),
`counters` and `items` (a row and the new products of each batch) and `versions` (which base holds what). Readers take the
newest version and merge the deltas behind it; `compact` makes them a new base.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from shelfrank.functions.text import norm_text, point_id, review_text, word_count, word_windows
from shelfrank.operators import chunking
from shelfrank.operators.chunking import Splitter
from shelfrank.operators.dense import embed
from shelfrank.sources.shared import delete, if_small, path_exists

#: The namespace of chunk ids, and the fields of a chunk.
NAMESPACE = "d905ef4d-b156-43e9-a02c-00e439a1f17d"
PAYLOAD = ("parent_asin", "review_id", "chunk_id", "rating", "title", "text", "chunk_text", "helpful_vote", "verified_purchase", "timestamp")

#: Folders that products are dealt into in a base.
BUCKETS = 64

COUNTERS = "seen long, skipped long, split long, chunks long, new_items long"


def usable_reviews(reviews: DataFrame) -> DataFrame:
    """Reviews with both ids and anything to show, with `_shown`, their rendered text."""
    shown = _shown(reviews)
    return shown.where(F.col("_shown").isNotNull())


def _shown(reviews: DataFrame) -> DataFrame:
    """All reviews with `_shown`, their rendered text; null where a review lacks an id or anything to show."""
    ids = norm_text(F.col("review_id")).isNotNull() & norm_text(F.col("parent_asin")).isNotNull()
    text = review_text(F.col("title"), F.col("rating"), F.col("text"))
    return reviews.withColumn("_shown", F.when(ids & norm_text(text).isNotNull(), text))


def _chunked(reviews: DataFrame, splitter: Splitter | None, size: int, overlap: int) -> DataFrame:
    """All reviews with `_chunks`; a review that isn't usable has null, one that a splitter leaves nothing of has its whole text."""
    shown = _shown(reviews)
    if splitter is None:
        return shown.withColumn("_chunks", F.when(F.col("_shown").isNotNull(), word_windows(F.col("_shown"), size, overlap)))
    parts = chunking.split_text(shown, "_shown", splitter, "_chunks")
    whole = F.when(F.size("_chunks") > 0, F.col("_chunks")).otherwise(F.array("_shown"))
    return parts.withColumn("_chunks", F.when(F.col("_shown").isNotNull(), whole))


def _payload(chunked: DataFrame) -> DataFrame:
    """The ten fields of every chunk; a review's time is its column timestamp, or else ts."""
    time = "timestamp" if "timestamp" in chunked.columns else "ts"
    parts = chunked.select("*", F.posexplode("_chunks").alias("_i", "_chunk"))
    made = {
        "review_id": norm_text(F.col("review_id")),
        "parent_asin": norm_text(F.col("parent_asin")),
        "chunk_id": F.concat(norm_text(F.col("review_id")), F.lit("#chunk_"), F.col("_i")),
        "chunk_text": F.concat(F.lit("passage: "), F.col("_chunk")),
        "timestamp": F.col(time),
    }
    return parts.select(*(made.get(c, F.col(c)).alias(c) for c in PAYLOAD))


def chunk_stats(reviews: DataFrame, size: int = 384, overlap: int = 64) -> DataFrame:
    """reviews, skipped (without ids or text), split (more than one chunk) and chunks, as one row; windows are counted from the number of words."""
    words = word_count(F.col("_shown"))
    windows = F.greatest(F.ceil((words - overlap) / F.lit(size - overlap)), F.lit(1))
    n = F.when(F.col("_shown").isNotNull(), windows)
    return _shown(reviews).agg(F.count("*").alias("reviews"), F.count_if(F.col("_shown").isNull()).alias("skipped"), F.count_if(n > 1).alias("split"), F.coalesce(F.sum(n), F.lit(0)).alias("chunks"))


def chunk_reviews(reviews: DataFrame, size: int = 384, overlap: int = 64, splitter: Splitter | None = None) -> DataFrame:
    """The ten payload fields of each chunk of usable reviews: windows of words, or a splitter's chunks."""
    return _payload(_chunked(reviews, splitter, size, overlap))


def split_text(df: DataFrame, text: str, size: int, overlap: int, length: Callable[[str], int] = len) -> DataFrame:
    """df with chunks (array), by a measure of single texts; `chunking.split_text` takes one of many."""
    return chunking.split_text(df, text, Splitter(size, overlap, lambda: lambda texts: [length(t) for t in texts]))


def product_bucket(product: Column | str, buckets: int = BUCKETS) -> Column:
    """The folder of a product in a base."""
    return F.pmod(F.xxhash64(product), F.lit(buckets)).cast("int")


def build_evidence_incremental(spark: SparkSession, source: str, target: str, checkpoint: str, encoder: Callable, schema: str, files_per_batch: int = 8, recreate: bool = False, size: int = 384, overlap: int = 64, splitter: Splitter | None = None, compact_after: int = 16) -> dict:
    """Chunks and embeds review files that were not read yet; returns what all runs together have counted.

    A batch reads nothing but its own files: its counters are observed while its chunks are written. A batch that is run again after
    a failure writes its folders again, so nothing is doubled or counted twice. Once `compact_after` batches lie behind the
    newest base they become a new one.
    """
    if recreate:
        for path in (target, checkpoint):
            delete(spark, path)

    def write(batch: DataFrame, number: int) -> None:
        seen = Observation()
        n = F.size("_chunks")
        counted = _chunked(batch, splitter, size, overlap).observe(seen, F.count(F.lit(1)).alias("seen"), F.count_if(F.col("_chunks").isNull()).alias("skipped"), F.count_if(n > 1).alias("split"), F.coalesce(F.sum(F.when(F.col("_chunks").isNotNull(), n)), F.lit(0)).alias("chunks"))
        chunks = embed(_payload(counted), "chunk_text", encoder, "embedding", "")
        chunks.withColumn("point_id", point_id(NAMESPACE, F.col("chunk_id"))).write.mode("overwrite").parquet(f"{target}/deltas/batch={number}")
        products = batch.select(norm_text(F.col("parent_asin")).alias("parent_asin")).where("parent_asin is not null").distinct()
        if number and path_exists(spark, f"{target}/items"):
            products = products.join(_batches(spark, f"{target}/items", "parent_asin string").where(F.col("batch") < number), "parent_asin", "left_anti")
        products.write.mode("overwrite").parquet(f"{target}/items/batch={number}")
        new_items = spark.read.schema("parent_asin string").parquet(f"{target}/items/batch={number}").count()
        got = seen.get
        row = (*(int(got[c]) for c in ("seen", "skipped", "split", "chunks")), new_items)
        spark.createDataFrame([row], COUNTERS).coalesce(1).write.mode("overwrite").parquet(f"{target}/counters/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if pending(spark, target) >= compact_after:
        compact(spark, target)
    return build_counters(spark, target)


def _batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all batches below path, with the number of each."""
    return spark.read.schema(f"{schema}, batch int").parquet(path)


def build_counters(spark: SparkSession, target: str) -> dict:
    """seen, skipped, split, chunks, items and reviews (seen without skipped) of all batches, from one row each."""
    if not path_exists(spark, f"{target}/counters"):
        return dict.fromkeys(("seen", "skipped", "split", "chunks", "items", "reviews"), 0)
    rows = _batches(spark, f"{target}/counters", COUNTERS)
    row = rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("seen", "skipped", "split", "chunks", "new_items"))).first().asDict()
    row["items"] = row.pop("new_items")
    return row | {"reviews": row["seen"] - row["skipped"]}


def _version(spark: SparkSession, target: str) -> tuple[int, int]:
    """The newest base, and the last batch that it holds; 0 and -1 where there is none."""
    if not path_exists(spark, f"{target}/versions"):
        return 0, -1
    row = spark.read.schema("through int, version int").parquet(f"{target}/versions").agg(F.max(F.struct("version", "through")).alias("x")).first().x
    return (row.version, row.through) if row else (0, -1)


def pending(spark: SparkSession, target: str) -> int:
    """How many batches lie behind the newest base."""
    if not path_exists(spark, f"{target}/counters"):
        return 0
    return _batches(spark, f"{target}/counters", COUNTERS).where(F.col("batch") > _version(spark, target)[1]).count()


def _deltas(spark: SparkSession, target: str, through: int) -> DataFrame | None:
    """The newest row of every chunk of the batches behind a base."""
    if not path_exists(spark, f"{target}/deltas"):
        return None
    rows = spark.read.parquet(f"{target}/deltas").where(F.col("batch") > through)
    newest = rows.groupBy("point_id").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["point_id", "batch"], "left_semi")


def read_evidence_index(spark: SparkSession, target: str) -> DataFrame:
    """The newest row of every chunk: those of the base that no later batch replaces, and those of later batches."""
    version, through = _version(spark, target)
    late = _deltas(spark, target, through)
    if not version and late is None:
        raise ValueError(f"no index at {target}")
    if not version:
        return late.withColumn("bucket", product_bucket("parent_asin"))
    base = spark.read.parquet(f"{target}/base-{version}")
    if late is None or not pending(spark, target):
        return base
    late = late.withColumn("bucket", product_bucket("parent_asin"))
    return base.join(if_small(late.select("point_id")), "point_id", "left_anti").unionByName(late.select(*base.columns))


def compact(spark: SparkSession, target: str) -> int:
    """Makes base and deltas a new base, whose folders hold whole products in order; returns its version.

    The new version is named last, so a reader finds the old or the new state and a failure leaves the old one. The base
    before stays for readers that have begun; the one before that goes.
    """
    version, _ = _version(spark, target)
    last = _batches(spark, f"{target}/counters", COUNTERS).agg(F.max("batch")).first()[0]
    new = version + 1
    rows = read_evidence_index(spark, target)
    # a popular product is spread over files of its folder
    spread = rows.repartition("bucket", F.pmod(F.xxhash64("point_id"), F.lit(4))).sortWithinPartitions("bucket", "parent_asin", "chunk_id")
    spread.write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/base-{new}")
    spark.createDataFrame([(last,)], "through int").coalesce(1).write.mode("overwrite").parquet(f"{target}/versions/version={new}")
    if new > 2:
        delete(spark, f"{target}/base-{new - 2}")
    return new
