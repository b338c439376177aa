"""The catalogue's tables (items, interactions, splits, reviews, chunks) read from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read_table(spark: SparkSession, root: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """One Parquet table, or some of its columns."""
    df = spark.read.parquet(f"{root}/{name}.parquet")
    return df.select(*columns) if columns else df


def items(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "part").select(
        F.col("p_partkey").cast("string").alias("parent_asin"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("brand"),
        F.when(F.col("p_partkey") % 3 != 0, F.col("p_retailprice")).alias("price"),
        F.col("p_type").alias("category"),
        F.split_part("p_name", F.lit(" "), F.lit(1)).alias("color"),
    )


def interactions(spark: SparkSession, root: str) -> DataFrame:
    lines = read_table(spark, root, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"])
    orders = read_table(spark, root, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").cast("string").alias("user_id"),
        F.col("l_partkey").cast("string").alias("parent_asin"),
        (F.lit(1) + F.col("l_quantity").cast("int") % 5).cast("double").alias("rating"),
        F.datediff("o_orderdate", F.lit("1990-01-01").cast("date")).cast("long").alias("ts"),
        "l_orderkey",
        "l_linenumber",
    )


def splits(spark: SparkSession, root: str) -> DataFrame:
    """One row for each user and item; a user's last item is for test, the one before for validation."""
    pairs = interactions(spark, root).groupBy("user_id", "parent_asin").agg(F.min("rating").alias("rating"), F.min("ts").alias("ts"))
    rn = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("parent_asin")))
    split = F.when(rn == 1, "test").when(rn == 2, "valid").otherwise("train")
    return pairs.withColumn("split", split)


def reviews(spark: SparkSession, root: str) -> DataFrame:
    i = F.col("doc_id")
    return read_table(spark, root, "documents", ["doc_id", "source", "text"]).select(
        F.concat(F.lit("d"), i.cast("string")).alias("asin"),
        (i % 50).cast("string").alias("parent_asin"),
        (i % 97).cast("string").alias("user_id"),
        (F.lit(1) + (i * 7) % 5).cast("double").alias("rating"),
        (i * 1000).alias("ts"),
        F.col("source").alias("title"),
        "text",
        ((i * 13) % 7).alias("helpful_vote"),
        (i % 3 != 0).alias("verified_purchase"),
    )


def chunks(spark: SparkSession, root: str) -> DataFrame:
    """Review chunks with vectors: ten products, a hundred reviews."""
    v = F.col("vec_id")
    return read_table(spark, root, "embeddings").select(
        "vec_id",
        F.col("label").cast("string").alias("parent_asin"),
        F.concat(F.lit("r"), (v % 100).cast("string")).alias("review_id"),
        F.concat(F.lit("r"), (v % 100).cast("string"), F.lit("#chunk_"), v.cast("string")).alias("chunk_id"),
        (F.lit(1) + v % 100 % 5).cast("double").alias("rating"),
        "embedding",
    )


#: The same tables in SQL, as common table expressions.
SQL = {
    "items": "items AS (SELECT CAST(p_partkey AS VARCHAR) AS parent_asin, p_name AS title, p_brand AS brand, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_retailprice END AS price, p_type AS category, split_part(p_name, ' ', 1) AS color FROM part)",
    "interactions": "interactions AS (SELECT CAST(o_custkey AS VARCHAR) AS user_id, CAST(l_partkey AS VARCHAR) AS parent_asin, CAST(1 + CAST(floor(l_quantity) AS INT) % 5 AS DOUBLE) AS rating, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS ts, l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey)",
    "splits": "splits AS (SELECT user_id, parent_asin, rating, ts, CASE WHEN rn = 1 THEN 'test' WHEN rn = 2 THEN 'valid' ELSE 'train' END AS split FROM (SELECT user_id, parent_asin, MIN(rating) AS rating, MIN(ts) AS ts, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY MIN(ts) DESC, parent_asin DESC) AS rn FROM interactions GROUP BY user_id, parent_asin) x)",
    "reviews": "reviews AS (SELECT concat('d', CAST(doc_id AS VARCHAR)) AS asin, CAST(doc_id % 50 AS VARCHAR) AS parent_asin, CAST(doc_id % 97 AS VARCHAR) AS user_id, CAST(1 + (doc_id * 7) % 5 AS DOUBLE) AS rating, doc_id * 1000 AS ts, source AS title, text, (doc_id * 13) % 7 AS helpful_vote, doc_id % 3 <> 0 AS verified_purchase FROM documents)",
    "chunks": "chunks AS (SELECT vec_id, CAST(label AS VARCHAR) AS parent_asin, concat('r', CAST(vec_id % 100 AS VARCHAR)) AS review_id, concat('r', CAST(vec_id % 100 AS VARCHAR), '#chunk_', CAST(vec_id AS VARCHAR)) AS chunk_id, CAST(1 + vec_id % 100 % 5 AS DOUBLE) AS rating, embedding FROM embeddings)",
}


def with_sql(*names: str, more: str = "") -> str:
    """WITH and the named tables; those that others need must be named before them."""
    return "WITH RECURSIVE " + ", ".join([*(SQL[n] for n in names), *[more] * bool(more)]) + " "
