"""Human audits of retrieval: checks, summaries and pairwise comparison of channels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ["channel", "query_id"]


def validate_audit_scores(rows: DataFrame, channels: tuple[str, ...]) -> DataFrame:
    """Rows that break a rule of single rows, with the rule."""
    relevance = F.col("human_relevance").try_cast("int")
    rank = F.col("rank").try_cast("int")
    error = (
        F.when(~F.coalesce(F.col("channel").isin(*channels), F.lit(False)), "unknown channel")
        .when(F.coalesce(F.trim("query_id"), F.lit("")) == "", "blank query_id")
        .when(F.coalesce(F.trim("parent_asin"), F.lit("")) == "", "blank parent_asin")
        .when(relevance.isNull() | ~relevance.isin(0, 1, 2), "relevance is not 0, 1 or 2")
        .when(rank.isNull() | (rank <= 0), "rank is not positive")
    )
    return rows.withColumn("error", error).where("error is not null")


def validate_audit(scores: DataFrame, k: int) -> DataFrame:
    """(channel, query_id, error) of lists that repeat a rank or item or don't have ranks 1 to k, and of queries that a channel lacks."""
    top = scores.where(F.col("rank") <= k)
    lists = top.groupBy(*KEY).agg(F.count("*").alias("n"), F.count_distinct("rank").alias("ranks"), F.count_distinct("parent_asin").alias("items"))
    bad = lists.withColumn("error", F.when(F.col("n") != F.col("ranks"), "repeated rank").when(F.col("n") != F.col("items"), "repeated item").when(F.col("ranks") != k, "not ranks 1 to k")).where("error is not null")
    every = top.select("channel").distinct().withColumn("one", F.lit(1)).join(top.select("query_id").distinct().withColumn("one", F.lit(1)), "one")  # channels are few
    lacking = every.join(lists, KEY, "left_anti").withColumn("error", F.lit("query is missing"))
    return bad.select(*KEY, "error").unionByName(lacking.select(*KEY, "error"))


def per_query(scores: DataFrame, k: int) -> DataFrame:
    """Measures of each list: graded nDCG, mean relevance, shares of grades, reciprocal ranks at two strengths."""
    top = scores.where(F.col("rank") <= k)
    ideal_rank = F.row_number().over(W.partitionBy(*KEY).orderBy(F.desc("human_relevance"), "rank"))
    gain = F.pow(F.lit(2.0), F.col("human_relevance")) - 1
    ranked = top.withColumn("ideal_rank", ideal_rank)
    found = lambda least: F.coalesce(F.max(F.when(F.col("human_relevance") >= least, F.lit(1.0) / F.col("rank"))), F.lit(0.0))
    share = lambda test: F.avg(test.cast("double"))
    rows = ranked.groupBy(*KEY).agg(
        F.sum(gain / F.log2(F.col("rank") + 1.0)).alias("dcg"),
        F.sum(gain / F.log2(F.col("ideal_rank") + 1.0)).alias("ideal"),
        F.avg(F.col("human_relevance").cast("double")).alias("mean_relevance"),
        share(F.col("human_relevance") == 2).alias("excellent_rate"),
        share(F.col("human_relevance") >= 1).alias("acceptable_rate"),
        share(F.col("human_relevance") == 0).alias("bad_rate"),
        found(2).alias("mrr_strict"),
        found(1).alias("mrr_loose"),
    )
    return rows.withColumn("ndcg", F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0)).drop("dcg", "ideal")


MEASURES = ("mean_relevance", "excellent_rate", "acceptable_rate", "bad_rate", "ndcg", "mrr_strict", "mrr_loose")


def audit_summary(scores: DataFrame, k: int) -> DataFrame:
    """Means over queries by channel."""
    return per_query(scores, k).groupBy("channel").agg(F.count("*").alias("queries"), *(F.round(F.avg(m), 6).alias(m) for m in MEASURES))


def pairwise_wins(scores: DataFrame, k: int) -> DataFrame:
    """For each ordered pair of channels: queries won, lost and tied by (nDCG, mean relevance)."""
    lists = per_query(scores, k).select("channel", "query_id", F.struct(F.round("ndcg", 9).alias("n"), F.round("mean_relevance", 9).alias("m")).alias("x"))
    other = lists.select(F.col("channel").alias("against"), "query_id", F.col("x").alias("y"))
    both = lists.join(other, "query_id").where("channel <> against")
    return both.groupBy("channel", "against").agg(F.count_if(F.expr("x > y")).alias("wins"), F.count_if(F.expr("x < y")).alias("losses"), F.count_if(F.expr("x = y")).alias("ties"))
