"""Popularity recommendations and ranking metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfrank.operators.graph import graph_hits
from shelfrank.sources.shared import cut, if_small

#: Most popular items that users' histories are held against at first.
LISTED = 4096


def item_counts(train: DataFrame) -> DataFrame:
    return train.groupBy("parent_asin").agg(F.count("*").alias("n"))


def user_history(rows: DataFrame) -> DataFrame:
    return rows.select("user_id", "parent_asin").distinct()


def ranked_items(counts: DataFrame, most: int) -> DataFrame:
    """The `most` most frequent of counted items (parent_asin, n) with their rank; ids break ties. Sorted as a top list, so only these reach one task."""
    top = counts.orderBy(F.desc("n"), "parent_asin").limit(most)
    return top.select("parent_asin", F.col("n").alias("score"), F.row_number().over(W.orderBy(F.desc("n"), "parent_asin")).alias("rank"))


def popularity_top_k(train: DataFrame, users: DataFrame, k: int = 10, exclude: DataFrame | None = None, listed: int = LISTED) -> DataFrame:
    """user_id, parent_asin, rank, score: each user's k most popular items without those of their history and of `exclude`.

    A user who has t of the first `listed` items finds k others among the first k + t, so what is looked up is which ranks
    of one short list a user has; the list is sent to all tasks. Only users who have nearly all of it look again at a longer one.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    seen = user_history(train)
    if exclude is not None:
        seen = seen.unionByName(exclude.select("user_id", "parent_asin"))
    counts, left = cut(item_counts(train)), cut(users.select("user_id").distinct())
    asked = if_small(left)
    seen = cut((seen.join(asked, "user_id", "left_semi") if asked is not left else seen).distinct())  # a few users' histories alone
    items, out, listed = counts.count(), None, max(listed, k + 1)
    while True:
        top = if_small(cut(ranked_items(counts, listed)))
        taken = seen.join(top, "parent_asin").groupBy("user_id").agg(F.collect_list("rank").alias("taken"))
        ranks = F.coalesce("taken", F.array().cast("array<int>"))
        open_ranks = F.array_except(F.sequence(F.lit(1), F.size(ranks) + F.lit(max(k, 1))), ranks)
        offered = left.join(taken, "user_id", "left").select("user_id", F.size(ranks).alias("n"), F.slice(open_ranks, 1, k).alias("open"))
        complete = (F.col("n") + k <= listed) | F.lit(listed >= items)
        if listed < items:
            offered = cut(offered)
        found = offered.where(complete).select("user_id", F.posexplode("open").alias("at", "rank")).join(top, "rank").select("user_id", "parent_asin", (F.col("at") + 1).alias("rank"), "score")
        out = found if out is None else out.unionByName(found)
        if listed >= items:
            return out
        left = cut(offered.where(~complete).select("user_id"))
        if left.isEmpty():
            return out
        listed *= 16


def ranking_metrics(targets: DataFrame, recommended: DataFrame, k: int) -> DataFrame:
    """users, recall, ndcg, hit_rate: means over all users of targets (user_id, parent_asin) of recommended (user_id, parent_asin, rank)."""
    hits = targets.select("user_id", "parent_asin").distinct().join(recommended.select("user_id", "parent_asin", "rank"), ["user_id", "parent_asin"], "left")
    gain = F.lit(1.0) / F.log2(F.col("rank") + 1.0)
    user = hits.groupBy("user_id").agg(F.count("*").alias("relevant"), F.count("rank").alias("hit"), F.coalesce(F.sum(gain), F.lit(0.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("relevant").cast("int"), F.lit(k))), F.lit(0.0), lambda s, i: s + F.lit(1.0) / F.log2(i + 1.0))
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    return user.agg(
        F.count("*").alias("users"),
        mean(F.col("hit") / F.col("relevant")).alias("recall"),
        mean(F.col("dcg") / ideal).alias("ndcg"),
        mean((F.col("hit") > 0).cast("double")).alias("hit_rate"),
    )


def evaluate_popularity(splits: DataFrame, split: str, k: int = 10) -> DataFrame:
    """Metrics on a split; its users' items of earlier splits are excluded."""
    earlier = {"valid": ["train"], "test": ["train", "valid"]}[split]
    splits = cut(splits.select("user_id", "parent_asin", "split"))  # read four times
    train, targets = splits.where("split = 'train'"), splits.where(F.col("split") == split)
    found = popularity_top_k(train, targets, k, splits.where(F.col("split").isin(earlier)))
    return ranking_metrics(targets, found, k).select(F.lit("popularity").alias("model"), F.lit(split).alias("split"), F.lit(k).alias("k"), "*")


def evaluate_graph(vectors: DataFrame, splits: DataFrame, split: str, k: int = 10) -> DataFrame:
    """Metrics of the graph model's node vectors on a split, as in evaluate_popularity(). Splits are read three times, so they should be a written table."""
    earlier = {"valid": ["train"], "test": ["train", "valid"]}[split]
    targets = cut(splits.where(F.col("split") == split).select("user_id", "parent_asin"))
    found = graph_hits(vectors, targets, splits.where(F.col("split").isin(earlier)).select("user_id", "parent_asin"), k)
    return ranking_metrics(targets, found, k).select(F.lit("lightgcn").alias("model"), F.lit(split).alias("split"), F.lit(k).alias("k"), "*")


def merge_metrics(metrics: DataFrame, ks: list[int]) -> DataFrame:
    """One row for each (model, split): the metrics at each k side by side."""
    keys = metrics.groupBy("model", "split").pivot("k", ks).agg(F.first("recall").alias("recall"), F.first("ndcg").alias("ndcg"), F.first("hit_rate").alias("hit_rate"))
    names = [(f"{k}_{m}", f"{m}_at_{k}") for m in ("recall", "ndcg", "hit_rate") for k in ks]
    users = metrics.groupBy("model", "split").agg(F.max("users").alias("users"))
    return keys.join(users, ["model", "split"]).select("model", "split", "users", *(F.col(a).alias(b) for a, b in names))
