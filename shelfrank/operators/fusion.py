"""Weighted reciprocal-rank fusion of recall channels, with filter policies and reasons."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfrank.operators.constraints import filter_reason

#: Channels in the order in which they are merged, those that search, and their weights by kind of user.
CHANNELS = ("dense", "bm25", "lightgcn", "popularity")
SEARCH = ("dense", "bm25")
KNOWN_USER = {"dense": 0.45, "bm25": 0.25, "lightgcn": 0.25, "popularity": 0.05}
COLD_START = {"dense": 0.65, "bm25": 0.30, "popularity": 0.05}
RRF_K = 60
#: What the channels' scores and the fused score are called.
SCORE_TYPES = {"dense": "dense_score", "bm25": "bm25_score", "popularity": "interaction_count"}
FUSED_TYPE = "weighted_rrf"
#: Columns of candidates that are kept by source where they are given.
CARRIED = ("score_type", "retrieval_query", "document")
#: Item columns that constraints read.
ITEM = ("brand", "price", "item_categories", "item_colors", "item_materials")
PLACES = 12


@dataclass(frozen=True)
class Fused:
    """What the fusion keeps, ranks and filters out."""

    final: DataFrame
    ranked: DataFrame
    filtered: DataFrame


def merge(candidates: DataFrame, beside: Sequence[str] = (), dealt: bool = False) -> DataFrame:
    """One row for each (request, item) of candidates (request_id, channel, rank, parent_asin, score): sources in order, ranks and scores by source.

    Types of scores, retrieval queries and documents are kept by source too; the latter two from the candidates' columns
    retrieval_query and document, if they have them, and without nulls.

    A channel's list is in the order of its optional column `place`, from 1; without that column in the order of rank, then
    item. Of repeats within a channel the last listed counts; a rank that is null or not positive is replaced by the place in
    the list. Columns `beside` are the item's, the same in each of its rows, and are kept.

    Rows are dealt by request once, unless they already are (`dealt`); all that follows leaves them where they are.
    """
    known = candidates.where(F.col("channel").isin(*CHANNELS))
    known = known if dealt else known.repartition("request_id")
    if "place" not in candidates.columns:
        listed = W.partitionBy("request_id", "channel").orderBy(F.asc_nulls_last("rank"), "parent_asin")
        known = known.withColumn("place", F.row_number().over(listed))
    known = known.withColumn("parent_asin", F.trim("parent_asin")).where(F.col("parent_asin") != "").withColumn("rank", F.when(F.col("rank") > 0, F.col("rank")).otherwise(F.col("place")))
    carried = [c for c in CARRIED if c in candidates.columns]
    entry = lambda i, c: F.struct(F.lit(i).alias("o"), F.lit(c).alias("channel"), "rank", "score", *carried)
    last = [F.max_by(entry(i, c), F.when(F.col("channel") == c, F.coalesce("place", F.lit(0)))).alias(f"_{c}") for i, c in enumerate(CHANNELS, 1)]
    kept = [F.first(c).alias(c) for c in beside]
    grouped = known.groupBy("request_id", "parent_asin").agg(*last, *kept).withColumn("e", F.filter(F.array(*(f"_{c}" for c in CHANNELS)), lambda x: x.isNotNull()))
    pick = lambda name: F.transform("e", lambda x: x[name])
    texts = "map<string,string>"
    given = lambda name: F.map_filter(F.map_from_arrays(pick("channel"), pick(name)), lambda _, v: v.isNotNull()) if name in carried else F.create_map().cast(texts)
    usual = F.create_map(*(F.lit(x) for pair in SCORE_TYPES.items() for x in pair))
    types = F.map_from_arrays(pick("channel"), pick("score_type") if "score_type" in carried else F.transform("e", lambda x: F.element_at(usual, x["channel"])))
    return grouped.select(
        "request_id", "parent_asin", "e", *beside,
        pick("channel").alias("sources"), F.map_from_arrays(pick("channel"), pick("rank")).alias("source_ranks"), F.map_from_arrays(pick("channel"), pick("score")).alias("source_scores"),
        types.cast(texts).alias("source_score_types"), given("retrieval_query").cast(texts).alias("retrieval_queries"), given("document").cast(texts).alias("documents"),
    )


def _weights(known: Column) -> Column:
    table = lambda w: F.create_map(*(x for k, v in w.items() for x in (F.lit(k), F.lit(v))))
    return F.when(known, table(KNOWN_USER)).otherwise(table(COLD_START))


def describe(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """Candidates with the columns of their items, which are joined while rows are narrow."""
    named = items.withColumnRenamed("parent_asin", "_item")
    return candidates.join(named, F.trim(candidates["parent_asin"]) == F.col("_item"), "left").drop("_item")


def fuse(candidates: DataFrame, requests: DataFrame, items: DataFrame | None, rrf_k: int = RRF_K) -> Fused:
    """Fusion of candidates under the constraints of requests (request_id, known_user, top_k and constraint columns) with item columns.

    Without items, candidates have the item columns ITEM themselves (see `describe`) and are dealt by request.

    Items seen by a search channel are checked for category, price and brand; the others for all constraints, and they need a
    category tag. Where requests have a search_query, it is the retrieval query of search channels that candidates don't name. The score sums weight / (rrf_k + rank) in the order of the channels; items whose sources have no weight are
    not ranked. Ties: the least rank of any source, then the id.
    """
    if rrf_k < 0:
        raise ValueError("rrf_k must not be negative")
    described = candidates if items is None else describe(candidates, items.select("parent_asin", *ITEM))
    joined = merge(described, ITEM, items is None).join(requests, "request_id")
    search = F.arrays_overlap("sources", F.array(*map(F.lit, SEARCH)))
    reason = F.when(search, filter_reason(False)).when(F.size(F.coalesce("category_tags", F.array().cast("array<string>"))) == 0, "missing_category_constraint").otherwise(filter_reason(True))
    if "search_query" in requests.columns:
        found = F.filter("sources", lambda c: c.isin(*SEARCH) & F.col("search_query").isNotNull() & ~F.map_contains_key("retrieval_queries", c))
        joined = joined.withColumn("retrieval_queries", F.map_concat("retrieval_queries", F.map_from_arrays(found, F.transform(found, lambda _: F.col("search_query")))))
    judged = joined.withColumn("filter_policy", F.when(search, "search").otherwise("personalized")).withColumn("filter_reason", reason)
    filtered = judged.where("filter_reason is not null").select("request_id", "parent_asin", "sources", "source_ranks", "source_scores", "filter_policy", "filter_reason")
    weights = _weights(F.col("known_user"))
    scored = (
        judged.where("filter_reason is null")
        .withColumn("w", weights)
        .withColumn("parts", F.filter(F.transform("e", lambda x: F.struct(x["channel"].alias("channel"), (F.element_at("w", x["channel"]) / (F.lit(rrf_k) + x["rank"])).alias("value"))), lambda p: p["value"].isNotNull()))
        .where(F.size("parts") > 0)
        .withColumn("score", F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["value"]))
        .withColumn("best_rank", F.array_min(F.transform("e", lambda x: x["rank"])))
    )
    rank = F.row_number().over(W.partitionBy("request_id").orderBy(F.desc(F.round("score", PLACES)), "best_rank", "parent_asin"))
    ranked = scored.withColumn("rank", rank).select(
        "request_id", "parent_asin", "rank", "score", "sources", "source_ranks", "source_scores",
        F.map_filter("w", lambda k, _: F.array_contains("sources", k)).alias("source_weights"),
        F.map_from_entries("parts").alias("rrf_contributions"), "best_rank", "top_k",
        F.lit(FUSED_TYPE).alias("score_type"), "source_score_types", "retrieval_queries", "documents",
        F.coalesce(*(F.try_element_at("retrieval_queries", F.lit(c)) for c in CHANNELS)).alias("retrieval_query"),
    )
    return Fused(ranked.where(F.col("rank") <= F.col("top_k")), ranked, filtered)
