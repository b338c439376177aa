"""From raw metadata, interactions and reviews to clean tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfrank.functions.text import norm_list, norm_text, parse_price, review_id
from shelfrank.sources.files import write_observed
from shelfrank.sources.shared import if_small, shared_dir

SPLITS = ("train", "valid", "test")

#: Reviews kept of an item, and how many of them are reserved for low ratings.
REVIEWS_KEPT, LOW_KEPT, LOW_RATING = 70, 14, 3.0


def split_order(c: Column | str = "split") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c == "train", 0).when(c == "valid", 1).otherwise(2)


def select_catalog(interactions: DataFrame, max_items: int | None = None) -> DataFrame:
    """parent_asin and train_count of the items of all splits, most trained first, ids break ties; the first max_items if given."""
    if max_items is not None and max_items <= 0:
        raise ValueError("max_items must be greater than zero")
    counted = interactions.groupBy("parent_asin").agg(F.count_if(F.col("split") == "train").alias("train_count"))
    return counted if max_items is None else counted.orderBy(F.desc("train_count"), "parent_asin").limit(max_items)


def keep_catalog(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows whose item is in the catalog."""
    return rows.join(catalog.select("parent_asin"), "parent_asin", "left_semi")


def dedupe_interactions(rows: DataFrame, order: list[Column | str]) -> DataFrame:
    """One row for each (user, item, rating, time): the first by split, then by the given order."""
    w = W.partitionBy("user_id", "parent_asin", "rating", "ts").orderBy(split_order(), *order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def time_bounds(rows: DataFrame) -> DataFrame:
    """First and last time of each user in each split."""
    return rows.groupBy("split", "user_id").agg(F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"))


def check_chronology(rows: DataFrame) -> DataFrame:
    """For each ordered pair of splits: users in both, and those whose earlier split ends after the later one begins."""
    wide = rows.groupBy("user_id").pivot("split", list(SPLITS)).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    pairs = [("train", "valid"), ("valid", "test"), ("train", "test")]
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("earlier"), F.lit(b).alias("later"), F.col(f"{a}_hi").alias("hi"), F.col(f"{b}_lo").alias("lo")) for a, b in pairs))).alias("x")
    return wide.select(each).where("x.hi is not null and x.lo is not null").groupBy("x.earlier", "x.later").agg(F.count("*").alias("comparisons"), F.count_if(F.col("x.hi") > F.col("x.lo")).alias("violations"))


def build_items(raw: DataFrame) -> DataFrame:
    """Item rows of raw metadata (parent_asin, title, store, price, main_category, categories, description, features, details VARIANT, bought_together)."""
    details = F.col("details")
    return raw.select(
        norm_text(F.col("parent_asin")).alias("parent_asin"),
        norm_text(F.col("title")).alias("title"),
        F.coalesce(norm_text(F.try_variant_get(details, "$.Brand", "string")), norm_text(F.col("store"))).alias("brand"),
        parse_price(F.col("price")).alias("price"),
        norm_text(F.col("main_category")).alias("main_category"),
        norm_list(F.col("categories")).alias("categories"),
        F.nullif(F.array_join(norm_list(F.col("description")), "\n"), F.lit("")).alias("description"),
        norm_list(F.col("features")).alias("features"),
        F.to_json(details).alias("details_json"),
        norm_list(F.col("bought_together")).alias("bought_together"),
    )


def attach_metadata(catalog: DataFrame, metadata: DataFrame, order: list[Column | str]) -> DataFrame:
    """Every catalog item with its first metadata row, or with nulls."""
    w = W.partitionBy("parent_asin").orderBy(*order)
    first = metadata.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return catalog.join(first, "parent_asin", "left")


def metadata_stats(catalog: DataFrame, metadata: DataFrame) -> DataFrame:
    """Items with metadata, without it, and metadata rows beyond the first, as one row."""
    counts = catalog.select("parent_asin").join(metadata.groupBy("parent_asin").agg(F.count("*").alias("n")), "parent_asin", "left")
    return counts.agg(F.count_if(F.col("n") >= 1).alias("matched"), F.count_if(F.col("n").isNull()).alias("missing"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate"))


def select_reviews(reviews: DataFrame, kept: int = REVIEWS_KEPT, low_kept: int = LOW_KEPT, seq: str = "seq") -> DataFrame:
    """The reviews kept of each item, with their position and whether the low-rating list gave them.

    Two lists of an item, by verified, helpful, time and later row first: at most low_kept with low ratings, at most kept of
    any. The lists follow each other, repeats of the identifying fields go, and what is left is cut at kept.
    """
    best = [F.desc(F.coalesce("verified_purchase", F.lit(False))), F.desc(F.coalesce("helpful_vote", F.lit(0))), F.desc("ts"), F.desc(seq)]
    usable = reviews.where(norm_text(F.col("text")).isNotNull())
    ranked = lambda df, cap: df.withColumn("place", F.row_number().over(W.partitionBy("parent_asin").orderBy(*best))).where(F.col("place") <= cap)
    both = ranked(usable.where(F.col("rating") <= LOW_RATING), min(low_kept, kept)).withColumn("block", F.lit(0)).unionByName(ranked(usable, kept).withColumn("block", F.lit(1)))
    fields = ["parent_asin", "asin", "user_id", "ts", "title", "text"]
    once = both.withColumn("_n", F.row_number().over(W.partitionBy(*fields).orderBy("block", "place"))).where("_n = 1")
    final = once.withColumn("position", F.row_number().over(W.partitionBy("parent_asin").orderBy("block", "place"))).where(F.col("position") <= kept)
    return final.withColumn("low_list", F.col("block") == 0).drop("_n", "block", "place")


def write_reviews(reviews: DataFrame, catalog: DataFrame, path: str, kept: int = REVIEWS_KEPT, low_kept: int = LOW_KEPT, seq: str = "seq") -> dict:
    """Writes the reviews kept of catalog items with their ids; returns the counters of the selection.

    The source is read once: its counters are observed while what can be kept is stored, the others while the result is.
    """
    if kept <= 0 or low_kept < 0:
        raise ValueError("kept must be more than zero, low_kept not negative")
    inside, text = F.coalesce("_inside", F.lit(False)), norm_text(F.col("text")).isNotNull()
    marked = reviews.join(if_small(catalog.select("parent_asin").distinct().withColumn("_inside", F.lit(True))), "parent_asin", "left")
    store = shared_dir(reviews.sparkSession)
    seen = Observation()
    counted = marked.observe(seen, F.count(F.lit(1)).alias("source_rows"), F.count_if(inside).alias("catalog_source_rows"), F.count_if(inside & ~text).alias("missing_text_rows"))
    counted.where(inside & text).drop("_inside").write.parquet(store)
    usable = reviews.sparkSession.read.schema(reviews.schema).parquet(store)
    final = with_review_ids(select_reviews(usable, kept, low_kept, seq))
    stats = seen.get | write_observed(final, path, retained_rows=F.count(F.lit(1)), items_with_reviews=F.count_if(F.col("position") == 1), low_rating_rows_retained=F.count_if(F.col("rating") <= LOW_RATING))
    eligible = stats["catalog_source_rows"] - stats["missing_text_rows"]
    return stats | {"eligible_text_rows": eligible, "filtered_by_limit_or_duplicate_rows": eligible - stats["retained_rows"], "low_rating_threshold": LOW_RATING}


def with_review_ids(reviews: DataFrame) -> DataFrame:
    return reviews.withColumn("review_id", review_id(*(F.col(c) for c in ("parent_asin", "asin", "user_id", "ts", "title", "text"))))


def preprocess_stats(source: DataFrame, catalog: DataFrame, order: list[Column | str]) -> DataFrame:
    """Per split: source rows, rows outside the catalog, repeats, retained rows and users."""
    inside = source.join(catalog.select("parent_asin").withColumn("inside", F.lit(True)), "parent_asin", "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    w = W.partitionBy("user_id", "parent_asin", "rating", "ts").orderBy(split_order(), *order)
    marked = inside.withColumn("first", F.row_number().over(w) == 1)
    kept = F.col("inside") & F.col("first")
    return marked.groupBy("split").agg(
        F.count("*").alias("source_rows"),
        F.count_if(~F.col("inside")).alias("filtered_rows"),
        F.count_if(F.col("inside") & ~F.col("first")).alias("duplicate_rows"),
        F.count_if(kept).alias("retained_rows"),
        F.count_distinct(F.when(kept, F.col("user_id"))).alias("users"),
    )
