"""Profiles of the clean tables: quality, brands, distributions, label overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfrank.functions.text import norm_key, norm_text

#: Upper bounds of the buckets of interactions per user.
BUCKETS = ((1, 5, "1-5"), (6, 10, "6-10"), (11, 20, "11-20"), (21, 50, "21-50"), (51, 100, "51-100"), (101, 200, "101-200"), (201, None, "201+"))
#: Exact, substitute, complement, irrelevant.
LABELS = ("E", "S", "C", "I")
PERCENTILES = (10, 25, 50, 75, 90, 95, 99)


def quality_report(items: DataFrame, fields: list[str]) -> DataFrame:
    """Rows, and how many lack each field (null or empty), one row a field."""
    empty = lambda c: F.count_if(F.col(c).isNull() | (F.col(c).cast("string") == "")).alias(c)
    wide = items.agg(F.count("*").alias("rows"), *(empty(c) for c in fields))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("missing")) for c in fields))).alias("x")
    return wide.select("rows", each).select("x.field", "rows", "x.missing", F.round(F.col("x.missing") / F.col("rows"), 6).alias("missing_ratio"))


def brand_stats(items: DataFrame, seq: Column | str) -> DataFrame:
    """Brands by key: the first spelling and item seen, count, share of all rows."""
    keyed = items.select(norm_key(F.col("brand")).alias("brand_key"), norm_text(F.col("brand")).alias("brand"), "parent_asin", (F.col(seq) if isinstance(seq, str) else seq).alias("seq"))
    total = items.agg(F.count("*").alias("total"))
    groups = keyed.where("brand_key is not null").groupBy("brand_key").agg(F.min_by("brand", "seq").alias("brand"), F.min_by("parent_asin", "seq").alias("example"), F.count("*").alias("n"))
    return groups.join(F.broadcast(total), how="cross").select("brand_key", "brand", "example", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))  # one row


def user_distribution(rows: DataFrame, key: str = "user_id") -> DataFrame:
    """Rows per key: mean, deviation, extremes, interpolated percentiles and mode, as one row."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    return counts.agg(
        F.count("*").alias("users"),
        F.round(F.avg("n"), 6).alias("mean"),
        F.round(F.stddev_samp("n"), 6).alias("sd"),
        F.min("n").alias("least"),
        *(F.round(F.percentile("n", p / 100), 6).alias(f"p{p}") for p in PERCENTILES),
        F.max("n").alias("greatest"),
        F.mode("n", True).alias("mode"),
    )


def user_buckets(rows: DataFrame, key: str = "user_id") -> DataFrame:
    """Keys by bucket of their rows, with the bucket's share."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    name = F.lit(None).cast("string")
    for low, high, label in BUCKETS:
        name = F.when((F.col("n") >= low) & (F.lit(high is None) | (F.col("n") <= (high or 0))), label).otherwise(name)
    total = counts.agg(F.count("*").alias("total"))
    return counts.groupBy(name.alias("bucket")).agg(F.count("*").alias("users")).join(F.broadcast(total), how="cross").select("bucket", "users", F.round(F.col("users") / F.col("total"), 6).alias("share"))  # one row


def rating_distribution(reviews: DataFrame) -> DataFrame:
    total = reviews.agg(F.count("*").alias("total"))
    return reviews.groupBy("rating").agg(F.count("*").alias("n")).join(F.broadcast(total), how="cross").select("rating", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))  # one row


def verified_share(reviews: DataFrame, interactions: DataFrame, catalog: DataFrame) -> DataFrame:
    """Shares of verified reviews and of ratings above 4: of all, of those that are interactions (by user, item, rating, time), of the catalog's."""
    keys = ["user_id", "parent_asin", "rating", "ts"]
    scopes = {"all": reviews, "interactions": reviews.join(interactions.select(*keys).distinct(), keys, "left_semi"), "catalog": reviews.join(catalog.select("parent_asin"), "parent_asin", "left_semi")}
    out = None
    for name, df in scopes.items():
        row = df.agg(F.lit(name).alias("scope"), F.count("*").alias("n"), F.round(F.avg(F.col("verified_purchase").cast("double")), 6).alias("verified"), F.round(F.avg((F.col("rating") > 4).cast("double")), 6).alias("above_four"))
        out = row if out is None else out.unionByName(row)
    return out


def variant_map(rows: DataFrame) -> DataFrame:
    """asin and its parent where only one parent was seen."""
    return rows.groupBy("asin").agg(F.count_distinct("parent_asin").alias("n"), F.min("parent_asin").alias("parent_asin")).where("n = 1").drop("n")


def resolve_products(labels: DataFrame, variants: DataFrame, items: DataFrame) -> DataFrame:
    """labels with parent_asin: by variant, or where the product is itself a parent; null if neither."""
    own = items.select(F.col("parent_asin").alias("product_id"), F.col("parent_asin").alias("_own"))
    of = variants.select(F.col("asin").alias("product_id"), F.col("parent_asin").alias("_of"))
    of, own = of.hint("shuffle_hash"), own.hint("shuffle_hash")  # labels, the many, are not sorted
    return labels.join(of, "product_id", "left").join(own, "product_id", "left").withColumn("parent_asin", F.coalesce("_of", "_own")).drop("_of", "_own")


def label_overlap(resolved: DataFrame, locale: str = "us") -> DataFrame:
    """By split of a locale: rows, distinct queries and products, all and matched, and coverage."""
    rows = resolved.where(F.col("product_locale") == locale).withColumn("hit", F.col("parent_asin").isNotNull())
    distinct = lambda c: F.count_distinct(c)
    return rows.groupBy("split").agg(
        F.count("*").alias("rows"), distinct("query_id").alias("queries"), distinct("product_id").alias("products"),
        F.count_if(F.col("hit")).alias("matched_rows"), distinct(F.when(F.col("hit"), F.col("query_id"))).alias("matched_queries"), distinct(F.when(F.col("hit"), F.col("parent_asin"))).alias("matched_items"),
    ).withColumn("query_coverage", F.round(F.col("matched_queries") / F.col("queries"), 6))


def label_overlap_report(resolved: DataFrame) -> DataFrame:
    """By locale and split: rows, queries and products, all and matched, rows of each label that matched, and coverage.

    Rows are summed by query, by product and by item in one narrow grouping; the queries' sums hold the rows' own counts.
    """
    groups, hit = ["product_locale", "split"], F.col("parent_asin").isNotNull()
    kinds = {"query": "query_id", "product": "product_id", "item": "parent_asin"}
    keys = F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("key")) for kind, c in kinds.items()))).alias("of")
    dealt = resolved.select(*groups, hit.alias("hit"), "label", keys).where("of.kind = 'query' or of.key is not null")
    labels = [F.count_if(F.col("hit") & (F.col("label") == x)).alias(f"matched_{x}") for x in LABELS]
    each = dealt.groupBy(*groups, F.col("of.kind").alias("kind"), F.col("of.key").alias("key")).agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"), *labels)
    total = lambda c: F.sum(F.when(F.col("kind") == "query", F.col(c)))
    keyed = lambda kind, least: F.count_if((F.col("kind") == kind) & F.col("key").isNotNull() & (F.col("hits") >= least))
    return each.groupBy(*groups).agg(
        total("n").alias("rows"), keyed("query", 0).alias("queries"), keyed("product", 0).alias("products"),
        total("hits").alias("matched_rows"), keyed("query", 1).alias("matched_queries"), keyed("product", 1).alias("matched_products"), keyed("item", 1).alias("matched_items"),
        *(total(f"matched_{x}").alias(f"matched_{x}") for x in LABELS),
    ).withColumn("query_coverage", F.round(F.col("matched_queries") / F.col("queries"), 6))


def matched_items(resolved: DataFrame, items: DataFrame, locale: str = "us") -> DataFrame:
    """By split of a locale, and of all its splits together (`union`): distinct matched items, and their share of the catalog."""
    hits = resolved.where((F.col("product_locale") == locale) & F.col("parent_asin").isNotNull()).select("split", "parent_asin")
    each = hits.unionByName(hits.withColumn("split", F.lit("union"))).groupBy("split").agg(F.count_distinct("parent_asin").alias("items"))
    total = items.agg(F.count_distinct("parent_asin").alias("catalog"))
    return each.join(F.broadcast(total), how="cross").select("split", "items", F.round(F.col("items") / F.col("catalog"), 6).alias("share"))  # one row


def quality_totals(reviews: DataFrame) -> DataFrame:
    """reviews, users, items, and the most reviews that an item has, as one row."""
    per_item = reviews.groupBy("parent_asin").agg(F.count("*").alias("n"))
    most = per_item.agg(F.coalesce(F.max("n"), F.lit(0)).alias("most_per_item"), F.count("*").alias("items"))
    return reviews.agg(F.count("*").alias("reviews"), F.count_distinct("user_id").alias("users")).join(most, how="cross")  # one row each


def brand_summary(items: DataFrame) -> DataFrame:
    """items, how many name a brand and how many don't, and distinct brands, as one row."""
    key = norm_key(F.col("brand"))
    return items.agg(F.count("*").alias("items"), F.count(key).alias("named"), F.count_if(key.isNull()).alias("missing"), F.count_distinct(key).alias("brands"))


def candidate_count_summary(matched: DataFrame, key: str = "query_id") -> DataFrame:
    """Candidates per key: n, how many have 1, 2, 5, 10 or more, least, upper median, greatest; zeros without rows."""
    counts = matched.groupBy(key).agg(F.count("*").alias("c"))
    at_least = [F.count_if(F.col("c") >= k).alias(f"at_least_{k}") for k in (1, 2, 5, 10)]
    zero = lambda c: F.coalesce(c, F.lit(0))
    # the upper median is the value at nearest rank n div 2 + 1: the least with more than half of the values at or below it
    totals = counts.agg(F.count("*").alias("n"), *at_least, zero(F.min("c")).alias("least"), zero(F.max("c")).alias("greatest"))
    sizes = counts.groupBy("c").agg(F.count("*").alias("keys"))  # as many rows as there are distinct counts
    running = sizes.withColumn("below", F.sum("keys").over(W.orderBy("c")))
    median = running.join(F.broadcast(totals.select("n")), how="cross").where(F.col("below") > F.floor(F.col("n") / 2)).agg(zero(F.min("c")).alias("median"))  # one row
    return totals.join(median, how="cross")  # one row each
