"""Requests, intents, aliases and hard constraints on candidates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfrank.functions.text import is_cjk, norm_key, norm_keys, norm_list, norm_text, price_value

#: List and price fields of an intent payload.
INTENT_LISTS = ("product_terms", "brands", "excluded_brands", "color_tags", "material_tags")
INTENT_PRICES = ("min_price", "max_price")
#: Keys of item details that name colors and materials.
COLOR_KEYS, MATERIAL_KEYS = ("Color Name", "Color"), ("Material Type", "Material")



@dataclass(frozen=True)
class Checked:
    """Rows that passed, and those that did not with their error."""

    ok: DataFrame
    errors: DataFrame


def _split(df: DataFrame, error: Column) -> Checked:
    marked = df.withColumn("error", error)
    return Checked(marked.where("error is null").drop("error"), marked.where("error is not null"))


def none() -> Column:
    return F.array().cast("array<string>")


def valid_requests(requests: DataFrame) -> Checked:
    """Requests with trimmed query and user and a top_k of 1 to 50, 10 where it is absent."""
    clean = requests.withColumns({"query": norm_text(F.col("query")), "user_id": norm_text(F.col("user_id")), "top_k": F.coalesce("top_k", F.lit(10))})
    return _split(clean, F.when(F.col("query").isNull(), "blank query").when(~F.col("top_k").between(1, 50), "top_k out of range"))


def prepare_search_query(requests: DataFrame, translations: DataFrame) -> Checked:
    """Requests with search_query: the trimmed query, or its English form where the query has Chinese characters."""
    clean = requests.withColumn("query", norm_text(F.col("query")))
    known = translations.select(F.trim("query").alias("query"), norm_text(F.col("english")).alias("english")).dropDuplicates(["query"])
    joined = clean.join(known, "query", "left")
    search = F.when(is_cjk(F.col("query")), F.col("english")).otherwise(F.col("query"))
    error = F.when(F.col("query").isNull(), "blank query").when(F.col("search_query").isNull(), "no translation")
    return _split(joined.withColumn("search_query", search).drop("english"), error)


def parse_intent(payloads: DataFrame) -> Checked:
    """Intents of payloads (request_id, payload JSON): lists cleaned, prices finite, not negative and in order; other keys are ignored."""
    parsed = F.try_parse_json("payload")
    lists = {c: F.coalesce(norm_list(F.try_variant_get("_v", f"$.{c}", "array<string>")), none()) for c in INTENT_LISTS}
    prices = {c: F.try_variant_get("_v", f"$.{c}", "double") for c in INTENT_PRICES}
    kind = lambda c: F.schema_of_variant(F.coalesce(F.try_variant_get("_v", f"$.{c}", "variant"), F.parse_json(F.lit("null"))))
    bad_list = F.lit(False)
    for c in INTENT_LISTS:
        bad_list = bad_list | ~kind(c).isin("ARRAY<STRING>", "ARRAY<VOID>", "VOID")
    bad_price = F.lit(False)
    for c in INTENT_PRICES:
        bad_price = bad_price | ~kind(c).rlike(r"^(BIGINT|DOUBLE|DECIMAL\(.*|VOID)$") | F.coalesce((F.col(c) < 0) | F.isnan(c) | (F.col(c) == float("inf")), F.lit(False))
    df = payloads.withColumn("_v", parsed)
    error = (
        F.when(F.col("_v").isNull() | ~F.schema_of_variant("_v").startswith("OBJECT"), "not a JSON object")
        .when(bad_list, "not a list of texts")
        .when(bad_price, "not a price")
        .when(F.col("min_price") > F.col("max_price"), "min_price is greater than max_price")
    )
    return_cols = ["request_id", *INTENT_LISTS, *INTENT_PRICES]
    checked = df.withColumns(lists | prices).withColumn("error", error)
    return Checked(checked.where("error is null").select(*return_cols), checked.where("error is not null").select("request_id", "payload", "error"))


def resolve_aliases(df: DataFrame, column: str, aliases: DataFrame, key: str = "request_id") -> DataFrame:
    """key and the canonical values of a list column: unknown values go, the first of equal canonical values stays, in order."""
    known = aliases.select(norm_key(F.col("alias")).alias("alias"), norm_text(F.col("canonical")).alias("canonical")).where("alias is not null and canonical is not null").dropDuplicates(["alias"])
    found = df.select(key, F.posexplode(column).alias("at", "value")).withColumn("alias", norm_key(F.col("value"))).join(known, "alias")
    first = found.groupBy(key, norm_key(F.col("canonical")).alias("same")).agg(F.min(F.struct("at", "canonical")).alias("x"))
    lists = first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["canonical"]).alias(column))
    return df.select(key).distinct().join(lists, key, "left").withColumn(column, F.coalesce(column, none()))


def resolve_constraints(intents: DataFrame, category_aliases: DataFrame, brand_aliases: DataFrame) -> DataFrame:
    """Constraints of intents: terms become category tags, brands their canonical names; the rest passes."""
    terms = resolve_aliases(intents, "product_terms", category_aliases).withColumnRenamed("product_terms", "category_tags")
    brands = resolve_aliases(intents, "brands", brand_aliases)
    excluded = resolve_aliases(intents, "excluded_brands", brand_aliases)
    rest = intents.select("request_id", *INTENT_PRICES, "color_tags", "material_tags")
    return rest.join(terms, "request_id").join(brands, "request_id").join(excluded, "request_id")


def validate_constraints(df: DataFrame) -> Checked:
    finite = lambda c: F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False))
    return _split(df, F.when(finite("min_price") | finite("max_price"), "not a finite price").when(F.col("min_price") > F.col("max_price"), "min_price is greater than max_price"))


def category_tags(categories: Column) -> Column:
    return norm_keys(categories)


def detail_tags(details_json: Column, keys: tuple[str, ...]) -> Column:
    """Distinct keys of the texts and lists of texts, of any depth up to two, under the named details; broken JSON gives none."""
    v = F.try_parse_json(details_json)
    flat = lambda values: F.flatten(F.transform(values, lambda x: F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.array(x))))
    found = F.filter(F.array(*(F.try_variant_get(v, f"$['{k}']", "variant") for k in keys)), lambda x: x.isNotNull())
    texts = F.filter(flat(flat(found)), lambda x: F.schema_of_variant(x) == "STRING")
    return norm_keys(F.transform(texts, lambda x: F.try_variant_get(x, "$", "string")))


def color_tags(details_json: Column) -> Column:
    return detail_tags(details_json, COLOR_KEYS)


def material_tags(details_json: Column) -> Column:
    return detail_tags(details_json, MATERIAL_KEYS)


def filter_reason(personal: bool = True) -> Column:
    """Why a candidate fails its request's constraints, in the fixed order of checks; null if it passes.

    Item columns: item_categories, price, brand, item_colors, item_materials. Request columns: those of resolve_constraints().
    Color and material are only checked for personalised candidates.
    """
    wanted, own = norm_keys(F.col("category_tags")), F.coalesce("item_categories", none())
    matches = F.exists(wanted, lambda w: F.exists(own, lambda c: F.contains(c, w)))
    price, brand = price_value(F.col("price")), norm_key(F.col("brand"))
    brands = norm_keys(F.col("brands"))
    listed = lambda values: F.coalesce(F.array_contains(values, brand), F.lit(False))
    bounded = F.col("min_price").isNotNull() | F.col("max_price").isNotNull()
    out = (
        F.when((F.size(wanted) > 0) & (F.size(own) == 0), "category_missing")
        .when((F.size(wanted) > 0) & ~matches, "category_mismatch")
        .when(bounded & price.isNull(), "price_missing")
        .when(price < F.col("min_price"), "price_below_min")
        .when(price > F.col("max_price"), "price_above_max")
        .when((F.size(brands) > 0) & ~listed(brands), "brand_mismatch")
        .when(listed(norm_keys(F.col("excluded_brands"))), "brand_excluded")
    )
    if personal:
        for column, own_tags, reason in (("color_tags", "item_colors", "color_mismatch"), ("material_tags", "item_materials", "material_mismatch")):
            tags = norm_keys(F.col(column))
            out = out.when((F.size(tags) > 0) & ~F.coalesce(F.arrays_overlap(tags, F.coalesce(own_tags, none())), F.lit(False)), reason)
    return out


def hard_filter(candidates: DataFrame) -> DataFrame:
    """Candidates that meet all their constraints."""
    return candidates.where(filter_reason().isNull())
