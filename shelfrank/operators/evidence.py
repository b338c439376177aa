"""Review evidence of recommended products, and checks of explanations that cite it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfrank.functions.text import norm_text
from shelfrank.operators.lexical import top_k
from shelfrank.operators.ranking import best_of_row
from shelfrank.sources.shared import cut, if_small, send_package
from shelfrank.streaming.evidence_index import product_bucket

#: Chunks asked for at first and at most, reviews shown, and the rating that counts as low.
FIRST_CHUNKS, MOST_CHUNKS, REVIEWS, LOW_RATING = 10, 20, 5, 3.0
PAIR = ["request_id", "parent_asin"]

#: Chunks and requests of a product that meet in one task at most.
CHUNKS_MET, PAIRS_MET = 4096, 256

#: Fixed texts of explanations without a model.
REASON = "%s 符合当前需求；已检索到 %d 条可追溯评论证据。"
NO_LOW = "暂未检索到明确的中低评分评论，潜在缺点需要后续人工核查。"
LOW = "部分评论评分较低（review_id: %s），建议关注该评论中提到的使用体验。"
REASON_NONE = "%s 来自候选商品列表，但当前没有可用评论证据支持更详细解释。"
CONS_NONE = "缺少可引用评论证据，暂不生成具体缺点。"


def review_query(english: Column, title: Column, categories: Column) -> Column:
    """The text that reviews are searched with; null if all parts are blank."""
    return F.nullif(F.concat_ws("\n", norm_text(english), norm_text(title), norm_text(F.array_join(categories, " "))), F.lit(""))


def product_grid(pairs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Into how many parts (_pairs, _chunks) the requests and the chunks of each asked product are dealt."""
    product = ["parent_asin", "bucket"] if "bucket" in chunks.columns else ["parent_asin"]
    asked = pairs.where(F.col("vector").isNotNull()).groupBy("parent_asin").agg(F.ceil(F.count("*") / F.lit(PAIRS_MET)).alias("_pairs"))
    asked = asked.withColumn("bucket", product_bucket("parent_asin")).select(*product, "_pairs")
    sizes = chunks.where(F.col("embedding").isNotNull()).join(asked, product).groupBy(*product, "_pairs").agg(F.ceil(F.count("*") / F.lit(CHUNKS_MET)).alias("_chunks"))
    return if_small(cut(sizes.select(*product, "_pairs", "_chunks")))


def evidence_search(pairs: DataFrame, chunks: DataFrame, k: int = MOST_CHUNKS, rating_lte: float | None = None, grid: DataFrame | None = None) -> DataFrame:
    """The k chunks of each pair's product nearest to its vector: pairs (request_id, parent_asin, vector, ...), chunks (parent_asin, chunk_id, embedding, ...).

    Pairs are distinct, and so are the chunks of a product. Both sides of a product are dealt into a grid of parts (made here
    unless given), so a popular product's requests meet its chunks in many tasks, each of which passes on its own k best; what
    else a chunk holds is joined to the best alone. Of an index in folders by product only those of the pairs' products are read.
    """
    send_package(pairs.sparkSession)
    own = chunks if rating_lte is None else chunks.where(F.col("rating") <= rating_lte)
    product = ["parent_asin", "bucket"] if "bucket" in chunks.columns else ["parent_asin"]
    grid = product_grid(pairs, chunks) if grid is None else grid
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.col(n))
    left = pairs.where(F.col("vector").isNotNull()).select(*PAIR, F.col("vector").cast("array<double>").alias("vector")).join(grid.drop("bucket"), "parent_asin")
    left = left.withColumn("p", dealt("request_id", "_pairs")).withColumn("c", every("_chunks")).select(*PAIR, "vector", "p", "c")
    right = own.where(F.col("embedding").isNotNull()).select(*product, "chunk_id", F.col("embedding").cast("array<double>").alias("embedding")).join(grid, product)
    right = right.withColumn("c", dealt("chunk_id", "_chunks")).withColumn("p", every("_pairs")).select("parent_asin", "chunk_id", "embedding", "p", "c")

    def best(q: pa.Table, v: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if q.num_rows and v.num_rows:
            ids = np.array(v.column("chunk_id").to_pylist(), object)
            scores = np.array(q.column("vector").to_pylist()) @ np.array(v.column("embedding").to_pylist()).T
            for request, product, row in zip(q.column("request_id").to_pylist(), q.column("parent_asin").to_pylist(), scores):
                rows += [(request, product, ids[j], row[j]) for j in best_of_row(row, ids, k)]
        columns = list(zip(*rows)) or [()] * 4
        kinds = [q.schema.field(c).type for c in PAIR] + [v.schema.field("chunk_id").type, pa.float64()]
        return pa.table([pa.array(x, t) for x, t in zip(columns, kinds)], [*PAIR, "chunk_id", "score"])

    kinds = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in PAIR)
    cell = ["parent_asin", "p", "c"]
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(best, f"{kinds}, chunk_id string, score double")
    found = cut(top_k(found, PAIR, "chunk_id", k))
    shown = own.drop("embedding", *([] if "bucket" not in chunks.columns else ["bucket"])).join(if_small(found), ["parent_asin", "chunk_id"])
    return pairs.drop("vector").join(shown, PAIR)


def expand_if_sparse(ranked: DataFrame, first: int = FIRST_CHUNKS, reviews: int = REVIEWS) -> DataFrame:
    """The first chunks of each pair; all of them where those hold fewer reviews than wanted."""
    early = F.array_distinct(F.collect_list(F.when(F.col("rank") <= first, F.col("review_id"))).over(W.partitionBy(*PAIR)))
    return ranked.withColumn("_n", F.size(early)).where((F.col("rank") <= first) | (F.col("_n") < reviews)).drop("_n")


def select_evidence(ranked: DataFrame, reviews: int = REVIEWS) -> DataFrame:
    """All chunks of the first distinct reviews; review_place is the review's place."""
    began = ranked.withColumn("_began", F.min("rank").over(W.partitionBy(*PAIR, "review_id")))
    placed = began.withColumn("review_place", F.dense_rank().over(W.partitionBy(*PAIR).orderBy("_began")))
    return placed.where(F.col("review_place") <= reviews).drop("_began")


def add_low_rating(chosen: DataFrame, low: DataFrame, reviews: int = REVIEWS) -> DataFrame:
    """chosen with the best low-rated chunk where no review is rated low: after fewer reviews than wanted, else in place of the last."""
    state = chosen.groupBy(*PAIR).agg(F.max("review_place").alias("places"), F.count_if(F.col("rating") <= LOW_RATING).alias("lows")).where("lows = 0")
    fresh = low.join(state.select(*PAIR, "places"), PAIR).join(chosen.select(*PAIR, "review_id").distinct(), [*PAIR, "review_id"], "left_anti")
    best = fresh.withColumn("_n", F.row_number().over(W.partitionBy(*PAIR).orderBy("rank"))).where("_n = 1")
    best = best.withColumn("review_place", F.least(F.col("places") + 1, F.lit(reviews))).drop("places", "_n").withColumn("added", F.lit(True))
    taken = best.select(*PAIR, F.col("review_place").alias("_taken"))
    kept = chosen.withColumn("added", F.lit(False)).join(taken, PAIR, "left").where(F.col("_taken").isNull() | (F.col("review_place") < F.col("_taken"))).drop("_taken")
    return kept.unionByName(best.select(*kept.columns))


def gather(pairs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Evidence of each pair: search, expansion, selection and a low rating."""
    grid = product_grid(pairs, chunks)
    ranked = evidence_search(pairs, chunks, grid=grid)
    return add_low_rating(select_evidence(expand_if_sparse(ranked)), evidence_search(pairs, chunks, MOST_CHUNKS, LOW_RATING, grid))


def check_scope(evidence: DataFrame, pairs: DataFrame) -> DataFrame:
    """request_id and foreign: how many chunks of a request are of no product that it asks for; a row for each request that has any."""
    return evidence.join(pairs.select(*PAIR).distinct(), PAIR, "left_anti").groupBy("request_id").agg(F.count("*").alias("foreign"))


def check_sizes(first: int, most: int, reviews: int) -> None:
    """Raises where the numbers of chunks and reviews make no sense."""
    if first <= 0 or reviews <= 0:
        raise ValueError("the first chunks and the reviews must be more than zero")
    if most < first:
        raise ValueError("there must be at least as many chunks at most as at first")


def explain_batch(pairs: DataFrame, chunks: DataFrame, payloads: DataFrame | None = None, first: int = FIRST_CHUNKS, most: int = MOST_CHUNKS, reviews: int = REVIEWS) -> DataFrame:
    """The explanation of each pair (request_id, parent_asin, title, vector) from its evidence: what a model wrote (payloads) where that is sound, else the fixed one.

    Of repeated pairs the last by their column `place` counts; where there is no such column or places are equal, the one with
    the greatest title. Products are trimmed; a blank one is an error. A request with a chunk of another product falls back to
    the fixed texts without evidence.
    """
    check_sizes(first, most, reviews)
    pairs = pairs.withColumn("parent_asin", norm_text(F.col("parent_asin")))
    if not pairs.where("parent_asin is null").isEmpty():
        raise ValueError("parent_asin must not be blank")
    last = F.struct(F.col("place") if "place" in pairs.columns else F.lit(0), F.coalesce("title", F.lit("")))
    once = cut(pairs.groupBy(*PAIR).agg(F.max_by(F.struct("title", "vector"), last).alias("x")).select(*PAIR, "x.*"))
    grid = product_grid(once, chunks)
    ranked = evidence_search(once, chunks, most, grid=grid)
    found = cut(add_low_rating(select_evidence(expand_if_sparse(ranked, first, reviews), reviews), evidence_search(once, chunks, most, LOW_RATING, grid), reviews))
    found = found.join(check_scope(found, once), "request_id", "left_anti")
    named = once.select(*PAIR, "title")
    return template_explanations(named, found) if payloads is None else validate_explanations(payloads, named, found)


def template_explanations(pairs: DataFrame, evidence: DataFrame) -> DataFrame:
    """The fixed explanation of each pair (request_id, parent_asin, title) from its evidence."""
    first = F.min(F.when(F.col("rating") <= LOW_RATING, F.struct("review_place", "rank", "review_id")))["review_id"]
    order = F.array_sort(F.collect_set(F.struct("review_place", "review_id")))
    found = evidence.groupBy(*PAIR).agg(F.transform(order, lambda x: x["review_id"]).alias("cited_review_ids"), first.alias("low"))
    n, title = F.size("cited_review_ids"), F.coalesce(norm_text(F.col("title")), F.col("parent_asin"))
    reason = F.when(F.col("cited_review_ids").isNotNull(), F.format_string(REASON, title, n)).otherwise(F.format_string(REASON_NONE, title))
    cons = F.when(F.col("cited_review_ids").isNull(), CONS_NONE).when(F.col("low").isNull(), NO_LOW).otherwise(F.format_string(LOW, F.col("low")))
    return pairs.join(found, PAIR, "left").select(*PAIR, reason.alias("reason"), cons.alias("potential_cons"), F.coalesce("cited_review_ids", F.array().cast("array<string>")).alias("cited_review_ids"), F.lit(True).alias("fallback"))


def coerce_evidence(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with cleaned ids and typed fields, and rows that lack a required one."""
    text = {c: norm_text(F.col(c)) for c in ("parent_asin", "review_id", "chunk_id", "chunk_text")}
    typed = {"rating": F.col("rating").try_cast("double"), "helpful_vote": F.col("helpful_vote").try_cast("bigint"), "timestamp": F.col("timestamp").try_cast("bigint"), "verified_purchase": F.col("verified_purchase").try_cast("boolean"), "score": F.col("score").try_cast("double")}
    clean = rows.withColumns(text | typed)
    good = F.lit(True)
    for c in text:
        good = good & F.col(c).isNotNull()
    return clean.where(good), clean.where(~good)


def explanation_prompt(template: str, candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    """request_id and prompt: the template with {query} and {evidence} filled; candidates (request_id, parent_asin, english, item struct)."""
    reviews = evidence.groupBy(*PAIR).agg(F.array_sort(F.collect_list(F.struct("review_place", "rank", "review_id", "chunk_id", "rating", "chunk_text"))).alias("reviews"))
    body = candidates.join(reviews, PAIR, "left").groupBy("request_id").agg(F.first("english").alias("english"), F.to_json(F.array_sort(F.collect_list(F.struct("parent_asin", "item", "reviews")))).alias("body"))
    filled = F.replace(F.replace(F.lit(template), F.lit("{evidence}"), F.col("body")), F.lit("{query}"), F.col("english"))
    return body.select("request_id", filled.alias("prompt"))


def validate_explanations(payloads: DataFrame, pairs: DataFrame, evidence: DataFrame) -> DataFrame:
    """Explanations of payloads (request_id, payload JSON) where all of a request's are sound, else the fixed ones.

    Sound: one JSON object with items; texts not blank; products are the request's candidates, all of them; citations are
    reviews in the product's evidence.
    """
    shape = "struct<items:array<struct<parent_asin:string,reason:string,potential_cons:string,cited_review_ids:array<string>>>>"
    parsed = payloads.select("request_id", F.from_json("payload", shape)["items"].alias("items"))
    each = parsed.select("request_id", F.explode("items").alias("i")).select("request_id", *(norm_text(F.col(f"i.{c}")).alias(c) for c in ("parent_asin", "reason", "potential_cons")), F.array_distinct(F.coalesce("i.cited_review_ids", F.array().cast("array<string>"))).alias("cited_review_ids"))
    known = evidence.groupBy(*PAIR).agg(F.collect_set("review_id").alias("own"))
    checked = each.join(pairs.select(*PAIR).distinct().withColumn("candidate", F.lit(True)), PAIR, "left").join(known, PAIR, "left")
    sound = F.coalesce("candidate", F.lit(False)) & F.col("reason").isNotNull() & F.col("potential_cons").isNotNull() & (F.size(F.array_except("cited_review_ids", F.coalesce("own", F.array().cast("array<string>")))) == 0)
    per_request = checked.groupBy("request_id").agg(F.bool_and(sound).alias("sound"), F.count_distinct("parent_asin").alias("named"), F.count("*").alias("rows"))
    wanted = pairs.groupBy("request_id").agg(F.count_distinct("parent_asin").alias("wanted"))
    good = wanted.join(per_request, "request_id").where("sound and named = wanted and rows = wanted").select("request_id")
    written = each.join(good, "request_id", "left_semi").select(*PAIR, "reason", "potential_cons", "cited_review_ids", F.lit(False).alias("fallback"))
    return written.unionByName(template_explanations(pairs.join(good, "request_id", "left_anti"), evidence))


def order_cited_first(explanations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence of each explanation with its place: cited reviews in the order of their citation, then the rest."""
    joined = evidence.join(explanations.select(*PAIR, "cited_review_ids"), PAIR)
    at = F.nullif(F.array_position("cited_review_ids", F.col("review_id")), F.lit(0))
    return joined.withColumn("place", F.row_number().over(W.partitionBy(*PAIR).orderBy(F.asc_nulls_last(at), "review_place", "rank"))).drop("cited_review_ids")


def evidence_snippets(evidence: DataFrame, text: str, max_items: int = 3, max_chars: int = 500) -> DataFrame:
    """The first rows of each pair as one text."""
    w = W.partitionBy(*PAIR).orderBy("review_place", "rank")
    short = F.when(F.length(text) > max_chars, F.concat(F.rtrim(F.substring(text, 1, max_chars)), F.lit("..."))).otherwise(F.col(text))
    line = F.format_string("[%d] rating=%s score=%.4f id=%s: %s", F.col("n"), F.col("rating").cast("string"), F.col("score"), F.col("review_id"), short)
    numbered = evidence.withColumn("n", F.row_number().over(w)).where(F.col("n") <= max_items)
    return numbered.groupBy(*PAIR).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"]), "\n").alias("snippets"))
