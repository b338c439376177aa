"""Whole tables of requests: recall channels, fusion, responses."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfrank.operators import constraints
from shelfrank.operators.dense import dense_search
from shelfrank.operators.fusion import Fused, fuse
from shelfrank.operators.graph import graph_top_k
from shelfrank.operators.lexical import LexicalIndex, bm25_search
from shelfrank.operators.popularity import item_counts, popularity_top_k, ranked_items
from shelfrank.sources.shared import cut

#: Fixed value: candidates of each channel.
CHANNEL_K = 30


def _channel(df: DataFrame, name: str) -> DataFrame:
    return df.select("request_id", F.lit(name).alias("channel"), F.col("rank").cast("int").alias("rank"), "parent_asin", F.col("score").cast("double").alias("score"))


def channel_candidates(requests: DataFrame, index: LexicalIndex, vectors: DataFrame, train: DataFrame, nodes: DataFrame | None, k: int = CHANNEL_K) -> DataFrame:
    """Candidates of all channels for requests (request_id, search_query, vector, user_id).

    A user is known if the graph has a node for them; others get no graph candidates, and the most popular items of all, a list
    of k that is sent to their requests. Histories are read for the users that ask.
    """
    known = requests if "known_user" in requests.columns else cut(known_users(requests, nodes))
    dense = dense_search(vectors, known.where("vector is not null").select(F.col("request_id").alias("query_id"), "vector"), k)
    out = _channel(dense.select(F.col("query_id").alias("request_id"), F.col("id").alias("parent_asin"), "score", "rank"), "dense")
    lexical = bm25_search(index, known.select(F.col("request_id").alias("query_id"), F.col("search_query").alias("query")), k)
    out = out.unionByName(_channel(lexical.select(F.col("query_id").alias("request_id"), F.col("doc_id").alias("parent_asin"), "score", "rank"), "bm25"))
    cold = known.where("not known_user").select("request_id").join(F.broadcast(ranked_items(item_counts(train), k)), how="cross")  # k rows
    out = out.unionByName(_channel(cold, "popularity"))
    if nodes is not None:
        own = known.where("known_user").select("request_id", "user_id")
        popular = own.join(popularity_top_k(train, own, k), "user_id")
        out = out.unionByName(_channel(popular, "popularity"))
        graph = own.join(graph_top_k(nodes, own, train.select("user_id", "parent_asin").distinct(), k), "user_id")
        out = out.unionByName(_channel(graph, "lightgcn"))
    return out


def known_users(requests: DataFrame, nodes: DataFrame | None) -> DataFrame:
    """requests with known_user: whether the graph has their user."""
    clean = requests.withColumn("user_id", F.nullif(F.trim("user_id"), F.lit("")))
    if nodes is None:
        return clean.withColumn("known_user", F.lit(False))
    users = nodes.where(F.col("node").startswith("u:")).select(F.substring("node", 3, 1 << 30).alias("user_id"), F.lit(True).alias("_known"))
    return clean.join(users, "user_id", "left").withColumn("known_user", F.coalesce("_known", F.lit(False))).drop("_known")


def recommend_batch(requests: DataFrame, limits: DataFrame, items: DataFrame, index: LexicalIndex, vectors: DataFrame, train: DataFrame, nodes: DataFrame | None) -> Fused:
    """The fused result of requests (request_id, search_query, vector, user_id, top_k) under their limits (request_id, constraint columns)."""
    known = cut(known_users(requests, nodes))
    candidates = channel_candidates(known, index, vectors, train, nodes)
    return fuse(candidates, known.select("request_id", "known_user", "top_k", "search_query").join(limits, "request_id"), items)


@dataclass(frozen=True)
class Answered:
    """Results of the requests that passed all checks (`asked`), and a row (request_id, query, stage, error) for each that didn't."""

    fused: Fused
    asked: DataFrame
    errors: DataFrame


def _fail(rows: DataFrame, stage: str) -> DataFrame:
    return rows.select("request_id", "query", F.lit(stage).alias("stage"), "error")


def prepare_requests(requests: DataFrame, translations: DataFrame, payloads: DataFrame, category_aliases: DataFrame, brand_aliases: DataFrame) -> constraints.Checked:
    """Requests (request_id, query, user_id, top_k) with search_query and constraints, and those that fail, with their stage and error.

    A request fails at the first stage that it doesn't pass: request (its id is absent or repeated, its query blank, its top_k
    out of range), translation, intent (it has no payload, several, or a bad one) or constraints. The rest goes on.
    """
    repeated = requests.groupBy("request_id").agg(F.count("*").alias("_times")).where("_times > 1").select("request_id", F.lit(True).alias("_repeated"))
    given = requests.join(repeated, "request_id", "left").withColumn("error", F.when(F.col("request_id").isNull(), "no id").when(F.col("_repeated"), "repeated id")).drop("_repeated")
    errors = _fail(given.where("error is not null"), "request")
    valid = constraints.valid_requests(given.where("error is null").drop("error"))
    errors = errors.unionByName(_fail(valid.errors, "request"))
    searched = constraints.prepare_search_query(valid.ok, translations)
    errors = errors.unionByName(_fail(searched.errors, "translation"))
    ok = cut(searched.ok)
    asked = payloads.join(ok.select("request_id"), "request_id", "left_semi")
    counted = ok.select("request_id", "query").join(asked.groupBy("request_id").agg(F.count("*").alias("_n")), "request_id", "left")
    odd = counted.withColumn("error", F.when(F.col("_n").isNull(), "no intent").when(F.col("_n") > 1, "several intents")).where("error is not null")
    errors = errors.unionByName(_fail(odd, "intent"))
    parsed = constraints.parse_intent(asked.join(odd.select("request_id"), "request_id", "left_anti"))
    named = ok.select("request_id", "query")
    errors = errors.unionByName(_fail(parsed.errors.join(named, "request_id"), "intent"))
    checked = constraints.validate_constraints(constraints.resolve_constraints(cut(parsed.ok), category_aliases, brand_aliases))
    errors = errors.unionByName(_fail(checked.errors.join(named, "request_id"), "constraints"))
    return constraints.Checked(ok.join(checked.ok, "request_id"), errors)


def recommend_requests(requests: DataFrame, translations: DataFrame, payloads: DataFrame, category_aliases: DataFrame, brand_aliases: DataFrame, encoder: Callable[[DataFrame, str, str], DataFrame], items: DataFrame, index: LexicalIndex, vectors: DataFrame, train: DataFrame, nodes: DataFrame | None) -> Answered:
    """Requests from their raw text to fused results, a whole table at once.

    Translations (query, english) and intent payloads (request_id, payload) are what models have answered. Every request is
    either among those that were asked or among the errors.
    """
    checked = prepare_requests(requests, translations, payloads, category_aliases, brand_aliases)
    ready = cut(encoder(checked.ok, "search_query", "vector"))
    limits = ready.select("request_id", "category_tags", *constraints.INTENT_PRICES, "brands", "excluded_brands", "color_tags", "material_tags")
    fused = recommend_batch(ready.select("request_id", "search_query", "vector", "user_id", "top_k"), limits, items, index, vectors, train, nodes)
    return Answered(fused, ready, checked.errors)


def search_only_batch(requests: DataFrame, items: DataFrame, index: LexicalIndex, vectors: DataFrame) -> Fused:
    """Vector and lexical channels alone, of catalog items, without constraints."""
    dense = dense_search(vectors, requests.select(F.col("request_id").alias("query_id"), "vector"), CHANNEL_K)
    lexical = bm25_search(index, requests.select(F.col("request_id").alias("query_id"), F.col("search_query").alias("query")), CHANNEL_K)
    both = _channel(dense.select(F.col("query_id").alias("request_id"), F.col("id").alias("parent_asin"), "score", "rank"), "dense").unionByName(
        _channel(lexical.select(F.col("query_id").alias("request_id"), F.col("doc_id").alias("parent_asin"), "score", "rank"), "bm25")
    )
    none = F.array().cast("array<string>")
    lists = ("category_tags", "brands", "excluded_brands", "color_tags", "material_tags")
    free = requests.select("request_id", "top_k", F.lit(False).alias("known_user"), F.lit(None).cast("double").alias("min_price"), F.lit(None).cast("double").alias("max_price"), *(none.alias(c) for c in lists))
    return fuse(only_known_items(both, items), free, items)


def only_known_items(candidates: DataFrame, items: DataFrame) -> DataFrame:
    return candidates.join(items.select("parent_asin"), "parent_asin", "left_semi")


def typed_candidates(candidates: DataFrame) -> DataFrame:
    """Candidates with the fields of a response in their types; what is absent has its default: rank 0, score 0, no sources."""
    has = lambda c, kind, default: (F.coalesce(F.col(c).cast(kind), default) if c in candidates.columns else default).alias(c)
    score = next((c for c in ("fusion_score", "score") if c in candidates.columns), None)
    texts = "array<string>"
    own = ("request_id", "parent_asin", "rank", "fusion_score", "score", "sources", "source_ranks", "source_scores")
    return candidates.select(
        "request_id", F.col("parent_asin").cast("string").alias("parent_asin"), has("rank", "int", F.lit(0)),
        (F.coalesce(F.col(score).cast("double"), F.lit(0.0)) if score else F.lit(0.0)).alias("fusion_score"),
        has("sources", texts, F.array().cast(texts)), has("source_ranks", "map<string,int>", F.create_map().cast("map<string,int>")),
        has("source_scores", "map<string,double>", F.create_map().cast("map<string,double>")), *(c for c in candidates.columns if c not in own),
    )


EVIDENCE = ("review_id", "chunk_id", "rating", "text", "chunk_text", "score")


def response_rows(final: DataFrame, items: DataFrame, explanations: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """Ranked items with their fields, explanations and, if given, evidence; absent explanations have empty texts, no evidence and fallback."""
    extra = [c for c in ("source_ranks", "source_scores") if c in final.columns]
    shown = final.select("request_id", "parent_asin", "rank", "score", "sources", *extra).join(items.select("parent_asin", "title", "brand", "price"), "parent_asin", "left")
    joined = shown.join(explanations, ["request_id", "parent_asin"], "left")
    filled = joined.withColumns({
        "reason": F.coalesce("reason", F.lit("")),
        "potential_cons": F.coalesce("potential_cons", F.lit("")),
        "cited_review_ids": F.coalesce("cited_review_ids", F.array().cast("array<string>")),
        "fallback": F.coalesce("fallback", F.lit(True)),
    })
    if evidence is None:
        return filled
    fields = [c for c in EVIDENCE if c in evidence.columns]
    listed = F.array_sort(F.collect_list(F.struct("review_place", "rank", F.struct(*fields).alias("x"))))
    found = evidence.groupBy("request_id", "parent_asin").agg(F.transform(listed, lambda e: e["x"]).alias("evidence"))
    told = explanations.select("request_id", "parent_asin").distinct()
    return filled.join(found.join(told, ["request_id", "parent_asin"], "left_semi"), ["request_id", "parent_asin"], "left").withColumn("evidence", F.coalesce("evidence", F.array().cast(found.schema["evidence"].dataType)))


def manual_eval_rows(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (query_id, rank, result) of stored responses (query_id, success, results, ...), and the runs that failed."""
    good = responses.where("success").select("query_id", F.posexplode("results").alias("at", "result"))
    return good.select("query_id", (F.col("at") + 1).alias("rank"), "result"), responses.where("not coalesce(success, false)")


def response_file_rows(files: DataFrame, max_items: int = 3, max_chars: int = 500) -> tuple[DataFrame, DataFrame]:
    """The rows of a manual evaluation from stored responses (name, value: JSON), and the names of the runs that failed.

    A result has a row if its rank is a whole number, as a number or a text; what else it lacks is empty. Evidence is shown as
    text: its first pieces, each cut at max_chars.
    """
    v = files.select("name", F.try_parse_json("value").alias("v"))
    get = lambda c, path, kind="string": F.try_variant_get(c, f"$.{path}", kind)
    good = F.coalesce(get("v", "success", "boolean"), F.lit(False))
    runs = v.where(good).select(
        F.coalesce(F.nullif(F.trim(get("v", "query_id")), F.lit("")), F.regexp_replace("name", r"^.*/|\.[^.]*$", "")).alias("query_id"),
        F.coalesce(get("v", "query"), F.lit("")).alias("query"), F.coalesce(get("v", "top_k", "int"), F.lit(3)).alias("top_k"),
        get("v", "response.latency_ms", "double").alias("latency_ms"), get("v", "client_elapsed_seconds", "double").alias("elapsed_seconds"),
        F.explode(get("v", "response.results", "array<variant>")).alias("r"),
    )
    text = lambda *names: F.coalesce(*(F.nullif(get("r", n), F.lit("")) for n in names), F.lit(""))
    body = lambda e: F.coalesce(get(e, "chunk_text"), get(e, "text"), F.lit(""))
    cut_ = lambda t: F.when(F.length(t) > max_chars, F.concat(F.rtrim(F.substring(t, 1, max_chars)), F.lit("..."))).otherwise(t)
    line = lambda e, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] rating="), F.coalesce(get(e, "rating"), F.lit("")), F.lit(" id="), F.coalesce(get(e, "review_id"), F.lit("")), F.lit(": "), cut_(body(e)))
    pieces = F.slice(F.coalesce(get("r", "evidence", "array<variant>"), F.array().cast("array<variant>")), 1, max_items)
    rows = runs.select(
        "query_id", get("r", "rank").try_cast("int").alias("rank"), "query", "top_k", text("product_id", "parent_asin").alias("product_id"), text("title").alias("title"), text("brand").alias("brand"),
        get("r", "price", "double").alias("price"), get("r", "fusion_score", "double").alias("fusion_score"), F.array_join(F.coalesce(get("r", "sources", "array<string>"), F.array().cast("array<string>")), ", ").alias("sources"),
        text("reason").alias("reason"), text("potential_cons").alias("potential_cons"), F.array_join(F.transform(pieces, line), "\n").alias("evidence"), "latency_ms", "elapsed_seconds",
    ).where("rank is not null")
    return rows, v.where(~good).select("name")


def fill_template(template: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Template rows (query_id, rank, ...) with their results, and those without any."""
    return template.join(rows, ["query_id", "rank"], "left"), template.join(rows, ["query_id", "rank"], "left_anti")


def audit_run(requests: DataFrame, candidates: DataFrame, items: DataFrame, train: DataFrame, k: int) -> DataFrame:
    """The first k candidates of each channel for requests (request_id, search_query, user_id), with item fields and the length of the user's history."""
    history = train.select("user_id", "parent_asin").distinct().groupBy("user_id").agg(F.count("*").alias("history"))
    asked = requests.select("request_id", "search_query", "user_id").join(history, "user_id", "left").fillna(0, ["history"])
    shown = candidates.where(F.col("rank") <= k).join(asked, "request_id").join(items.select("parent_asin", "title", "brand", "price"), "parent_asin", "left")
    return shown.select("request_id", "channel", "rank", "parent_asin", "title", "brand", "price", "score", "search_query", "user_id", "history")


def audit_channels(requests: DataFrame, items: DataFrame, index: LexicalIndex, vectors: DataFrame, train: DataFrame, nodes: DataFrame | None, k: int) -> DataFrame:
    """An audit of requests (request_id, search_query, vector, user_id) from the channels themselves: each one's first k, with item fields and the length of the user's history."""
    known = cut(known_users(requests, nodes))
    return audit_run(known, channel_candidates(known, index, vectors, train, nodes, k), items, train, k)
