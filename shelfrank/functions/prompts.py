"""Prompts as columns. What a model answers comes back as an input table and is checked there."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfrank.operators.constraints import INTENT_LISTS, INTENT_PRICES

TRANSLATION = "Give the English form of this shopping query, and nothing else.\n{query}"

INTENT = (
    "State what the shopper asks for as one JSON object with the keys "
    + ", ".join((*INTENT_LISTS, *INTENT_PRICES))
    + ".\nThe first five are lists of English texts, empty if nothing is said; the last two are numbers, null if no price is named. "
    "Name only what the query says; product_terms are kinds of products without adjectives. Recommend nothing.\nQuery: {query}"
)

EXPLANATION = (
    "For each candidate below write, in Chinese, why it fits (reason) and what may speak against it (potential_cons), from its reviews alone.\n"
    'Answer with one JSON object {"items": [{"parent_asin", "reason", "potential_cons", "cited_review_ids"}]} that has every candidate once '
    "and cites only review_id values of the same candidate.\nQuery: {query}\nCandidates: {evidence}"
)


def fill(template: str, query: Column) -> Column:
    """The template with the query in its place."""
    return F.replace(F.lit(template), F.lit("{query}"), query)


def translation_prompt(query: Column) -> Column:
    return fill(TRANSLATION, query)


def intent_prompt(query: Column) -> Column:
    return fill(INTENT, query)
