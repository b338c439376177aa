"""Column functions on text: cleaning, keys, tokens, documents, chunks, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the labelled lines of a product document, in order.
DOCUMENT_LINES = ("Title", "Brand", "Main Category", "Categories", "Features", "Details", "Description")


#: All characters of Unicode's property White_Space.
WHITE = "".join(map(chr, [*range(9, 14), 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]))


def norm_text(c: Column) -> Column:
    """Trimmed of any white space; blank is null. Only the ends of a text are looked at."""
    return F.nullif(F.btrim(c, F.lit(WHITE)), F.lit(""))


def norm_list(c: Column) -> Column:
    """Each element cleaned, blanks dropped; null is the empty list."""
    return F.coalesce(F.filter(F.transform(c, norm_text), lambda x: x.isNotNull()), F.array().cast("array<string>"))


def parse_price(c: Column) -> Column:
    """The first number of a text, without thousands commas; null if there is none."""
    return F.nullif(F.regexp_replace(F.regexp_extract(c.cast("string"), r"\d[\d,]*(?:\.\d+)?", 0), ",", ""), F.lit("")).try_cast("double")


def price_value(c: Column) -> Column:
    """A finite price, else null."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def norm_key(c: Column) -> Column:
    """A key that ignores case and outer white space."""
    return F.replace(F.lower(norm_text(c)), F.lit("ß"), F.lit("ss"))


def norm_keys(c: Column) -> Column:
    """Distinct keys of a list, blanks dropped."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), norm_key), lambda x: x.isNotNull()))


def tokenize(c: Column) -> Column:
    """Runs of letters and digits, case folded."""
    return F.regexp_extract_all(F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("ß"), F.lit("ss")), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def is_cjk(c: Column) -> Column:
    return F.coalesce(c.rlike("[\\u4e00-\\u9fff]"), F.lit(False))


def float_text(c: Column) -> Column:
    """A float as its shortest text, with .0 for whole numbers."""
    return c.cast("double").cast("string")


def product_document(title: Column, brand: Column, main_category: Column, categories: Column, features: Column, details: Column, description: Column, spaced: bool = True) -> Column:
    """Seven labelled lines; lists are joined by ' | ' without blank entries, details are shown as key: value sorted by key; absent values are left out of their line.

    Values of details are JSON with a space behind each comma and colon outside of texts, or compact if not spaced.
    """
    shown_as = _spaced if spaced else lambda json: json
    parsed = F.from_json(details, "map<string,variant>")
    shown = F.array_join(F.transform(F.array_sort(F.map_keys(parsed)), lambda k: F.concat(k, F.lit(": "), shown_as(F.to_json(parsed[k])))), " | ")
    broken = details.isNotNull() & F.try_parse_json(details).isNull()
    joined = lambda c: F.array_join(norm_list(c), " | ")
    values = (title, brand, main_category, joined(categories), joined(features), F.when(broken, details).otherwise(shown), description)
    return F.concat_ws("\n", *(F.concat(F.lit(f"{label}: "), F.coalesce(norm_text(v), F.lit(""))) for label, v in zip(DOCUMENT_LINES, values)))


def _spaced(json: Column) -> Column:
    """Compact JSON with a space behind each comma and colon that isn't in a text."""
    tokens = F.regexp_extract_all(json, F.lit(r'("(?:[^"\\]|\\.)*+"|[^",:]+|[,:])'), F.lit(1))
    return F.array_join(F.transform(tokens, lambda t: F.when(t.isin(",", ":"), F.concat(t, F.lit(" "))).otherwise(t)), "")


def finite(c: Column) -> Column:
    """A number that is neither infinite nor NaN, else null."""
    return F.when(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != F.lit(float("inf"))), c)


def product_payload(items: DataFrame, document: Column) -> DataFrame:
    """Items as they are stored beside their vectors: with their document, floats that aren't finite as null, dates and times as text."""
    columns = []
    for field in items.schema.fields:
        kind, c = field.dataType.typeName(), F.col(f"`{field.name}`")
        columns.append((finite(c) if kind in ("float", "double") else c.cast("string") if kind in ("date", "timestamp", "timestamp_ntz") else c).alias(field.name))
    return items.select(*(c for c, f in zip(columns, items.schema.fields) if f.name != "document"), document.alias("document"))


def review_text(title: Column, rating: Column, text: Column) -> Column:
    """Up to three labelled lines; absent and blank values have none."""
    line = lambda label, v: F.when(norm_text(v).isNotNull(), F.concat(F.lit(label), norm_text(v)))
    return F.concat_ws("\n", line("Review title: ", title), line("Rating: ", float_text(rating)), line("Review text: ", text))


def word_windows(c: Column, size: int = 384, overlap: int = 64) -> Column:
    """Chunks of `size` words, each beginning `size - overlap` words after the one before; the last holds the rest."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")

    def windows(own: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(own) - overlap - 1, F.lit(0)), F.lit(size - overlap))
        return F.transform(starts, lambda i: F.array_join(F.slice(own, i + 1, size), " "))

    # as the element of a list, the words are cut once and not once a window
    return F.coalesce(F.get(F.transform(F.filter(F.array(words), lambda w: F.size(w) > 0), windows), F.lit(0)), F.array().cast("array<string>"))


def word_count(c: Column) -> Column:
    """How many words a text has."""
    return F.regexp_count(c, F.lit(r"\S+"))


def review_id(parent_asin: Column, asin: Column, user_id: Column, timestamp: Column, title: Column, text: Column) -> Column:
    """A key of a review's six identifying fields: a digest of their compact JSON array."""
    quoted = [F.when(c.isNull(), "null").otherwise(F.regexp_replace(F.to_json(F.array(c.cast("string"))), r"^\[|\]$", "")) for c in (parent_asin, asin, user_id, title, text)]
    lowered = [_low_escapes(q) for q in quoted]
    number = F.coalesce(timestamp.cast("string"), F.lit("null"))
    body = F.concat(F.lit("["), F.concat_ws(",", *lowered[:3], number, *lowered[3:]), F.lit("]"))
    return F.concat(F.lit("rvw_"), F.substring(F.sha2(body, 256), 1, 32))


def _low_escapes(c: Column) -> Column:
    """JSON escapes of control characters with lower-case hex digits."""
    for digit in "ABCDEF":
        c = F.regexp_replace(c, rf"(?<!\\)((?:\\\\)*)\\u00([01]){digit}", rf"$1\\u00$2{digit.lower()}")
    return c


def point_id(namespace: str, key: Column) -> Column:
    """The version 5 UUID of a key in a namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(key, "UTF-8")))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1)
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def free_query_id(query: Column) -> Column:
    return F.concat(F.lit("FREE-"), F.upper(F.substring(F.sha2(F.trim(query), 256), 1, 10)))


def index_name(scope: str, model: str) -> str:
    """A path-safe name of an index. A model whose name holds no letter or digit is an error."""
    import re

    slug = lambda x: re.sub(r"[^0-9a-z]+", "_", x.lower()).strip("_")
    if not slug(model):
        raise ValueError("the model's name must hold a letter or digit")
    return "_".join(filter(None, (slug(scope), slug(model))))


def known_index_name(scope: str, key: str, models: dict[str, str]) -> str:
    """The name of an index of one of the known models (key to name); another key is an error."""
    if key not in models:
        raise ValueError(f"unknown model: {key}")
    return index_name(scope, models[key])
