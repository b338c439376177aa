"""Secret scans over an incremental ledger of blobs.

Every distinct text is a blob, named by its SHA-256. A ledger keeps, for each blob, the rule versions that it was scanned
with and what they found. A scan reads only blobs for which the ledger lacks a rule version, and joins findings back to all
documents that hold the blob. All expressions are Spark's own.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfrank.llm.common import cut, shared_dir, unused


class Rule(NamedTuple):
    """A kind of secret: group `value` of a match must have `least` characters, else the match is dropped."""

    kind: str
    pattern: str
    value: int
    least: int
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}/{self.version}"


#: Fixed values of the base rules; their order decides ties.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
#: Further kinds, in public formats of keys and tokens.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
)
RULES = BASE + MORE

#: Cheaper patterns that any kept match contains.
_SIEVE = {"hex": r"[0-9a-f]{32}", "access": r"AKIA[A-Z0-9]{12}"}
_SPANS = "array<struct<rule:string,start:int,end:int>>"


def spans_of(text: Column, rule: Rule) -> Column:
    """The kept matches of one rule, leftmost first, as (rule, start, end) in code points."""
    pattern = rf"[0-9a-f]{{{rule.least},}}" if rule.kind == "hex" else rule.pattern  # a run of hex digits is one match either way
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.value)) if rule.value else found
    between = F.split(text, pattern, -1)
    size = F.transform(found, F.length)
    each = F.arrays_zip(F.transform(between, F.length).alias("gap"), size.alias("size"), F.transform(value, F.length).alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))

    def step(state: Column, m: Column) -> Column:
        begin = state["at"] + m["gap"]
        end = begin + F.coalesce(m["size"], F.lit(0))
        span = F.array(F.struct(F.lit(rule.name).alias("rule"), begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(m["value"] >= rule.least, F.concat(state["out"], span)).otherwise(state["out"]).alias("out"))

    return F.when(text.rlike(_SIEVE.get(rule.kind, rule.pattern)), F.aggregate(each, start, step)["out"]).otherwise(F.array().cast(_SPANS))


class Ledger:
    """What was found in which blob by which rule versions: rows (blob, rules, spans) in a table that only grows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        """All entries; none yet in a new ledger."""
        schema = f"blob binary, rules array<string>, spans {_SPANS}"
        try:
            return self.spark.read.schema(schema).parquet(self.path)
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], schema)

    def add(self, entries: DataFrame) -> None:
        entries.select("blob", "rules", "spans").write.mode("append").parquet(self.path)


def scan(docs: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, blob and spans (sorted by start, then rule order) of every row of docs; the ledger gets what was scanned.

    Null is the empty text. Copies share a blob and are scanned once, whatever their number; repeated rows and ids each get
    a row. An empty table gives an empty one. Each text is scanned as a whole by one task.
    """
    names = [r.name for r in rules]
    paths = cut(docs.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("blob")))
    seen = ledger.rows().groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
    todo = (
        paths.groupBy("blob")
        .agg(F.min("doc_id").alias("doc_id"))
        .join(seen, "blob", "left")
        .withColumn("rules", F.array_except(F.array(*map(F.lit, names)), F.coalesce("seen", F.array().cast("array<string>"))))
        .where(F.size("rules") > 0)
        .select(F.col("blob").alias("of"), F.col("doc_id").alias("at"), "rules")
    )
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.unhex(F.sha2("text", 256)))
    unseen = text.join(todo.hint("shuffle_hash"), (F.col("blob") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("at")))
    each = [F.when(F.array_contains("rules", r.name), spans_of(F.col("text"), r)).otherwise(F.array().cast(_SPANS)) for r in rules]
    # rows that repeat an id and a text give equal entries, which the sets below make one
    ledger.add(unseen.select("blob", "rules", F.concat(*each).alias("spans")))
    order = F.create_map(*(x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))))
    known = (
        ledger.rows()
        .where(F.size("spans") > 0)
        .select("blob", F.explode("spans").alias("s"))
        .where(F.col("s.rule").isin(names))
        .select("blob", F.struct("s.start", order[F.col("s.rule")].alias("order"), "s.end", "s.rule").alias("s"))
        .groupBy("blob")
        .agg(F.array_sort(F.collect_set("s")).alias("spans"))
    )
    nothing = F.array().cast("array<struct<start:int,order:int,end:int,rule:string>>")
    return paths.join(known, "blob", "left").select("doc_id", "blob", F.coalesce("spans", nothing).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The counts and the text forms of scan()'s spans."""
    kind = lambda s: F.substring_index(s["rule"], "/", 1)
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: kind(s).isin([r.kind for r in BASE]))
    count = lambda name: F.size(F.filter("spans", lambda s: kind(s) == name)).cast("long")
    counts = [count(r.kind).alias(f"n_{r.kind}") for r in BASE]
    return found.select("doc_id", *counts, F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """docs with a mark in place of every run of characters that a span covers, and n_chars anew where the text changed.

    Rows without findings come out as they are, a null text too. Copies are scanned once. Other columns of docs keep their
    values, whatever their names.
    """
    blob, spans = (unused(c, docs.columns) for c in ("blob", "spans"))
    spark = docs.sparkSession
    found = scan(docs, Ledger(spark, shared_dir(spark)), rules).where(F.size("spans") > 0).select(F.col("blob").alias(blob), F.col("spans").alias(spans)).distinct()
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        more = F.when(fresh, F.concat(F.substring(F.col("text"), state["at"] + 1, s["start"] - state["at"]), F.lit(mark))).otherwise("")
        return F.struct(F.concat(state["out"], more).alias("out"), F.greatest(state["at"], s["end"]).alias("at"))

    rest = lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text")))
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(F.aggregate(spans, start, step, rest))
    out = docs.withColumn(blob, F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))).join(cut(found), blob, "left").withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
