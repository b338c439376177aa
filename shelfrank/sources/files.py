"""Sources and sinks: raw files in, clean tables, indexes, metrics and reports out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfrank.functions.text import norm_key, norm_text, point_id

INTERACTION = "user_id string, parent_asin string, rating double, timestamp long"


def line_order() -> Column:
    """The order of lines over any number of files: the file, then where in it a task began to read, then the line within the task.

    How files are dealt to tasks doesn't matter. It must be taken where the files are read.
    """
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), F.monotonically_increasing_id().alias("line"))


def read_interactions(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """CSV with a header, compressed or not; the four columns by name. A gz file is one task's, so its rows are dealt out anew."""
    raw = spark.read.option("header", True).csv(path)
    df = raw.select(line_order().alias("seq"), "user_id", "parent_asin", F.col("rating").cast("double").alias("rating"), F.col("timestamp").cast("long").alias("ts"))
    return df.repartition(partitions or spark.sparkContext.defaultParallelism).select("user_id", "parent_asin", "rating", "ts", "seq")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """seq and value (VARIANT) of JSON lines; seq is in the order of files by name and of lines in a file, however many there are."""
    return spark.read.text(path).select(line_order().alias("seq"), "value").where(F.trim("value") != "").select("seq", F.parse_json("value").alias("value"))


def read_scores(spark: SparkSession, path: str, required: tuple[str, ...], glob: str = "*.csv") -> DataFrame:
    """CSV files by pattern, with or without a byte order mark; fails without files or a required column."""
    df = spark.read.option("header", True).option("pathGlobFilter", glob).option("multiLine", True).csv(path)
    df = df.toDF(*(c.lstrip("﻿") for c in df.columns))
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df


def write_table(df: DataFrame, path: str, schema: str) -> None:
    """Parquet with exactly the columns and types of the schema."""
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema).fields
    df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in fields)).write.mode("overwrite").parquet(path)


def write_stats(stats: DataFrame, path: str) -> None:
    stats.write.mode("overwrite").json(path)


def write_observed(df: DataFrame, path: str, **counters: Column) -> dict:
    """Writes a table and returns counters (aggregates by name) of its rows, taken by the same job."""
    seen = Observation()
    df.observe(seen, *(c.alias(name) for name, c in counters.items())).write.mode("overwrite").parquet(path)
    return seen.get


def write_metrics(wide: DataFrame, path: str) -> None:
    """CSV: model, split, users, the measures at each k, other columns last."""
    first = ["model", "split", "users"]
    measures = [c for m in ("recall", "ndcg", "hit_rate") for c in wide.columns if c.startswith(f"{m}_at_")]
    wide.select(*first, *measures, *(c for c in wide.columns if c not in first + measures)).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


AUDIT_COLUMNS = ("section", "channel", "against", "query_id", "queries", "mean_relevance", "excellent_rate", "acceptable_rate", "bad_rate", "ndcg", "mrr_strict", "mrr_loose", "wins", "losses", "ties")


def write_audit(overall: DataFrame, by_query: DataFrame, wins: DataFrame, path: str) -> None:
    """The three sections of an audit as CSV of fixed columns, in order within and across its files."""
    parts = [df.withColumn("section", F.lit(name)) for name, df in (("overall", overall), ("by_query", by_query), ("pairwise_wins", wins))]
    rows = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    order = ["section", "channel", "query_id", "against"]
    absent = [F.lit(None).cast("string").alias(c) for c in AUDIT_COLUMNS if c not in rows.columns]
    rows.select("*", *absent).select(*AUDIT_COLUMNS).repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("header", True).csv(path)


def _json_object(spark: SparkSession, path: str) -> DataFrame:
    """key and value (VARIANT) of a JSON object in a file; no rows if the file is absent or broken."""
    try:
        whole = spark.read.text(path, wholetext=True)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], "key string, value variant")
    pairs = F.explode(F.from_json("value", "map<string,variant>")).alias("key", "value")
    return whole.where(F.try_parse_json("value").isNotNull()).select(pairs)


def load_alias_table(spark: SparkSession, path: str) -> DataFrame:
    """alias and canonical of a JSON object; blank keys, and values that are no text or blank, are left out."""
    rows = _json_object(spark, path).where(F.schema_of_variant("value") == "STRING")
    return rows.select(norm_key(F.col("key")).alias("alias"), norm_text(F.variant_get("value", "$", "string")).alias("canonical")).where("alias is not null and canonical is not null")


def load_query_catalog(spark: SparkSession, path: str) -> DataFrame:
    """request_id (upper case) and query of a JSON object; a bad id or blank query is an error."""
    rows = _json_object(spark, path).select("key", F.try_variant_get("value", "$", "string").alias("query"))
    if not rows.where(~F.col("key").rlike("^[A-Za-z0-9_-]+$") | norm_text(F.col("query")).isNull()).isEmpty():
        raise ValueError("a query catalog needs plain ids and queries that aren't blank")
    return rows.select(F.upper("key").alias("request_id"), norm_text(F.col("query")).alias("query"))


def write_vectors(df: DataFrame, path: str, namespace: str, key: str, mode: str = "error") -> None:
    """A new vector table; an existing one is an error, or replaced with mode overwrite."""
    df.withColumn("point_id", point_id(namespace, F.col(key))).write.mode(mode).parquet(path)


def write_fusion_sidecars(ranked: DataFrame, filtered: DataFrame, constraints: DataFrame, path: str) -> None:
    """Ranked and filtered rows of an audit run with their requests' constraints, as JSON."""
    for name, df in (("ranked", ranked), ("filtered", filtered)):
        df.join(constraints, "request_id", "left").write.mode("overwrite").json(f"{path}/{name}")


def write_brand_vocabulary(stats: DataFrame, path: str) -> None:
    ordered = stats.orderBy(F.desc("n"), "brand_key")
    ordered.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    ordered.write.mode("overwrite").json(f"{path}/json")
    ordered.select("brand").write.mode("overwrite").text(f"{path}/text")


def preview(items: DataFrame, n: int) -> DataFrame:
    """The first n items by id."""
    if n <= 0:
        raise ValueError("n must be greater than zero")
    return items.orderBy("parent_asin").limit(n)


LEGACY = "legacy"


def append_metrics(log: DataFrame, baseline: DataFrame, run: DataFrame) -> DataFrame:
    """The long metric log (model, split, k, users, recall, ndcg, hit_rate, parameters, losses, run) with a run added; the baseline's rows are replaced by split and come first."""
    for df in (log, baseline, run):
        if missing := [c for c in ("model", "split", "users") if c not in df.columns]:
            raise ValueError(f"columns are missing: {', '.join(missing)}")
    filled = log.unionByName(baseline.withColumn("run", F.lit(0).cast("long")), allowMissingColumns=True)
    other = filled.join(baseline.select("model", "split").distinct(), ["model", "split"], "left_anti")
    last = log.agg(F.coalesce(F.max("run"), F.lit(0)).alias("last"))
    added = run.join(F.broadcast(last), how="cross").withColumn("run", F.col("last") + 1).drop("last")  # one row
    first = baseline.withColumn("run", F.lit(0).cast("long"))
    out = first.unionByName(other, allowMissingColumns=True).unionByName(added, allowMissingColumns=True)
    return out.withColumns({c: F.coalesce(c, F.lit(LEGACY)) for c in ("parameters", "losses") if c in out.columns})


def latest_baseline(log: DataFrame, model: str) -> DataFrame:
    w = W.partitionBy("model", "split", "k").orderBy(F.desc("run"))
    return log.where(F.col("model") == model).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def run_parameters(settings: dict, defaults: dict, losses: list[float]) -> tuple[str, str]:
    """JSON of the settings that differ from their defaults, and of the last ten losses."""
    import json

    return json.dumps({k: v for k, v in sorted(settings.items()) if defaults.get(k) != v}, sort_keys=True), json.dumps([round(x, 6) for x in losses[-10:]])
