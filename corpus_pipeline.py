"""A corpus from raw documents to token ids: five stages, each of which takes all rows that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from shelfrank.llm import bpe, decontaminate, near_dedup, quality, secrets
from shelfrank.llm.common import cut, scratch, shared_dir, table, unused

#: The columns that stages know by name.
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage under which further columns of the documents, whatever their names, keep their names and values.

    Intermediate tables of a stage stay, as what it returns is read later; `run` removes them once its rows are written.
    """

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        further = {c: unused(f"further_{i}", docs.columns) for i, c in enumerate(docs.columns) if c not in DOCUMENT}
        out = f(spark, docs.withColumnsRenamed(further), sf_dir)
        return out.withColumnsRenamed({new: old for old, new in further.items() if new in out.columns})

    return run_stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rule or that the classifier rejects."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, model).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of documents linked by 0.8 of their five-word shingles, the one with the smallest id; a row without id stays."""
    return near_dedup.survivors(docs, k=5, percent=80).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in the place of every secret."""
    return secrets.redact(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, and digests of them and of what they decode to."""
    return bpe.encode(docs.select("doc_id", "lang", "source", "text"), with_ids=True)


STAGES = [
    ("quality_rules", _stage(quality_rules)),
    ("near_duplicates", _stage(near_duplicates)),
    ("decontamination", _stage(decontamination)),
    ("secret_scans", _stage(secret_scans)),
    ("byte_bpe", _stage(byte_bpe)),
]

#: The stages use a fitted classifier, sketches and a tokenizer, which SQL can't express; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again before the next, and what it wrote on the way is removed."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = shared_dir(spark)
        with scratch(spark):
            docs = cut(stage(spark, docs, sf_dir), path)
    return docs
