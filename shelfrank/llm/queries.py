"""The registered queries of the corpus operators, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfrank.llm import alignment, bpe, chat, decontaminate, exact_substrings, html, language_model, near_dedup, quality, resampling, secrets, sharding, urls
from shelfrank.llm.common import shared_dir, table


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), urls.fit(urls.labelled(spark)))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs.select("doc_id", "text"), model).drop("text")


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.group(table(spark, sf_dir, "documents"), k=3, percent=85)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = secrets.Ledger(spark, shared_dir(spark))
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents"), ledger))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op12_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokens(table(spark, sf_dir, "documents"))


def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filters,
        op2_decontamination,
        op3_html_extraction,
        op4_quality_rules,
        op5_minhash_dedup,
        op6_suffix_dedup,
        op7_lm_scoring,
        op8_byte_bpe,
        op9_secret_scans,
        op10_chat_formatting,
        op11_sharding,
        op12_cross_tokenizer,
        op13_target_resampling,
    )
}
ORACLES: dict[str, str] = {"op5_minhash_dedup": near_dedup.ORACLE, "op10_chat_formatting": chat.ORACLE}
