"""The registered queries of this folder, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import workspace
from tessera.llm import decontamination, html_text, langid, mixing, passages, quality, sharding, simhash, tokens, urls
from tessera.llm.oracles import ORACLES  # noqa: F401  (read by the entry module)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = workspace.path(spark, "tokens")
    tokens.write_tokens(_table(spark, sf_dir, "documents"), where)
    return tokens.read_tokens(spark, where, digest=True)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix(_table(spark, sf_dir, "documents"), mixing.word_count(F.col("text")))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(_table(spark, sf_dir, "documents"), whole=True)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    mined = urls.mine(urls.labelled_pages(pages, _table(spark, sf_dir, "labels")))
    return urls.judge(pages, mined).select("page_id", "host", "path", "rule", "verdict")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    content = langid.dictionaries(langid.training_rows(docs, ~langid.held_out()))
    found = langid.identify(docs.select("doc_id", "text", langid.held_out().alias("held_out")), content)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_output, op2_html_extraction, op3_source_mixing, op4_substring_dedup, op5_url_filter, op6_decontamination, op7_simhash, op8_sharding, op9_language, op10_quality_rules)
}
