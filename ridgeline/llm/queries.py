"""Queries of this package by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ridgeline.llm import dominance, importance, minhash_dedup, ngram_join, quality_rules, source_mix, url_filters
from ridgeline.llm.fingerprints import compare_edited
from ridgeline.llm.html_extraction import extract
from ridgeline.llm.language_id import fold_of, identify
from ridgeline.llm.lm_scoring import score
from ridgeline.llm.packing import pack
from ridgeline.llm.token_counts import count_tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = score(docs, fold_of(docs["doc_id"], 10) != 0)
    return scored.withColumn("held_out", ~scored["train"]).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(_table(spark, sf_dir, "documents"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters.judge(urls, url_filters.fit(urls)).select("page_id", "host", "path", "rule", "verdict", "tokens", "score")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents"), width=4, num=85, den=100)


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *quality_rules.STATISTICS, "base_failed", "kept")


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.dedup(_table(spark, sf_dir, "documents"), width=4, num=80, den=100)


def op13_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dominance.dominance(_table(spark, sf_dir, "sales"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return dict(sorted(own.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {"op9_source_mix": source_mix.ORACLE, "op10_quality_rules": quality_rules.ORACLE, "op13_dominance": dominance.ORACLE}
