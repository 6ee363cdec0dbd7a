"""The queries opN_<name> and pipeline: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_tree, fair_queue, knn_quality, lexical_search, lm_scoring, mincut_html, minhash_forest, periodic_runs, prefix_counts, robust_rules, suffix_dedup, syncmers, warc_revisits

Query = Callable[[SparkSession, str], DataFrame]


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = labels.where("quality = 1").select(F.col("doc_id").alias("id"))
    return lm_scoring.score(spark.read.parquet(f"{sf_dir}/documents.parquet"), good)


def op2_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return minhash_forest.components(docs, shingle=3, num=85, den=100)


def op3_column_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return suffix_dedup.cut(docs).drop("kept")


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return warc_revisits.resolve(warc_revisits.records_of_pages(pages))


def op5_robust_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust_rules.verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_fair_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair_queue.shares(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return knn_quality.scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compare(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_mincut_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mincut_html.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe_tree.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.with_planted_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return periodic_runs.digests(periodic_runs.periodic_runs(docs))


def op12_max_sketch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return prefix_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


QUERIES: dict[str, Query] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_minhash_forest": op2_minhash_forest,
    "op3_column_suffix_dedup": op3_column_suffix_dedup,
    "op4_warc_revisits": op4_warc_revisits,
    "op5_robust_rules": op5_robust_rules,
    "op6_fair_queue": op6_fair_queue,
    "op7_knn_quality": op7_knn_quality,
    "op8_closed_syncmers": op8_closed_syncmers,
    "op9_mincut_html": op9_mincut_html,
    "op10_bpe_tree": op10_bpe_tree,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_max_sketch_search": op12_max_sketch_search,
    "op13_prefix_counts": op13_prefix_counts,
}

ORACLE_SQL: dict[str, str] = {
    "op4_warc_revisits": warc_revisits.RESOLVE_SQL,
    "op6_fair_queue": fair_queue.SHARES_SQL,
    "op12_max_sketch_search": lexical_search.SEARCH_SQL,
}
