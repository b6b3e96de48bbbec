"""The queries of this subpackage, by name, and their SQL where DuckDB can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kindred.llm import bestfit, chat, exactfit, graph, lm, mixing, near, quality, toxicity, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_pruned_graph_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.grouped(table(spark, sf_dir, "embeddings"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.result(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op1_best_fit_decreasing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.packed(table(spark, sf_dir, "documents"))


def op2_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(table(spark, sf_dir, "documents"), least=1)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.result(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.result(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op5_exact_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactfit.packed(table(spark, sf_dir, "documents"))


def op8_bottom_k_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.grouped(table(spark, sf_dir, "documents"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(table(spark, sf_dir, "conversations"))


def op10_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.result(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_decreasing,
        op2_deleted_interpolation,
        op3_mixing,
        op4_url_filter,
        op5_exact_fit_packing,
        op6_pruned_graph_near_dedup,
        op7_quality_rules,
        op8_bottom_k_near_dedup,
        op9_chat_formatting,
        op10_compression_toxicity,
    )
}

SQL: dict[str, str] = {"op3_mixing": mixing.SQL, "op6_pruned_graph_near_dedup": graph.SQL, "op7_quality_rules": quality.SQL, "op8_bottom_k_near_dedup": near.SQL, "op9_chat_formatting": chat.SQL}
