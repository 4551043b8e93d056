"""Queries of the text problems, over whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from candlery.llm import encode, packing, retellings, sentences
from candlery.session import ensure_checkpoint_dir

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def _news(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/news_items.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return retellings.similar_pairs(_news(spark, folder), "news_id", "title", "summary").toDF("news_id_a", "news_id_b")


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return retellings.story_groups(_news(spark, folder), "news_id", "title", "summary").withColumnRenamed("item", "news_id")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode.encode_documents(_documents(spark, folder))


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return packing.pack_documents(_documents(spark, folder))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.split_documents(_documents(spark, folder))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in [p1_found, p1_groups, p7_ids, p8_containers, p9_found]}


def oracle_sql() -> dict[str, str]:
    return {}
