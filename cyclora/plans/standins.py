"""Views of the test tables that stand for the notions of the domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclora.sources.shared import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences (date, entity, text) from events: the type is the entity, the value the text."""
    return table(spark, sf_dir, "events").select(F.to_date("ts").alias("date"), F.col("event_type").alias("entity"), F.col("value").cast("string").alias("text"))


def keyed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events (id, date, k, event_type, user_id, value) with the number in their properties."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.to_date("ts").alias("date"), F.get_json_object("props", "$.k").cast("int").alias("k"), "event_type", "user_id", "value"
    )


def dense_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms with many dates: suppliers and the days that they ship on."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("term"), F.to_date("l_shipdate").alias("date"))


def sparse_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms with few dates: customers and the days that they order on."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("term"), F.to_date("o_orderdate").alias("date"))


def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, tokens) of documents."""
    from cyclora.functions.text import terms

    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("id"), terms(F.col("text")).alias("tokens"))
