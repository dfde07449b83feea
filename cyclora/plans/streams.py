"""Streams over the test tables, run to their end; batch SQL says what they should give."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclora.plans.registry import query
from cyclora.sources.shared import shared_folder
from cyclora.streaming import windows as W


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # the pattern makes a single file a stream of files
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _finish(rows: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all there is and read what it wrote to the shared folder."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    sink = rows.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}/progress")
    sink.trigger(availableNow=True).start(f"{path}/rows").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/rows")


@query(
    """WITH e AS (SELECT ts::DATE AS d, event_type AS entity FROM events),
w AS (SELECT (d - k::INTEGER)::TIMESTAMP AS start, entity FROM e, range(0, 7) AS r(k)), m AS (SELECT max(ts) - INTERVAL 1 DAY AS late FROM events)
SELECT start::DATE AS start, entity, count(*) AS n FROM w, m WHERE start + INTERVAL 7 DAY <= late GROUP BY ALL"""
)
def stream_sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of seven days that the watermark has closed at the end of the stream."""
    stream = _stream(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("entity"))
    return _finish(W.sliding_counts(stream)).select(F.to_date("start").alias("start"), "entity", "n")


@query(
    """WITH d AS (SELECT DISTINCT ts::DATE AS d FROM events ORDER BY d DESC LIMIT 7)
SELECT ts::DATE AS date, event_type AS entity, count(*) AS n FROM events WHERE ts::DATE IN (SELECT d FROM d) GROUP BY ALL"""
)
def stream_day_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the window of days at the end of the stream."""
    stream = _stream(spark, sf_dir, "events").select(F.to_date("ts").alias("date"), F.col("event_type").alias("entity"), F.col("value").cast("string").alias("text"))
    path = f"{shared_folder(spark)}/days-{uuid.uuid4().hex}"
    last: list[int] = []
    W.day_windows(stream, path, lambda _, number: last.append(number)).awaitTermination()
    return spark.read.parquet(f"{path}/batch={max(last)}").groupBy("date", "entity").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT * FROM (SELECT o_custkey::VARCHAR AS term, date, (date - lag(date) OVER (PARTITION BY o_custkey ORDER BY date))::INTEGER AS interval
FROM (SELECT DISTINCT o_custkey, o_orderdate::DATE AS date FROM orders)) WHERE interval IS NOT NULL"""
)
def stream_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of customers' orders from state that is kept by customer."""
    stream = _stream(spark, sf_dir, "orders").select(F.col("o_custkey").alias("term"), F.to_date("o_orderdate").alias("date"))
    return _finish(W.running_intervals(stream)).select("term", "date", "interval")
