"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclora.sources.shared import is_parquet_scan, shared_folder

#: A word is a maximal run of characters other than space and U+0009..U+000D.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Most rows of a lookup table that may be broadcast. Beyond it the join is shuffled.
BROADCAST_ROWS = 20_000
#: A key with more than this part of all rows isn't left to one task.
HOT = 1000

#: Internal row identity; long enough not to meet a caller's own column.
ROW = "__cyclora_row"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set, read with Spark's own reader so that any store will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reclaim(spark: SparkSession) -> None:
    """Have the executors delete the shuffle files of plans that are no longer in use.

    Spark does that when the driver's JVM collects those plans, which is left
    to chance otherwise: files of many rounds would stay side by side.
    """
    spark._jvm.System.gc()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the cluster's shared folder."""
    shared_folder(df.sparkSession)
    reclaim(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder as Parquet and read it back."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}.parquet"
    reclaim(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """A table whose rows keep their identity each time they are read: a scan of Parquet files, anything else stored first.

    Rows of other sources, and those after a shuffle, may come in another
    order when they are computed again.
    """
    return df if is_parquet_scan(df) else stored(df)


def numbered(df: DataFrame) -> DataFrame:
    """Add an identity that tells rows of a settled table apart, even those that are equal.

    It is the row's file (a 64-bit hash of its path) and its place in that
    file, so it stays the same whatever splits the files are read in, now or
    after an executor was lost. Which of several equal rows has the least
    identity is arbitrary, but always the same one.
    """
    of = df.metadataColumn("_metadata")
    return df.withColumn(ROW, F.struct(F.xxhash64(of["file_path"]).alias("file"), of["row_index"].alias("at")))


def looked_up(rows: DataFrame, found: DataFrame, on: list[str], n: str) -> DataFrame:
    """Join ``rows`` with a table that has one row for each of their keys, and in ``n`` how many of ``rows`` have it.

    A key of more than a ``HOT``-th of all rows is broadcast, so that no task
    gets all its rows; there are fewer than ``HOT`` of those. The rest is
    shuffled, unless the whole table is small. ``n`` is dropped.
    """
    told = found.agg(F.count(F.lit(1)).alias("keys"), F.sum(n).alias("rows")).first()
    if told["keys"] <= BROADCAST_ROWS:
        return rows.join(F.broadcast(found.drop(n)), on)
    hot, cold = found.where(F.col(n) * HOT > told["rows"]), found.where(F.col(n) * HOT <= told["rows"])
    few = rows.join(F.broadcast(hot.drop(n)), on)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold.drop(n), on)
    return few.unionByName(rest)
