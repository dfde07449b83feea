"""Positions and running sums over all rows in a total order, without gathering the rows in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cyclora.sources.shared import shared_folder


def running_sums(rows: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """Add sums over the rows before each row in the order given: ``sums`` maps a new column to the column summed.

    The order must be total. Rows are ranged by it, so no partition holds more
    than its share even where one key has many rows; each partition gives one
    total, and those before it are added to its own running sums. The ranged
    rows are kept in the shared folder, so that all steps see the same ranges.
    """
    shared_folder(rows.sparkSession)
    ranged = rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()).checkpoint()
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("__part").agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    offsets = totals.select("__part", *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums])
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # one row for each partition: its size is bounded by the number of partitions
    return (
        ranged.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()})
        .join(F.broadcast(offsets), "__part")
        .withColumns({n: F.col(n) + F.col(f"__o_{n}") for n in sums})
        .drop("__part", *[f"__o_{n}" for n in sums])
    )


def positions(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add the number of rows before each row."""
    return running_sums(rows.withColumn("__one", F.lit(1).cast("long")), order, {name: "__one"}).drop("__one")
