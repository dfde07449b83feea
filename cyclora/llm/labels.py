"""Labelled documents, for fitting models: all of them, or a bounded sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learnt from: crc32 of the doc_id as text is 2 modulo 4. A null doc_id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled(labels: DataFrame, label: str) -> DataFrame:
    """Every labelled doc_id that is not held out, once, with ``label``; of several labels the largest. Null ones are left out."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias(label))
    )


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """The rows of ``docs`` of at most ``rows`` labelled doc_ids that are not held out, chosen by a hash, with ``label``.

    The bound is a parameter of the model that is fitted, not of what it is
    applied to. A doc_id with several labels has the largest; null labels and
    doc_ids are left out. A doc_id that ``docs`` repeats comes as often.
    """
    every = labelled(labels, label).withColumnRenamed(label, "__label")
    chosen = every.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    few = F.broadcast(chosen) if rows <= BROADCAST_ROWS else chosen
    return docs.select("doc_id", "text").join(few, "doc_id").withColumnRenamed("__label", label)


def one_each(measured: DataFrame) -> DataFrame:
    """One row for each doc_id: where texts of it differ, the one whose columns, in their order, are largest."""
    rest = [c for c in measured.columns if c != "doc_id"]
    return measured.groupBy("doc_id").agg(F.max(F.struct(*rest)).alias("__x")).select("doc_id", "__x.*")
