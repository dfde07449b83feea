"""Pairs of date and entity: counts, support, association, windows of days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclora.functions.association import g_squared
from cyclora.functions.numbers import rounded
from cyclora.operators.order import running_sums


def pair_counts(pairs: DataFrame) -> DataFrame:
    """date, entity, n_both (occurrences), n_texts (distinct texts), n_date, n_entity of occurrences (date, entity, text).

    Marginal counts cover all occurrences, before any filter on support.
    """
    both = pairs.groupBy("date", "entity").agg(F.count(F.lit(1)).alias("n_both"), F.countDistinct("text").alias("n_texts"))
    dates = both.groupBy("date").agg(F.sum("n_both").alias("n_date"))
    entities = both.groupBy("entity").agg(F.sum("n_both").alias("n_entity"))
    return both.join(dates, "date").join(entities, "entity")


def rank_events(pairs: DataFrame, total: DataFrame, support: int = 5, top: int | None = 2500, expected_only: bool = False) -> DataFrame:
    """Events: the pairs with the highest association.

    ``total`` has one row with n_total, the number of texts. Pairs of fewer
    than ``support`` distinct texts are left out. With ``expected_only``,
    pairs rarer than expected are too. Ties are in the order of date, entity.
    """
    counted = pair_counts(pairs).where(F.col("n_texts") >= support).crossJoin(F.broadcast(total.select("n_total")))
    scored = counted.withColumn("g2", g_squared(F.col("n_total"), F.col("n_date"), F.col("n_entity"), F.col("n_both")))
    if expected_only:
        scored = scored.where(F.col("n_both") * F.col("n_total") > F.col("n_date") * F.col("n_entity"))
    # compared as rounded, so that sums in another order don't change the order of ties
    scored = scored.withColumn("g2", rounded("g2", 6))
    return scored.orderBy(F.desc("g2"), "date", "entity").limit(top) if top else scored


def recent_days(rows: DataFrame, days: int = 7, date: str = "date") -> DataFrame:
    """Rows of the last ``days`` distinct dates that are present (not of the last calendar days)."""
    # the dates kept are a handful: their number is the parameter
    kept = rows.select(date).distinct().orderBy(F.desc(date)).limit(days)
    return rows.join(F.broadcast(kept), date, "left_semi")


def enough_days(rows: DataFrame, least: int = 6, date: str = "date") -> DataFrame:
    """All rows if they are of at least ``least`` distinct dates, none otherwise."""
    gate = rows.agg(F.countDistinct(date).alias("__days")).where(F.col("__days") >= least)
    return rows.crossJoin(F.broadcast(gate)).drop("__days")


def warmed_up(rows: DataFrame, skip: int = 30, date: str = "date") -> DataFrame:
    """Rows of dates from the (skip + 1)th distinct one on."""
    first = rows.select(date).distinct().orderBy(date).limit(skip)
    return rows.join(F.broadcast(first), date, "left_anti")


def co_occurrence(items: DataFrame) -> DataFrame:
    """a < b, n_a, n_b, n_both, n_baskets of items (basket, item): how many baskets have each and both.

    Pairs are of items of one basket, so their number is bounded by the size
    of baskets, which callers keep small.
    """
    one = items.select("basket", "item").distinct()
    single = one.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    baskets = one.agg(F.countDistinct("basket").alias("n_baskets"))
    both = (
        one.select("basket", F.col("item").alias("a"))
        .join(one.select("basket", F.col("item").alias("b")), "basket")
        .where("a < b")
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("n_both"))
    )
    return (
        both.join(single.select(F.col("item").alias("a"), F.col("n").alias("n_a")), "a")
        .join(single.select(F.col("item").alias("b"), F.col("n").alias("n_b")), "b")
        .crossJoin(F.broadcast(baskets))
    )


def running_precision(judged: DataFrame, score: str, correct: str, tie: str) -> DataFrame:
    """Rank (by falling score, then ``tie``) and precision of the rows up to it. Null scores come last."""
    rows = judged.withColumns({"__s": F.coalesce(-F.col(score), F.lit(float("inf"))), "__one": F.lit(1).cast("long")})
    rows = running_sums(rows, ["__s", tie], {"__n": "__one", "__c": correct})
    return rows.withColumns(
        {"rank": F.col("__n") + 1, "precision": (F.col("__c") + F.col(correct)).cast("double") / (F.col("__n") + 1)}
    ).drop("__s", "__one", "__n", "__c")
