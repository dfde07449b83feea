"""Enrichment of events: salient words, the place, the order of terms, the variety of the texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cyclora.functions import text as T
from cyclora.operators import corpus, events


def tag_counts(tags: DataFrame) -> DataFrame:
    """id, word, tag, n of (id, tags array<struct<word,tag>>)."""
    each = tags.select("id", F.explode("tags").alias("t"))
    return each.groupBy("id", F.col("t.word").alias("word"), F.col("t.tag").alias("tag")).agg(F.count(F.lit(1)).alias("n"))


def salient(weights: DataFrame, words: DataFrame, k: int = 4) -> DataFrame:
    """Of the ``k`` heaviest terms (id, term, weight) of each event, those that are among its words (id, word) and begin with neither ~ nor a digit."""
    top = corpus.top_terms(weights, k).where(~F.col("term").rlike("^[~0-9]"))
    return top.join(words.select("id", F.col("word").alias("term")).distinct(), ["id", "term"], "left_semi").select("id", "term", "rank")


def variety(texts: DataFrame) -> DataFrame:
    """id and ratio: distinct words over words of all texts (id, text) of an event; none without words."""
    words = texts.select("id", F.explode(T.words(F.lower("text"))).alias("w")).groupBy("id", "w").agg(F.count(F.lit(1)).alias("n"))
    return words.groupBy("id").agg((F.count(F.lit(1)) / F.sum("n")).alias("ratio"))


def enrich(found: DataFrame, texts: DataFrame, words: DataFrame, places: DataFrame | None = None, k: int = 4, place_share: float = 0.8) -> DataFrame:
    """id, terms, ratio of events (id, entities array<struct<term,score>>).

    ``texts`` is (id, text_id, text), ``words`` (id, word) what may be added,
    ``places`` (id, place). Entities that overlap are resolved; up to ``k``
    salient words that no entity contains and then the place (if it has more
    than its share of mentions) are added; terms are put in the order in which
    most texts have them. An event without a text has a null ratio.
    """
    weights = corpus.tfidf(texts.groupBy("id").agg(F.flatten(F.collect_list(T.terms(F.col("text")))).alias("tokens")))
    kept = found.select("id", F.transform(T.resolve_overlap(F.col("entities")), lambda e: e["term"]).alias("terms"))
    new = salient(weights, words, k).join(kept, "id").where(~F.exists("terms", lambda t: t.contains(F.col("term"))))
    added = new.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("added"))  # k at most
    none = F.array().cast("array<string>")
    out = kept.join(added, "id", "left").withColumn("terms", F.concat("terms", F.coalesce("added", none))).drop("added")
    if places is not None:
        best = events.place_vote(places, place_share).select("id", "place")
        out = out.join(best, "id", "left").withColumn("terms", F.when(F.col("place").isNull(), F.col("terms")).otherwise(F.array_append("terms", F.col("place")))).drop("place")
    bodies = texts.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("text_id", F.lower("text").alias("t")))), lambda x: x["t"]).alias("texts"))
    placed = out.join(bodies, "id", "left").withColumn("texts", F.coalesce("texts", none))
    ordered = events.order_by_position(placed.withColumnRenamed("terms", "entities")).select("id", F.col("entities").alias("terms"))
    return ordered.join(variety(texts), "id", "left")


def leading(texts: DataFrame, k: int) -> DataFrame:
    """The first ``k`` texts (id, text_id, text) of each event."""
    order = Window.partitionBy("id").orderBy("text_id")
    return texts.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= k).drop("__k")
