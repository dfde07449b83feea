"""Events: merging across windows, enrichment, representative texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cyclora.functions import text as T


def overlapping(new: DataFrame, current: DataFrame, share: float = 0.10) -> DataFrame:
    """Pairs (new_id, current_id, n_shared, n_new) of events of one date that share more than ``share`` of the new one's texts.

    Both sides are (event_id, date, text_id).
    """
    a = new.select(F.col("event_id").alias("new_id"), "date", "text_id").distinct()
    b = current.select(F.col("event_id").alias("current_id"), "date", "text_id").distinct()
    sizes = a.groupBy("new_id").agg(F.count(F.lit(1)).alias("n_new"))
    shared = a.join(b, ["date", "text_id"]).groupBy("new_id", "current_id").agg(F.count(F.lit(1)).alias("n_shared"))
    return shared.join(sizes, "new_id").where(F.col("n_shared") > share * F.col("n_new"))


def merge_windows(current: DataFrame, new: DataFrame, share: float = 0.10) -> DataFrame:
    """Events after a new window: (event_id, date, score, terms array<string>, text_ids array).

    A new event goes into every current one that it overlaps; the score is the
    greater one, texts are united (the new ones first) and terms are united
    and resolved. Overlap is with the current events as they were. New events
    that overlap none are added.
    """
    flat = lambda df: df.select("event_id", "date", F.explode("text_ids").alias("text_id"))
    pairs = overlapping(flat(new), flat(current), share)
    came = pairs.join(new.withColumnRenamed("event_id", "new_id"), "new_id").groupBy("current_id").agg(
        F.max("score").alias("new_score"),
        F.flatten(F.collect_list("terms")).alias("new_terms"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("new_id", "text_ids"))), lambda x: x["text_ids"])).alias("new_ids"),
    )
    zero = lambda terms: F.transform(F.array_sort(F.array_distinct(terms)), lambda t: F.struct(t.alias("term"), F.lit(0.0).alias("score")))
    terms = F.transform(T.resolve_overlap(zero(F.concat("new_terms", "terms"))), lambda e: e["term"])
    merged = current.join(came, current["event_id"] == came["current_id"], "left").select(
        "event_id",
        "date",
        F.greatest("score", "new_score").alias("score"),
        F.when(F.col("current_id").isNull(), F.col("terms")).otherwise(terms).alias("terms"),
        F.when(F.col("current_id").isNull(), F.col("text_ids")).otherwise(F.array_distinct(F.concat("new_ids", "text_ids"))).alias("text_ids"),
    )
    added = new.join(pairs.select(F.col("new_id").alias("event_id")), "event_id", "left_anti")
    return merged.unionByName(added.select(merged.columns))


def merge_members(events: DataFrame) -> DataFrame:
    """One event for each cluster of (cluster, score, terms array, text_ids array): greatest score, united terms and texts."""
    return events.groupBy("cluster").agg(
        F.max("score").alias("score"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("terms"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("text_ids")))).alias("text_ids"),
    )


def place_vote(places: DataFrame, share: float = 0.8, without: tuple[str, ...] = ("nederland",)) -> DataFrame:
    """id, place, share: the most named place of (id, place), if it has more than ``share`` of the id's mentions."""
    counted = places.where(~F.col("place").isin(*without)).groupBy("id", "place").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("id").agg(F.max(F.struct("n", F.col("place"))).alias("best"), F.sum("n").alias("all"))
    return best.select("id", F.col("best.place").alias("place"), (F.col("best.n") / F.col("all")).alias("share")).where(F.col("share") > share)


def drop_dates_and_places(terms: Column, places: Column) -> Column:
    """Terms without those that look like a date; null if none but places are left."""
    rest = F.filter(terms, lambda t: ~t.rlike(rf"^{T.DATE_LIKE}"))
    return F.when(F.exists(rest, lambda t: ~F.array_contains(places, t)), rest)


def _ordered(entities: list[str], texts: list[str]) -> list[str]:
    at = np.array([[t.find(e) for t in texts] for e in entities], dtype=np.int64).reshape(len(entities), len(texts))
    order = list(range(len(entities)))
    rank = list(order)
    for k in range(len(entities) - 1):
        both = (at[k] >= 0) & (at[k + 1 :] >= 0)
        majority = 2 * (both & (at[k] < at[k + 1 :])).sum(axis=1) - both.sum(axis=1)
        told = np.nonzero(majority)[0]
        for j, leads in zip((told + k + 1).tolist(), (majority[told] > 0).tolist(), strict=True):
            first, second = (k, j) if leads else (j, k)
            goal, old = rank[second], rank[first]
            if old > goal:  # the majority's first moves up to the other's place
                later = order[goal:old]
                order[goal : old + 1] = [first, *later]
                for e in later:
                    rank[e] += 1
                rank[first] = goal
    return [entities[k] for k in order]


def order_by_position(rows: DataFrame, entities: str = "entities", texts: str = "texts") -> DataFrame:
    """The rows, with distinct entities (an array) in the order in which most of the texts (an array) have them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch[entities] = [_ordered(list(dict.fromkeys(e)), list(t)) for e, t in zip(batch[entities], batch[texts], strict=True)]
            yield batch

    return rows.mapInPandas(run, rows.schema)


def text_scores(texts: DataFrame, weights: DataFrame) -> DataFrame:
    """event_id, text_id, text, score: the mean weight (event_id, term, weight) of those of a text's words that the event has."""
    words = texts.select("event_id", "text_id", F.explode(T.words(F.regexp_replace(F.translate(F.lower("text"), "-", " "), r"[#.,!?:;()\"'|]", ""))).alias("term"))
    mean = words.join(weights.select("event_id", "term", "weight"), ["event_id", "term"]).groupBy("event_id", "text_id").agg(F.avg("weight").alias("score"))
    return texts.join(mean, ["event_id", "text_id"], "left").select("event_id", "text_id", "text", F.round("score", 9).alias("score"))


def representative(scored: DataFrame, k: int = 5, most: float = 0.8) -> DataFrame:
    """event_id and the ``k`` texts of the highest score that differ in content; others fill up if there are too few.

    Content is the set of words that are no hashtag, user or address; two
    texts are alike if they share more than ``most`` of the larger one. Texts
    without a score come last, equal scores in order of text_id.
    """
    content = F.filter(F.array_distinct(T.words(F.col("text"))), lambda w: ~w.rlike("^(?:[#@]|http)"))
    item = F.struct((-F.coalesce("score", F.lit(-1.0))).alias("o"), "text_id", T.mask_urls(F.col("text")).alias("text"), content.alias("content"))
    lists = scored.groupBy("event_id").agg(F.array_sort(F.collect_list(item)).alias("x"))
    none = F.slice("x", 1, 0)

    def alike(a: Column, b: Column) -> Column:
        return F.size(F.array_intersect(a["content"], b["content"])) > most * F.greatest(F.size(a["content"]), F.size(b["content"]))

    def step(s: Column, x: Column) -> Column:
        full = F.size(s["kept"]) >= k
        dup = F.exists(s["kept"], lambda y: alike(x, y))
        return F.struct(
            F.when(full | dup, s["kept"]).otherwise(F.array_append(s["kept"], x)).alias("kept"),
            F.when(~full & dup & (F.size(s["rest"]) < k), F.array_append(s["rest"], x)).otherwise(s["rest"]).alias("rest"),
        )

    chosen = F.aggregate("x", F.struct(none.alias("kept"), none.alias("rest")), step, lambda s: F.slice(F.concat(s["kept"], s["rest"]), 1, k))
    return lists.select("event_id", F.transform(chosen, lambda x: x["text"]).alias("texts"))
