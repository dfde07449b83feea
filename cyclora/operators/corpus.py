"""Counts over texts: n-grams, link probability, TF-IDF, inverted index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cyclora.functions import text as T
from cyclora.functions.numbers import rounded
from cyclora.operators import blocks
from cyclora.sources.shared import shared_folder


def ngram_counts(items: DataFrame, longest: int = 5, least: int = 1) -> DataFrame:
    """ngram, n, n_total of token arrays (tokens), with at least ``least`` occurrences."""
    grams = items.select(F.explode(T.ngrams(F.col("tokens"), longest)).alias("ngram"))
    counted = grams.groupBy("ngram").agg(F.count(F.lit(1)).alias("n_total"))
    return counted.where(F.col("n_total") >= least).withColumn("n", F.size(F.split("ngram", " ")))


#: Most n-grams that are sent to all tasks.
_FEW = 200_000


def _known(ngrams: DataFrame) -> DataFrame:
    """N-grams to look others up in, sent to all tasks if they are few: those of the corpus then aren't shuffled to find that most aren't there."""
    return F.broadcast(ngrams) if ngrams.limit(_FEW + 1).count() <= _FEW else ngrams


def commonness(anchors: DataFrame, corpus: DataFrame, longest: int = 5) -> DataFrame:
    """ngram, n_anchor, n_total, commonness: how often an n-gram of the corpus is an anchor.

    ``anchors`` has one anchor text per row (ngram); only n-grams that are
    anchors are counted in the corpus (tokens).
    """
    marked = anchors.groupBy("ngram").agg(F.count(F.lit(1)).alias("n_anchor"))
    marked = marked.where(F.size(F.split("ngram", " ")) <= longest)
    grams = corpus.select(F.explode(T.ngrams(F.col("tokens"), longest)).alias("ngram"))
    seen = grams.join(_known(marked.select("ngram")), "ngram", "left_semi").groupBy("ngram").agg(F.count(F.lit(1)).alias("n_total"))
    return marked.join(seen, "ngram").withColumn("commonness", F.col("n_anchor") / F.col("n_total"))


def link(items: DataFrame, known: DataFrame, threshold: float = 0.05, longest: int = 5) -> DataFrame:
    """id, ngram, commonness for each occurrence of a known n-gram above the threshold in token arrays (id, tokens)."""
    grams = items.select("id", F.explode(T.ngrams(F.col("tokens"), longest)).alias("ngram"))
    shared_folder(known.sparkSession)
    strong = known.where(F.col("commonness") > threshold).select("ngram", "commonness").checkpoint()  # counted, then looked up
    return grams.where(T.linkable(F.col("ngram"))).join(_known(strong), "ngram")


def inverted_index(items: DataFrame) -> DataFrame:
    """term and its postings (sorted distinct ids) of (id, tokens)."""
    return items.select("id", F.explode("tokens").alias("term")).groupBy("term").agg(F.array_sort(F.collect_set("id")).alias("postings"))


def tfidf(items: DataFrame) -> DataFrame:
    """id, term, tf, weight of (id, tokens): tf * (ln((1 + N) / (1 + df)) + 1), rows of unit length.

    Texts move once, to their id; counts within a text and its length then
    need no other shuffle than that of document frequencies.
    """
    items = items.repartition("id")
    n = items.agg(F.count(F.lit(1)).alias("__docs"))
    tf = items.select("id", F.explode("tokens").alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = tf.join(df, "term").crossJoin(F.broadcast(n))
    raw = raw.withColumn("raw", F.col("tf") * (F.log((1.0 + F.col("__docs")) / (1.0 + F.col("df"))) + 1.0))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("id")))
    return raw.select("id", "term", "tf", (F.col("raw") / norm).alias("weight"))


def top_terms(weights: DataFrame, k: int = 4) -> DataFrame:
    """The ``k`` heaviest terms of each id; equal weights in the order of the alphabet."""
    order = Window.partitionBy("id").orderBy(F.desc("weight"), "term")
    return weights.withColumn("weight", rounded("weight", 6)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def cosines(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """a, b, cosine of candidate pairs (a, b): the sum of products of shared terms, 0 without one."""
    left = weights.select(F.col("id").alias("a"), "term", F.col("weight").alias("wa"))
    right = weights.select(F.col("id").alias("b"), "term", F.col("weight").alias("wb"))
    shared = pairs.join(left, "a").join(right, ["b", "term"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))
    return pairs.join(shared, ["a", "b"], "left").fillna(0.0, ["cosine"])


def similar_pairs(weights: DataFrame, threshold: float, keys: DataFrame | None = None) -> DataFrame:
    """a < b and cosine of all pairs of ids (id, term, weight; rows of unit length) whose cosine is above a positive threshold.

    With ``keys`` (id, key), only pairs with an equal key. Nothing is compared
    but sets that can be similar: in an order of terms from rare to frequent,
    the first term that two sets share must be one from which on either is
    still as long as the threshold, since the cosine is at most the product of
    what is left of both. Without keys, sets meet in blocks, so that neither
    candidates nor their terms are kept.
    """
    if keys is None:
        return blocks.similar(blocks.coded(weights.select("id", "term", "weight")), threshold).withColumnRenamed("value", "cosine")
    frequency = weights.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rest = Window.partitionBy("id").orderBy(F.desc("df"), F.desc("term")).rowsBetween(Window.unboundedPreceding, 0)
    left = F.sum(F.col("weight") * F.col("weight")).over(rest)
    heads = weights.join(frequency, "term").withColumn("left", left).where(F.col("left") >= threshold * threshold - 1e-9)
    heads = heads.select("id", "term").join(keys.select("id", "key"), "id")
    side = lambda k: heads.select("key", "term", F.col("id").alias(k))
    pairs = side("a").join(side("b"), ["key", "term"]).where("a < b").select("a", "b").distinct()
    return cosines(pairs, weights).where(F.col("cosine") > threshold)


def mentions(items: DataFrame, names: DataFrame, longest: int = 4) -> DataFrame:
    """id and name for each occurrence of a name (name, lower case) in token arrays (id, tokens).

    For a gazetteer that is too long for one pattern.
    """
    grams = items.select("id", F.explode(T.ngrams(F.col("tokens"), longest)).alias("name"))
    return grams.join(names.select("name").distinct(), "name").select("id", "name")
