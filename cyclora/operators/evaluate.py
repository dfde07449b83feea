"""Measures over judged results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cyclora.operators.order import positions


def prf(rows: DataFrame, gold: str, guess: str, *by: str) -> DataFrame:
    """n, precision, recall and f1 of 0/1 columns, null where a measure does not exist."""
    hits = F.sum((F.col(gold) * F.col(guess)).cast("double"))
    got = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.try_divide(hits, F.sum(guess)).alias("precision"), F.try_divide(hits, F.sum(gold)).alias("recall")
    )
    f1 = F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return got.withColumn("f1", f1)


def lax_match(gold: DataFrame, system: DataFrame) -> DataFrame:
    """id, term, matched: whether each gold term of an id has a system term that contains it or is contained in it."""
    s = system.groupBy("id").agg(F.collect_set("term").alias("__s"))  # of one text each
    alike = F.exists("__s", lambda t: t.contains(F.col("term")) | F.col("term").contains(t))
    return gold.join(s, "id", "left").select("id", "term", F.coalesce(alike, F.lit(False)).alias("matched"))


def accuracy_by_threshold(judged: DataFrame, thresholds: DataFrame, score: str = "score", correct: str = "correct", at_most: bool = False) -> DataFrame:
    """threshold, n, accuracy of the rows at or above (or at or below) each threshold; null without rows.

    Rows are summed by score first, so that what meets the thresholds is as
    small as the scores are few.
    """
    by_score = judged.groupBy(F.col(score).alias("__s")).agg(F.sum(correct).alias("__c"), F.count(F.lit(1)).alias("__n"))
    passes = F.col("__s") <= F.col("threshold") if at_most else F.col("__s") >= F.col("threshold")
    got = by_score.join(F.broadcast(thresholds), passes).groupBy("threshold").agg(F.sum("__n").alias("n"), F.sum("__c").alias("__c"))
    got = thresholds.join(got, "threshold", "left").fillna(0, ["n", "__c"])
    return got.select("threshold", "n", F.try_divide(F.col("__c").cast("double"), "n").alias("accuracy"))


def share_of(rows: DataFrame, label: str) -> DataFrame:
    """label, n, share of all rows."""
    counted = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1)).alias("__all"))
    return counted.crossJoin(F.broadcast(total)).select(label, "n", (F.col("n") / F.col("__all")).alias("share"))


def histogram(rows: DataFrame, feature: str, first: int, last: int) -> DataFrame:
    """bin, n, share for each whole number from ``first`` to ``last``, 0 where there is none."""
    bins = rows.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("bin"))
    counted = share_of(rows.where(F.col(feature).isNotNull()), feature).withColumnRenamed(feature, "bin")
    return bins.join(counted, "bin", "left").fillna(0, ["n"]).fillna(0.0, ["share"])


def compare_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """n_a, n_b, n_both, n_only_a, n_only_b, n_any of the distinct keys of two tables."""
    one = a.select(key).distinct().withColumn("__a", F.lit(1))
    two = b.select(key).distinct().withColumn("__b", F.lit(1))
    both = one.join(two, key, "full")
    n = lambda c: F.count(F.when(c, 1))
    has_a, has_b = F.col("__a").isNotNull(), F.col("__b").isNotNull()
    return both.agg(
        n(has_a).alias("n_a"), n(has_b).alias("n_b"), n(has_a & has_b).alias("n_both"), n(has_a & ~has_b).alias("n_only_a"), n(has_b & ~has_a).alias("n_only_b"), F.count(F.lit(1)).alias("n_any"),
    )


def event_vote(votes: Column, n: int) -> Column:
    """Verdict of ``n`` annotators (4 or 2) from the array of their votes, 1 for an event."""
    yes = F.size(F.filter(votes, lambda v: v == 1))
    if n == 4:
        return F.element_at(F.array(*map(F.lit, ["no_event", "25", "50", "75", "event"])), yes + 1)
    return F.when(yes == 0, "no_event").when(yes == 1, "50").otherwise("event")


def term_vote(a: Column, b: Column) -> Column:
    """Verdict on a term from two votes: 1 good, 2 medium, 3 bad, null missing."""
    told = lambda v: F.when(v == 1, "GOOD").when(v == 2, "MED").when(v == 3, "BAD").otherwise("MISS")
    return (
        F.when(a.isNull() & b.isNull(), "MISS").when(a.isNull(), told(b)).when(b.isNull() | (a == b), told(a))
        .when((a == 3) | (b == 3), F.when((a == 1) | (b == 1), "MIXED").otherwise("BAD")).otherwise("MED")
    )


def predictions_met(predictions: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Predictions (terms array, date, ...) with correct: whether any of the terms occurs on the date."""
    rows = predictions.withColumn("__id", F.xxhash64("terms", "date"))
    hits = rows.select("__id", "date", F.explode("terms").alias("term")).join(occurrences.select("term", "date").distinct(), ["term", "date"], "left_semi")
    seen = hits.select("__id").distinct().withColumn("__hit", F.lit(1))
    return rows.join(seen, "__id", "left").withColumn("correct", F.coalesce("__hit", F.lit(0))).drop("__id", "__hit")


def first_predictions(predictions: DataFrame) -> DataFrame:
    """The earliest prediction of each term set."""
    order = Window.partitionBy("terms").orderBy("date")
    return predictions.withColumn("__k", F.row_number().over(order)).where("__k = 1").drop("__k")


def allocate(items: DataFrame, n_sets: int, copies: int = 2, seed: int = 0) -> DataFrame:
    """id and set: each item in ``copies`` different ones of ``n_sets`` sets of nearly equal size, in an order hashed from the seed."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")))
    shift = max(1, n_sets // copies)
    placed = positions(items.select("id", order.alias("__o")), ["__o", "id"], "__p")
    return placed.select("id", F.explode(F.array(*[(F.col("__p") + F.lit(k * shift)) % n_sets for k in range(copies)])).alias("set"))


def entity_scores(gold: DataFrame, system: DataFrame, lax: bool = False) -> DataFrame:
    """n_right, n_system, n_gold, precision, recall, f1 of the entities (id, term) that a system found.

    Strict matches are equal; with ``lax`` an entity that contains one of the
    other side's, or is contained in one, is right. A measure that does not
    exist is null.
    """
    gold, system = (x.select("id", "term").distinct() for x in (gold, system))
    if lax:
        found = lax_match(system, gold).agg(F.count(F.when(F.col("matched"), 1)).alias("n_right"), F.count(F.lit(1)).alias("n_system"))
        missed = lax_match(gold, system).agg(F.count(F.when(F.col("matched"), 1)).alias("n_met"), F.count(F.lit(1)).alias("n_gold"))
        counts = found.crossJoin(F.broadcast(missed))
    else:
        c = compare_sets(system.withColumn("__k", F.struct("id", "term")), gold.withColumn("__k", F.struct("id", "term")), "__k")
        counts = c.select(F.col("n_both").alias("n_right"), F.col("n_a").alias("n_system"), F.col("n_both").alias("n_met"), F.col("n_b").alias("n_gold"))
    p, r = F.try_divide(F.col("n_right").cast("double"), "n_system"), F.try_divide(F.col("n_met").cast("double"), "n_gold")
    return counts.select("n_right", "n_system", "n_gold", p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"))


def pooled(a: DataFrame, b: DataFrame) -> DataFrame:
    """system, precision, recall, f1 of two systems' judged terms (term, correct): recall is over all terms that either has right."""
    both = a.select(F.lit("a").alias("system"), "term", "correct").unionByName(b.select(F.lit("b").alias("system"), "term", "correct"))
    each = both.groupBy("system", "term").agg(F.max("correct").alias("correct"))
    right = each.where("correct = 1").agg(F.countDistinct("term").alias("__all"))
    got = each.groupBy("system").agg(F.avg("correct").alias("precision"), F.sum("correct").cast("double").alias("__c")).crossJoin(F.broadcast(right))
    got = got.withColumn("recall", F.try_divide("__c", "__all"))
    f1 = F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return got.select("system", "precision", "recall", f1.alias("f1"))


def three_way(gold: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """id, gold, first, second: the entities (id, entities array) of two systems beside those of every gold row; none is an empty array."""
    none = F.array().cast("array<string>")
    side = lambda df, name: df.groupBy("id").agg(F.flatten(F.collect_list("entities")).alias(name))  # noqa: E731  of one text
    got = gold.select("id", F.col("entities").alias("gold")).join(side(first, "first"), "id", "left").join(side(second, "second"), "id", "left")
    return got.select("id", "gold", F.coalesce("first", none).alias("first"), F.coalesce("second", none).alias("second"))


def coverage(a: DataFrame, b: DataFrame, total: DataFrame, key: str) -> DataFrame:
    """share_a, share_b, share_both, share_any: of all keys, in percent, those that two taggers have."""
    counts = compare_sets(a, b, key).crossJoin(F.broadcast(total.agg(F.countDistinct(key).alias("__all"))))
    return counts.select(*[F.try_divide(F.col(f"n_{c}") * 100.0, "__all").alias(f"share_{c}") for c in ("a", "b", "both", "any")])


def step_statistics(steps: DataFrame) -> DataFrame:
    """n, mean, deviation (population) and median of (step)."""
    return steps.agg(F.count("step").alias("n"), F.avg("step").alias("mean"), F.stddev_pop("step").alias("deviation"), F.median("step").alias("median"))


def pattern_kind(pattern: Column) -> Column:
    """What a pattern string <year,month,week,day,weekday,nth> says: yearly or monthly date or nth weekday, yearly week, or weekly."""
    slots = F.split(F.translate(pattern, "<>", ""), ",")
    fixed = lambda k: F.get(slots, F.lit(k)).rlike("^[0-9]+$")
    recurs = F.when(slots[0] == "e", "yearly").when(slots[1] == "e", "monthly").when(slots[2] == "e", "weekly")
    what = F.when(fixed(3), " date").when(fixed(5), " nth weekday").when(fixed(2), " week").otherwise("")
    return F.concat(recurs, what)


def answers(allocated: DataFrame, given: DataFrame) -> DataFrame:
    """The votes (survey, pos, vote) on allocated items (survey, pos, system, item): one row for each system and item, with the array of its votes in order of surveys."""
    rows = allocated.join(given, ["survey", "pos"])
    votes = F.array_sort(F.collect_list(F.struct("survey", "vote")))  # a few annotators
    return rows.groupBy("system", "item").agg(F.transform(votes, lambda v: v["vote"]).alias("votes"))
