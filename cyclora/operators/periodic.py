"""Periodicity of terms: intervals between their dates, and calendar patterns.

A calendar pattern has the columns every ('year', 'month' or 'week'), month,
week, day, weekday and nth, null where the slot is free. A candidate is a
pattern with the sorted array of dates that it covers. Everything is columns
and aggregates; loops over a term's own dates are higher-order functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cyclora.functions.dates import features
from cyclora.operators.cluster import components, leaders, overlapping_sets

SLOTS = ["month", "week", "day", "weekday", "nth"]
#: Most steps that count as periodic.
LONGEST_STEP = 6


def term_dates(rows: DataFrame) -> DataFrame:
    """Distinct (term, date); repeated mentions on a day are one."""
    return rows.select("term", "date").where("term is not null and date is not null").distinct()


def intervals(dates: DataFrame) -> DataFrame:
    """term, date, pos (from 1), interval: days since the term's date before; the first date has none."""
    order = Window.partitionBy("term").orderBy("date")
    return dates.select(
        "term", "date", (F.row_number().over(order) - 1).alias("pos"), F.datediff("date", F.lag("date").over(order)).alias("interval")
    ).where("interval is not null")


def relative_deviation(gaps: DataFrame, least: int = 2, more_than: int = 5) -> DataFrame:
    """term, n, score: 100 * population deviation / mean of a term's intervals, if all are longer than ``more_than`` days."""
    return (
        gaps.groupBy("term")
        .agg(F.count("interval").alias("n"), F.min("interval").alias("least"), (100 * F.stddev_pop("interval") / F.avg("interval")).alias("score"))
        .where((F.col("n") >= least) & (F.col("least") > more_than))
        .select("term", "n", "score")
    )


def calm(gaps: DataFrame, n: int = 15, share: float = 0.3) -> DataFrame:
    """Terms that may be searched for calendar patterns: not those of more than ``n`` intervals with over ``share`` of one day."""
    ones = F.count(F.when(F.col("interval") == 1, 1))
    return gaps.groupBy("term").agg(F.count(F.lit(1)).alias("n"), ones.alias("n_ones")).where(~((F.col("n") > n) & (F.col("n_ones") > share * F.col("n"))))


def modal_step(gaps: DataFrame) -> DataFrame:
    """term, step, n: the most frequent interval; of equally frequent ones that seen first."""
    counted = gaps.groupBy("term", "interval").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    best = F.max_by(F.struct("interval", "n"), F.struct("n", -F.col("first")))
    return counted.groupBy("term").agg(best.alias("best")).select("term", F.col("best.interval").alias("step"), F.col("best.n").alias("n"))


def segments(gaps: DataFrame) -> DataFrame:
    """term, start, n, score of each run of two or more intervals: relative deviation + 100 - n / all * 100 (less is better).

    Sums of a run are differences of running sums, so a run costs the same
    whatever its length. Sums of whole numbers are exact.
    """
    upto = Window.partitionBy("term").orderBy("pos", "interval").rowsBetween(Window.unboundedPreceding, 0)
    x = F.col("interval").cast("double")
    summed = gaps.select("term", F.row_number().over(Window.partitionBy("term").orderBy("pos", "interval")).alias("at"), F.sum(x).over(upto).alias("s"), F.sum(x * x).over(upto).alias("q"))
    zero = F.array(F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q")))
    lists = summed.groupBy("term").agg(F.array_sort(F.collect_list(F.struct("at", "s", "q"))).alias("x"))
    lists = lists.select("term", F.concat(zero, "x").alias("x"), F.size("x").alias("all")).where(F.col("all") >= 2)
    starts = lists.withColumn("start", F.explode(F.sequence(F.lit(1), F.col("all") - 1)))
    each = starts.withColumn("n", F.explode(F.sequence(F.lit(2), F.col("all") - F.col("start") + 1)))
    before, last = F.element_at("x", F.col("start")), F.element_at("x", F.col("start") + F.col("n"))
    mean = (last["s"] - before["s"]) / F.col("n")
    deviation = F.sqrt(F.greatest((last["q"] - before["q"]) / F.col("n") - mean * mean, F.lit(0.0)))
    return each.select("term", "start", "n", (100 * deviation / mean + 100 - F.col("n") / F.col("all") * 100).alias("score"))


def _pattern(rows: DataFrame, every: str, *slots: str) -> list[Column]:
    free = {"month": "int", "week": "int", "day": "int", "weekday": "int", "nth": "int"}
    return [F.lit(every).alias("every"), *[F.col(s).cast("int").alias(s) if s in slots else F.lit(None).cast(t).alias(s) for s, t in free.items()]]


def _dated(dates: DataFrame) -> DataFrame:
    return dates.withColumns(features(F.col("date")))


YEARLY = {"date": ("month", "day"), "nth weekday": ("month", "weekday", "nth"), "week": ("week", "weekday")}
#: By kind of sequence: what recurs, the slots that are filled, and by what else rows are grouped.
SEQUENCES = {
    "date": ("month", ("day",), ()),
    "nth weekday": ("month", ("weekday", "nth"), ()),
    "week": ("week", ("weekday",), ("year",)),
}


def yearly(dates: DataFrame, kind: str, least: int = 3) -> DataFrame:
    """Candidates that recur every year: dates of a term that agree in all slots of the kind."""
    slots = YEARLY[kind]
    got = _dated(dates).groupBy("term", *slots).agg(F.array_sort(F.collect_list("date")).alias("dates")).where(F.size("dates") >= least)
    return got.select("term", *_pattern(got, "year", *slots), "dates")


def sequences(dates: DataFrame, kind: str, least: int = 3, inclusive: bool = True) -> DataFrame:
    """Candidates that recur every month or week: all runs of at least ``least`` neighbouring dates of a group.

    Weekly runs stay within a calendar year. Without ``inclusive``, runs that
    end at the last date are left out.
    """
    every, slots, more = SEQUENCES[kind]
    got = _dated(dates).groupBy("term", *slots, *more).agg(F.array_sort(F.collect_list("date")).alias("all"))
    got = got.where(F.size("all") >= (least if inclusive else least + 1))
    end = F.size("all") if inclusive else F.size("all") - 1
    got = got.withColumn("start", F.explode(F.sequence(F.lit(1), end - least + 1)))
    got = got.withColumn("n", F.explode(F.sequence(F.lit(least), end - F.col("start") + 1)))
    return got.select("term", *_pattern(got, every, *slots), F.slice("all", F.col("start"), F.col("n")).alias("dates"))


def candidates(dates: DataFrame) -> DataFrame:
    """All candidates of all kinds."""
    every = [yearly(dates, k) for k in YEARLY] + [sequences(dates, k) for k in SEQUENCES]
    return reduce(DataFrame.unionByName, every)


def pattern_text() -> Column:
    """The pattern as <year,month,week,day,weekday,nth>, e for what recurs and v for what is free."""
    recurs = {"month": "month", "week": "week"}
    slot = lambda s: F.coalesce(F.col(s).cast("string"), F.when(F.col("every") == recurs.get(s, ""), "e").otherwise("v"))
    year = F.when(F.col("every") == "year", "e").otherwise("v")
    return F.concat(F.lit("<"), F.concat_ws(",", year, *map(slot, SLOTS)), F.lit(">"))


def _ymd(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")))


def following(last: Column, step: Column) -> Column:
    """The date of the row's pattern that is ``step`` after ``last``; null where it does not exist."""
    by_month = F.col("every") == "month"
    months = F.month(last) + F.when(by_month, step).otherwise(0)
    year = F.year(last) + F.when(by_month, F.when(months > 12, 1).otherwise(0)).otherwise(step)
    month = F.when(months > 12, months - 12).otherwise(months)
    first = _ymd(year, month, F.lit(1))
    ahead = F.pmod(F.col("weekday") - F.weekday(first), F.lit(7))
    by_nth = _ymd(year, month, 1 + ahead + 7 * (F.col("nth") - 1))
    raw = _ymd(F.year(last) + step, F.month(last), F.dayofmonth(last))
    on_day = F.date_add(raw, F.pmod(F.col("weekday") - F.weekday(raw), F.lit(7)))
    by_week = F.date_add(on_day, ((F.col("week") - F.weekofyear(on_day)) * 7).cast("int"))
    return (
        F.when(F.col("every") == "week", F.date_add(last, (step * 7).cast("int")))
        .when(F.col("day").isNotNull(), _ymd(year, month, F.col("day")))
        .when(F.col("week").isNotNull(), by_week)
        .otherwise(by_nth)
    )


def _until(start: Column, end: Column, step: Column, most: Column, with_end: bool) -> Column:
    """Dates of the pattern after ``start``, one step at a time, while the last one is before ``end``."""
    none = F.array().cast("array<date>")
    state = F.struct(start.alias("at"), none.alias("out"), F.lit(True).alias("on"))

    def advance(s: Column, _: Column) -> Column:
        nxt = following(s["at"], step)
        go = s["on"] & (s["at"] < end) & nxt.isNotNull() & (F.lit(True) if with_end else nxt < end)
        return F.when(go, F.struct(nxt.alias("at"), F.array_append(s["out"], nxt).alias("out"), F.lit(True).alias("on"))).otherwise(
            F.struct(s["at"].alias("at"), s["out"].alias("out"), F.lit(False).alias("on"))
        )

    return F.aggregate(F.sequence(F.lit(1), most.cast("int")), state, advance, lambda s: s["out"])


def score(found: DataFrame, totals: DataFrame) -> DataFrame:
    """Coverage, consistency, step, gaps and score (the mean of both) of candidates; ``totals`` has n_dates by term.

    Intervals are differences of years, or days over 30.42 or 7.02 rounded
    half to even. The step is the least interval; a step of 0 or over 6 has
    no consistency. Between dates of another interval the pattern's dates are
    gaps, up to and with the one that reaches the later date.
    """
    unit = F.when(F.col("every") == "month", 30.42).otherwise(7.02)

    def interval(k: Column) -> Column:
        a, b = F.element_at("dates", k), F.element_at("dates", k + 1)
        return F.when(F.col("every") == "year", F.year(b) - F.year(a)).otherwise(F.bround(F.datediff(b, a) / unit).cast("int"))

    rows = found.join(totals.select("term", "n_dates"), "term")
    at = F.sequence(F.lit(1), F.size("dates") - 1)
    rows = rows.withColumn("intervals", F.transform(at, interval)).withColumn("step", F.array_min("intervals"))

    def between(k: Column) -> Column:
        steps = F.element_at("intervals", k)
        most = F.ceil(steps / F.greatest(F.col("step"), F.lit(1))) + 3
        inside = _until(F.element_at("dates", k), F.element_at("dates", k + 1), F.col("step"), most, with_end=True)
        return F.when(steps == F.col("step"), F.array().cast("array<date>")).otherwise(inside)

    periodic = F.col("step").between(1, LONGEST_STEP)
    uneven = periodic & (F.array_max("intervals") > F.col("step"))
    rows = rows.withColumn("gaps", F.when(uneven, F.flatten(F.transform(at, between))).otherwise(F.array().cast("array<date>")))
    n = F.size("dates")
    rows = rows.withColumn("coverage", n / F.col("n_dates")).withColumn(
        "consistency", F.when(periodic, n / (n + F.size("gaps"))).otherwise(F.lit(0.0))
    )
    return rows.withColumn("score", (F.col("coverage") + F.col("consistency")) / 2).withColumn("pattern", pattern_text()).drop("intervals", "n_dates")


def select(scored: DataFrame) -> DataFrame:
    """Of each term, the candidates in order of score that share no date with one taken before.

    Equal scores are in the order of patterns, then of first dates, then longer before shorter.
    """
    order = F.struct(
        (-F.round("score", 9)).alias("o1"), F.col("pattern").alias("o2"), F.element_at("dates", 1).alias("o3"), (-F.size("dates")).alias("o4"),
        "coverage", "consistency", "step", "dates", F.size("gaps").alias("n_gaps"), "every", *SLOTS,
    )
    lists = scored.groupBy("term").agg(F.array_sort(F.collect_list(order)).alias("x"))
    taken = F.aggregate(
        "x",
        F.slice("x", 1, 0),
        lambda kept, c: F.when(F.exists(kept, lambda k: F.arrays_overlap(k["dates"], c["dates"])), kept).otherwise(F.array_append(kept, c)),
    )
    out = lists.select("term", F.explode(taken).alias("c"))
    return out.select("term", F.col("c.o2").alias("pattern"), (-F.col("c.o1")).alias("score"), *[f"c.{k}" for k in ("coverage", "consistency", "step", "n_gaps", "dates", "every", *SLOTS)])


def group_similar(chosen: DataFrame, cosines: DataFrame, threshold: float) -> DataFrame:
    """term, pattern, component: terms of one pattern whose cosine (a, b, pattern, cosine) is above the threshold, by their least term."""
    nodes = chosen.select("term", "pattern").distinct().withColumn("id", F.xxhash64("term", "pattern"))
    a = nodes.select(F.col("term").alias("ta"), F.col("pattern"), F.col("id").alias("a"))
    b = nodes.select(F.col("term").alias("tb"), F.col("pattern"), F.col("id").alias("b"))
    edges = cosines.where(F.col("cosine") > threshold).join(a, ["ta", "pattern"]).join(b, ["tb", "pattern"]).select("a", "b")
    found = nodes.join(components(nodes.select("id"), edges), "id")
    heads = found.groupBy("component").agg(F.min("term").alias("head"))
    return found.join(heads, "component").select("term", "pattern", "head")


def merge_groups(scored: DataFrame, groups: DataFrame, dates: DataFrame) -> DataFrame:
    """Candidates of groups (term, pattern, head): the union of their dates for the pattern, scored over the union of all their dates."""
    joined = scored.join(groups, ["term", "pattern"])
    union = joined.groupBy(F.col("head").alias("term"), "every", *SLOTS).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("dates")))).alias("dates")
    )
    totals = groups.select("head", "term").distinct().join(dates, "term").select(F.col("head").alias("term"), "date").distinct()
    return score(union, totals.groupBy("term").agg(F.count(F.lit(1)).alias("n_dates")))


def predict_calendar(chosen: DataFrame, last: DataFrame, until: Column, threshold: float = 0.25) -> DataFrame:
    """term, pattern, last_date, date: the pattern's dates after the term's last one and before ``until``.

    Patterns must score above the threshold and have a step of 1 to 6.
    """
    rows = chosen.where((F.col("score") > threshold) & F.col("step").between(1, LONGEST_STEP)).join(last.select("term", "last_date"), "term")
    most = F.greatest(F.floor(F.datediff(until, F.col("last_date")) / (7 * F.col("step"))), F.lit(0)) + 1  # no pattern is shorter than weekly
    ahead = _until(F.col("last_date"), until, F.col("step"), most, with_end=False)
    return rows.withColumn("date", F.explode(ahead)).select("term", "pattern", "last_date", "date", "step", "score", "coverage", "consistency")


def predict_timeline(scores: DataFrame, steps: DataFrame, last: DataFrame, until: Column, most: float = 25.0) -> DataFrame:
    """term, last_date, date: every ``step`` days after the last date, before ``until``, of terms that deviate less than ``most``."""
    rows = scores.where(F.col("score") < most).join(steps, "term").join(last.select("term", "last_date"), "term")
    n = F.floor((F.datediff(until, F.col("last_date")) - 1) / F.col("step"))
    rows = rows.withColumn("__n", n).where("__n >= 1")
    each = rows.withColumn("k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__n"))))
    return each.select("term", "last_date", F.date_add("last_date", (F.col("k") * F.col("step")).cast("int")).alias("date"), "step", "score")


def since(dates: DataFrame, start: str) -> DataFrame:
    """Dates of the terms that have one on or after ``start``; earlier ones are their history."""
    late = dates.where(F.col("date") >= F.lit(start).cast("date")).select("term").distinct()
    return dates.join(late, "term", "left_semi")


def inliers(rows: DataFrame, value: str) -> DataFrame:
    """Rows whose value is less than one population deviation from the mean of all."""
    stats = rows.agg(F.avg(value).alias("__mean"), F.stddev_pop(value).alias("__dev"))
    near = F.abs(F.col(value) - F.col("__mean")) < F.col("__dev")
    return rows.crossJoin(F.broadcast(stats)).where(near).drop("__mean", "__dev")


def similar_dates(dates: DataFrame, gaps: DataFrame, least: int = 3, share: float = 0.5, apart: float = 10.0) -> DataFrame:
    """Pairs a < b of terms that share ``least`` dates, more than ``share`` of the dates of either, and have mean intervals less than ``apart`` days apart."""
    means = gaps.groupBy("term").agg(F.avg("interval").alias("m"))
    pairs = overlapping_sets(dates.select(F.col("term").alias("id"), F.col("date").alias("item")), share).where(F.col("shared") >= least)
    pairs = pairs.join(means.select(F.col("term").alias("a"), F.col("m").alias("ma")), "a").join(means.select(F.col("term").alias("b"), F.col("m").alias("mb")), "b")
    return pairs.where(F.abs(F.col("ma") - F.col("mb")) < apart).select("a", "b", "shared")


def group_by_dates(scores: DataFrame, near: DataFrame, cosines: DataFrame, threshold: float) -> DataFrame:
    """term and head: terms with interval scores, first led by the least term that they share dates with, then split by cosines (a, b, cosine).

    ``near`` has the pairs (a, b) of ``similar_dates`` of these terms.
    """
    scored = scores.select("term")
    led = leaders(scored.select(F.col("term").alias("id")), near)
    side = lambda k: led.select(F.col("id").alias(k), F.col("leader").alias(f"l{k}"))
    edges = cosines.where(F.col("cosine") > threshold).join(side("a"), "a").join(side("b"), "b").where("la = lb").select("a", "b")
    return components(scored.select(F.col("term").alias("id")), edges).select(F.col("id").alias("term"), F.col("component").alias("head"))


def merge_intervals(groups: DataFrame, scores: DataFrame, dates: DataFrame) -> DataFrame:
    """term (the head), terms, score (the least), dates and intervals of groups (term, head).

    Of several terms the dates are united and intervals of under two days
    left out; a single term keeps its own.
    """
    joined = groups.join(scores.select("term", "score"), "term").groupBy("head").agg(F.array_sort(F.collect_set("term")).alias("terms"), F.min("score").alias("score"))
    united = groups.join(dates, "term").groupBy("head").agg(F.array_sort(F.collect_set("date")).alias("dates"))
    at = F.filter(F.sequence(F.lit(1), F.size("dates")), lambda k: k < F.size("dates"))
    gaps = F.transform(at, lambda k: F.datediff(F.element_at("dates", k + 1), F.element_at("dates", k)))
    kept = F.when(F.size("terms") > 1, F.filter(gaps, lambda g: g >= 2)).otherwise(gaps)
    return joined.join(united, "head").select(F.col("head").alias("term"), "terms", "score", "dates", kept.alias("intervals"))


def texts_of_patterns(found: DataFrame, mentions: DataFrame) -> DataFrame:
    """term, pattern, date, text_id: the texts (term, date, text_id) of the dates that patterns (term, pattern, dates) cover."""
    return found.select("term", "pattern", F.explode("dates").alias("date")).join(mentions, ["term", "date"])
