"""Intervals, calendar patterns, their scores, choice, groups and predictions."""

import datetime as dt
import itertools
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from cyclora.operators import periodic as P


def dates_of(spark, lists):
    rows = [(t, d) for t, ds in lists.items() for d in ds]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "term string, date date").repartition(3)


def day(text):
    return dt.date.fromisoformat(text)


def scored(spark, lists):
    dates = P.term_dates(dates_of(spark, lists))
    return P.score(P.candidates(dates), dates.groupBy("term").agg(F.count(F.lit(1)).alias("n_dates")))


@pytest.mark.parametrize(("years", "consistency", "step"), [((2010, 2011, 2012), 1.0, 1), ((2010, 2011, 2013), 0.6, 1), ((2010, 2012, 2014), 1.0, 2), ((2010, 2017, 2024), 0.0, 7)])
def test_yearly_dates(spark, years, consistency, step):
    rows = scored(spark, {"t": [dt.date(y, 5, 5) for y in years]}).where("pattern = '<e,5,v,5,v,v>'").collect()
    assert [(r["coverage"], r["consistency"], r["step"]) for r in rows] == [(1.0, consistency, step)]
    assert rows[0]["score"] == (1 + consistency) / 2


def test_two_dates_are_no_pattern(spark):
    assert scored(spark, {"t": [day("2010-05-05"), day("2011-05-05")]}).count() == 0


def test_monthly_and_weekly_patterns(spark):
    lists = {
        "m": [dt.date(2014, k, 5) for k in range(1, 8) if k != 4],
        "w": [day("2014-01-06") + dt.timedelta(days=7 * k) for k in (0, 1, 2, 4)],
        "n": [day("2014-01-14"), day("2014-02-11"), day("2014-03-11"), day("2014-04-08")],
    }
    got = {(r["term"], r["pattern"], len(r["dates"])): r for r in scored(spark, lists).collect()}
    assert got["m", "<v,e,v,5,v,v>", 6]["gaps"] == [day("2014-04-05"), day("2014-05-05")]
    assert got["m", "<v,e,v,5,v,v>", 6]["consistency"] == 6 / 8
    assert got["w", "<v,v,e,v,0,v>", 4]["gaps"] == [day("2014-01-27"), day("2014-02-03")]
    assert got["n", "<v,e,v,v,1,2>", 4]["consistency"] == 1.0
    assert all(0 <= r["coverage"] <= 1 and 0 <= r["consistency"] <= 1 for r in got.values())


def test_sequences_are_all_runs(spark):
    dates = P.term_dates(dates_of(spark, {"t": [dt.date(2014, k, 5) for k in range(1, 7)]}))
    got = [tuple(r["dates"]) for r in P.sequences(dates, "date").collect()]
    days = [dt.date(2014, k, 5) for k in range(1, 7)]
    assert sorted(got) == sorted(tuple(days[i:j]) for i in range(6) for j in range(i + 3, 7))
    short = [tuple(r["dates"]) for r in P.sequences(dates, "date", inclusive=False).collect()]
    assert sorted(short) == sorted(x for x in got if x[-1] != days[-1])


def brute_next(pattern, last, step):
    """By day-by-day search where that says the same, None where a date does not exist."""
    every, month, week, dom, wd, nth = pattern
    if every == "week":
        return last + dt.timedelta(days=7 * step)
    year, m = last.year, last.month
    if every == "year":
        year += step
    else:
        m += step
        year, m = (year + 1, m - 12) if m > 12 else (year, m)
    if dom:
        try:
            return dt.date(year, m, dom)
        except ValueError:
            return None
    days = [d for d in (dt.date(year, m, 1) + dt.timedelta(days=k) for k in range(31)) if d.month == m and d.weekday() == wd]
    return days[nth - 1] if nth <= len(days) else None


def test_following_dates(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(300):
        last, step = dt.date(2010, 1, 1) + dt.timedelta(days=rng.randrange(3000)), rng.randint(1, 6)
        every = rng.choice(["year", "month", "week"])
        by_day = rng.random() < 0.5
        nth = (last.day - 1) // 7 + 1
        rows.append((every, last.month if every == "year" else None, None, last.day if by_day and every != "week" else None, None if by_day and every != "week" else last.weekday(), None if by_day or every == "week" else nth, last, step))
    df = spark.createDataFrame(rows, "every string, month int, week int, day int, weekday int, nth int, last date, step int")
    for r in df.withColumn("x", P.following(F.col("last"), F.col("step"))).collect():
        assert r["x"] == brute_next((r["every"], r["month"], r["week"], r["day"], r["weekday"], r["nth"]), r["last"], r["step"])


def test_yearly_week_keeps_its_weekday_and_week(spark):
    rows = [("year", None, 20, None, 2, None, day("2014-05-14"), 1)]
    got = spark.createDataFrame(rows, "every string, month int, week int, day int, weekday int, nth int, last date, step int").select(P.following(F.col("last"), F.col("step")).alias("x")).first()["x"]
    assert got.isocalendar()[:3] == (2015, 20, 3)


def test_choice_is_greedy_and_disjoint(spark):
    rng = random.Random(4)
    lists = {f"t{k}": sorted({dt.date(2010, 1, 1) + dt.timedelta(days=rng.choice([1, 7, 28, 30, 31, 365]) * rng.randrange(12)) for _ in range(18)}) for k in range(6)}
    found = scored(spark, lists)
    chosen = P.select(found)
    by_term = {}
    for r in found.collect():
        by_term.setdefault(r["term"], []).append((-round(r["score"], 9), r["pattern"], r["dates"][0], -len(r["dates"]), r["dates"]))
    want = set()
    for term, every in by_term.items():
        taken = set()
        for _, pattern, *_, dates in sorted(every):
            if not taken & set(dates):
                taken |= set(dates)
                want.add((term, pattern, tuple(dates)))
    got = [(r["term"], r["pattern"], tuple(r["dates"])) for r in chosen.collect()]
    assert set(got) == want and len(got) == len(want)


def test_intervals_and_deviation(spark):
    rng = random.Random(5)
    lists = {f"t{k}": sorted({dt.date(2010, 1, 1) + dt.timedelta(days=rng.randrange(900)) for _ in range(rng.randint(1, 7))}) for k in range(40)}
    gaps = P.intervals(P.term_dates(dates_of(spark, {t: ds + ds[:1] for t, ds in lists.items()})))
    want = {t: [(b - a).days for a, b in zip(ds, ds[1:])] for t, ds in lists.items()}
    got = {}
    for r in gaps.orderBy("term", "pos").collect():
        got.setdefault(r["term"], []).append(r["interval"])
    assert got == {t: x for t, x in want.items() if x}
    scores = {r["term"]: r["score"] for r in P.relative_deviation(gaps).collect()}
    brute = {t: 100 * statistics.pstdev(x) / statistics.mean(x) for t, x in want.items() if len(x) >= 2 and min(x) > 5}
    assert scores.keys() == brute.keys() and all(math.isclose(scores[t], brute[t], abs_tol=1e-9) for t in brute)
    steps = {r["term"]: r["step"] for r in P.modal_step(gaps).collect()}
    assert steps == {t: max(x, key=lambda v: (x.count(v), -x.index(v))) for t, x in want.items() if x}
    segments = {(r["term"], r["start"], r["n"]): r["score"] for r in P.segments(gaps).collect()}
    for t, x in want.items():
        for i, j in itertools.combinations(range(len(x) + 1), 2):
            if j - i >= 2:
                part = x[i:j]
                assert math.isclose(segments.pop((t, i + 1, j - i)), 100 * statistics.pstdev(part) / statistics.mean(part) + 100 - len(part) / len(x) * 100, abs_tol=1e-6)
    assert not segments


def test_noisy_terms_are_gated(spark):
    first = dt.date(2014, 1, 1)
    lists = {"noisy": [first + dt.timedelta(days=k) for k in range(20)], "short": [first + dt.timedelta(days=k) for k in range(10)], "calm": [first + dt.timedelta(days=3 * k) for k in range(20)]}
    assert {r["term"] for r in P.calm(P.intervals(P.term_dates(dates_of(spark, lists)))).collect()} == {"short", "calm"}


def test_predictions_lie_between_last_date_and_end(spark):
    lists = {"y": [dt.date(y, 5, 5) for y in (2010, 2011, 2012)], "m": [dt.date(2012, k, 31) for k in (1, 3, 5)]}
    dates = P.term_dates(dates_of(spark, lists))
    chosen = P.select(scored(spark, lists))
    last = dates.groupBy("term").agg(F.max("date").alias("last_date"))
    until = F.lit("2016-01-01").cast("date")
    got = P.predict_calendar(chosen, last, until).collect()
    assert sorted(r["date"] for r in got if r["term"] == "y") == [dt.date(y, 5, 5) for y in (2013, 2014, 2015)]
    assert all(r["last_date"] < r["date"] < dt.date(2016, 1, 1) for r in got)
    gaps = P.intervals(dates)
    line = P.predict_timeline(P.relative_deviation(gaps), P.modal_step(gaps), last, until, 25).where("term = 'y'").collect()
    assert sorted(r["date"] for r in line) == [day("2012-05-05") + dt.timedelta(days=365 * k) for k in (1, 2, 3)]


def test_groups_are_scored_together(spark):
    lists = {"a": [dt.date(y, 5, 5) for y in (2010, 2012, 2014)], "b": [dt.date(y, 5, 5) for y in (2011, 2012, 2013)] + [dt.date(2013, 7, 1)], "c": [dt.date(y, 5, 5) for y in (2010, 2011, 2012)]}
    dates = P.term_dates(dates_of(spark, lists))
    found = scored(spark, lists).where("pattern = '<e,5,v,5,v,v>'")
    cosines = spark.createDataFrame([("a", "b", "<e,5,v,5,v,v>", 0.9), ("b", "c", "<e,5,v,5,v,v>", 0.1)], "ta string, tb string, pattern string, cosine double")
    groups = P.group_similar(found, cosines, 0.5)
    got = {r["term"]: r for r in P.merge_groups(found, groups, dates).collect()}
    assert set(got) == {"a", "c"} and got["a"]["consistency"] == 1.0 and got["a"]["coverage"] == 5 / 6


def test_terms_are_grouped_by_dates(spark):
    first = dt.date(2014, 1, 1)
    every = lambda n, *skip: [first + dt.timedelta(days=n * k) for k in range(12) if k not in skip]
    lists = {"a": every(10), "b": every(10, 3), "c": every(10, 5, 6), "d": every(11), "e": every(10, 0, 1, 2, 3, 4, 5)}
    dates = P.term_dates(dates_of(spark, lists))
    gaps = P.intervals(dates)
    pairs = {(r["a"], r["b"]): r["shared"] for r in P.similar_dates(dates, gaps).collect()}
    want = {}
    for x, y in itertools.combinations(lists, 2):
        n = len(set(lists[x]) & set(lists[y]))
        if n > 2 and n > 0.5 * len(lists[x]) and n > 0.5 * len(lists[y]):
            want[x, y] = n
    assert pairs == want
    scores = P.relative_deviation(gaps)
    cosines = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.2), ("b", "c", 0.2), ("a", "d", 0.99)], "a string, b string, cosine double")
    coded = lambda df, *more: df.select(F.ascii("a").alias("a"), F.ascii("b").alias("b"), *more)
    groups = P.group_by_dates(scores.select(F.ascii("term").alias("term"), "score"), coded(P.similar_dates(dates, gaps)), coded(cosines, "cosine"), 0.5)
    found = {chr(r["term"]): chr(r["head"]) for r in groups.collect()}
    assert found == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "e"}
    merged = P.merge_intervals(groups, scores.select(F.ascii("term").alias("term"), "score"), dates.select(F.ascii("term").alias("term"), "date"))
    row = merged.where(F.col("term") == ord("a")).first()
    assert row["dates"] == lists["a"] and row["intervals"] == [10] * 11 and row["score"] == 0.0


def test_history_and_inliers(spark):
    dates = dates_of(spark, {"old": [day("2010-01-01")], "new": [day("2010-01-01"), day("2015-01-01")]})
    assert {(r["term"], str(r["date"])) for r in P.since(dates, "2014-01-01").collect()} == {("new", "2010-01-01"), ("new", "2015-01-01")}
    values = [1.0, 2.0, 2.0, 3.0, 30.0]
    got = P.inliers(spark.createDataFrame([(v,) for v in values], "v double"), "v").collect()
    mean, deviation = statistics.mean(values), statistics.pstdev(values)
    assert sorted(r["v"] for r in got) == [v for v in values if abs(v - mean) < deviation]
