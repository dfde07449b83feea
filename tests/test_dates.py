"""Date references, the nearest year and calendar features."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cyclora.functions import dates as D

POSTED = dt.date(2014, 3, 10)  # a Monday
CASES = [
    ("over 3 weken ", "2014-03-31", "2014-03-31"),
    ("nog twee dagen ", "2014-03-12", "2014-03-12"),
    ("met nog ruim 2 maanden te gaan", "2014-05-09", "2014-05-09"),
    ("5 nachtjes slapen tot", "2014-03-15", "2014-03-15"),
    ("5 mei 2014", "2014-05-05", "2014-05-05"),
    ("vijf mei", "2014-05-05", "2014-05-05"),
    ("12 januari", None, None),
    ("12-05-2014", "2014-05-12", "2014-05-12"),
    ("12-05", "2014-05-12", "2014-05-12"),
    ("1-2", None, None),
    ("2015-03-05", "2015-05-03", "2015-03-05"),
    ("30/03", None, "2014-03-30"),
    ("12/04", "2014-04-12", "2014-04-12"),
    ("2015/03/30", "2015-03-30", "2015-03-30"),
    ("komende vrijdag", "2014-03-14", "2014-03-14"),
    ("deze maandag", None, None),
    ("volgende week vrijdag", None, "2014-03-21"),
    ("overmorgen", "2014-03-12", "2014-03-12"),
    ("31-02-2015", None, None),
    ("29 februari", None, None),
]


@pytest.mark.parametrize(("text", "legacy", "fixed"), CASES)
def test_rules(text, legacy, fixed):
    for dialect, want in (("legacy", legacy), ("fixed", fixed)):
        got = D.references(text, POSTED, dialect)
        dates = got[0] if got else []
        assert [str(d) for d in dates] == ([want] if want else []), dialect


def test_phrases_and_chunks_are_cut():
    dates, phrase, chunks = D.references("kom naar het feest over 3 weken in de stad", POSTED)
    assert phrase == "over 3 weken" and chunks == ["kom naar het feest", "in de stad"]
    assert D.references("niets te doen", POSTED) is None


def test_relative_rules_yield_to_dates():
    dates, *_ = D.references("over 3 weken op 12 mei", POSTED)
    assert dates == [dt.date(2014, 5, 12)]


def test_references_in_rows(spark):
    rows = [(t, POSTED) for t, *_ in CASES] + [(None, POSTED), ("overmorgen", None), ("", POSTED)]
    got = spark.createDataFrame(rows, "text string, posted date").select("text", D.date_references(F.col("text"), F.col("posted")).alias("r")).collect()
    by = {}
    for (text, posted), r in zip(rows, got, strict=True):
        by[text, posted] = r["r"]
    assert by[None, POSTED] is None and by["overmorgen", None] is None and by["", POSTED] is None
    for text, _, fixed in CASES:
        assert [str(d) for d in by[text, POSTED]["refdates"]] == ([fixed] if fixed else [])


def test_nearest_year_ties_and_missing_days(spark):
    rows = [(dt.date(2014, 3, 10), 1, 12, 2014), (dt.date(2014, 12, 20), 1, 5, 2015), (dt.date(2014, 1, 5), 12, 30, 2013), (dt.date(2015, 3, 1), 2, 29, None), (dt.date(2014, 7, 2), 1, 1, 2014)]
    got = spark.createDataFrame(rows, "posted date, m int, d int, want int").select("want", D.nearest_year(F.col("posted"), F.col("m"), F.col("d")).alias("got")).collect()
    for (posted, m, d, want), r in zip(rows, got, strict=True):
        if want is None:
            assert r["got"] is None
            continue
        gap = {y: abs((dt.date(y, m, d) - posted).days) for y in (posted.year - 1, posted.year, posted.year + 1)}
        last, this, coming = gap.values()
        brute = posted.year + (0 if this < last and this < coming else 1 if coming < last else -1)
        assert r["got"] == brute


def test_features(spark):
    days = [dt.date(2021, 1, 3), dt.date(2024, 2, 29), dt.date(2014, 3, 31), dt.date(2014, 12, 29)]
    got = spark.createDataFrame([(d,) for d in days], "d date").select("d", *[c.alias(n) for n, c in D.features(F.col("d")).items()]).collect()
    for r in got:
        d = r["d"]
        assert (r["year"], r["month"], r["week"], r["day"], r["weekday"], r["nth"]) == (d.year, d.month, d.isocalendar()[1], d.day, d.weekday(), (d.day - 1) // 7 + 1)
